import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_every_query_is_callable_and_sql_names_are_queries():
    queries = __spark_entry__.queries()
    assert all(callable(f) for f in queries.values()) and len(queries) > 60
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "bytequarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"bytequarry\.llm|from \.+llm", path.read_text()), path
