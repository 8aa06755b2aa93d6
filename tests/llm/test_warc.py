import base64
import gzip
import hashlib

from bytequarry.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in rows], SCHEMA)


ROWS = [(1, "http://a.org/x?y=1#z", "<p>same</p>"), (2, "http://b.org", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "bad url\r\nX: y", "é" * 40_000), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "lost")]


def expected(rows, least=0):
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = max((i for i, _, h in rows if (h or "") == (html or "") and i is not None), default=None)
        again = len(data) >= least and first is not None and first != page
        out.add((page, len(data), digest, "revisit" if again else "response", first if again else None))
    return out


def test_round_trip(spark, tmp_path):
    for least, broadcast in ((0, 500_000), (5, 0)):
        warc.BROADCAST_DIGESTS = broadcast
        folder = warc.write_captures(frame(spark, ROWS).repartition(3), f"file://{tmp_path}/w{least}", revisit_bytes=least, file_bytes=2000)
        records = warc.read_records(spark, folder)
        assert records.count() == 3 * len(ROWS)
        out = warc.assemble(records)
        got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()}
        assert got == expected(ROWS, least)
        assert all(r["request"] and r["metadata"] and r["request"]["target_uri"] == r["target_uri"] for r in out.collect())
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(spark, folder, True).where("record_type = 'metadata'").collect()}
    assert set(payloads) == {i for i, _, _ in ROWS}
    warc.BROADCAST_DIGESTS = 500_000


def test_no_rows_repeated_rows_and_cut_files(spark, tmp_path):
    folder = warc.write_captures(frame(spark, []), f"file://{tmp_path}/none")
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0
    folder = warc.write_captures(frame(spark, [(1, "u", "x"), (1, "u", "x"), (0, "u", "x")]), f"file://{tmp_path}/twice")
    out = warc.assemble(warc.read_records(spark, folder)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert list(warc.parse_archive(b"")) == []
    assert [r[-2] is None for r in warc.parse_archive(gzip.compress(b"no record"))] == [False]


def kinds(content):
    return [r[1] or "error" for r in warc.parse_archive(content)]


def test_damage_is_told_and_passed_over():
    records = [warc.capture_records(i, "http://a.org/", b"body %d" % i, None, False) for i in range(4)]
    plain = [gzip.decompress(m) for r in records for m in r]
    names, flat = ["request", "response", "metadata"], [m for r in records for m in r]
    assert kinds(b"".join(flat)) == names * 4 == kinds(gzip.compress(b"".join(plain)))
    big = warc.capture_records(9, None, bytes(range(256)) * 4000, None, False)
    assert kinds(b"".join(big)) == names and next(r for r in warc.parse_archive(b"".join(big)) if r[1] == "response")[9] == 1_024_000
    bad = {
        "malformed": gzip.compress(plain[4].replace(b"Content-Length: ", b"Content-Length: x")),
        "cut": gzip.compress(plain[4][:-30]),
        "longer": gzip.compress(plain[4].replace(b"Content-Length: ", b"Content-Length: 9")),
        "damaged": flat[4][:40] + b"\xff" * 20 + flat[4][60:],
        "other": gzip.compress(b"no record"),
    }
    for name, member in bad.items():
        assert kinds(b"".join(flat[:4]) + member + b"".join(flat[5:])) == [*(names * 2)[:4], "error", "metadata", *names * 2], name
    whole = b"".join(flat)
    for cut in (10, len(whole) // 2, len(whole) - 3):
        assert kinds(whole[:cut]).count("error") == 1
    assert all(r[-2] for r in warc.parse_archive(bad["cut"]))


def test_a_task_that_dies_after_its_first_file(spark, tmp_path, monkeypatch):
    """Runs in this process what a task does, dies, and runs again over rows in another order."""
    import pyarrow as pa
    import pyspark

    folder = f"file://{tmp_path}/again"
    taken = {}
    monkeypatch.setattr(warc, "materialize", lambda df, name: taken.setdefault(name, df))
    monkeypatch.setattr(warc, "publish", lambda manifest, place: None)
    monkeypatch.setattr(type(frame(spark, [])), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run) and self)
    rows = [(i, f"http://h/{i}", f"text {i} " * 50) for i in range(30)]
    warc.write_captures(frame(spark, rows), folder, file_bytes=1500)
    monkeypatch.undo()

    class Attempt:
        def __init__(self, number):
            self.partitionId, self.taskAttemptId = lambda: 0, lambda: number

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(i, u, h.encode(), None) for i, u, h in rows])], ["page_id", "url", "payload", "first"])
    run = taken["run"]
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Attempt(1)))
    next(run(iter([batch(rows)])))  # dies here
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Attempt(2)))
    manifest = [r for b in run(iter([batch(rows[::-1])])) for r in b.to_pylist()]
    monkeypatch.undo()
    table = spark.createDataFrame(manifest, "file string, aside string, records long, bytes long")
    for _ in range(2):  # a second run finds its files in place
        warc.publish(table, folder)
    out = warc.assemble(warc.read_records(spark, folder)).collect()
    assert sorted(r["page_id"] for r in out) == list(range(30))


def test_common_responses_are_looked_up_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_REFERS", 3)
    rows = ROWS + [(20 + i, "u", "<p>same</p>") for i in range(5)]
    folder = warc.write_captures(frame(spark, rows), f"file://{tmp_path}/hot")
    out = warc.assemble(warc.read_records(spark, folder)).collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == expected(rows)


def test_sql_on_null_ids(tmp_path, spark):
    import duckdb

    frame(spark, ROWS + [(None, "u", "<p>same</p>")]).coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert set(con.execute(warc.ROUND_TRIP_SQL).fetchall()) == expected(ROWS + [(None, "u", "<p>same</p>")])
