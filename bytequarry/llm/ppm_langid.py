"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree. The code length of a byte
after a context is that of PPM with escape method C and full exclusion: a byte
seen after the context costs -log2(n / (total + distinct)), any other costs the
escape -log2(distinct / (total + distinct)) and is then coded after the context
shortened by its oldest byte, bytes already ruled out left aside; at the end all
bytes left are equally likely. The statistics are frozen, so these costs are a
table over (context, byte), and a text's code length is a walk over one
automaton whose states are the contexts of all trees together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bytequarry.llm.common import draw, id_text, slices, texts_of, training_texts

#: Longest context in bytes.
ORDER = 4
#: Bounds of the training sample: so many labelled documents a language, by smallest hash, and bytes of text in all.
ROWS_PER_LANGUAGE = 300
TRAIN_BYTES = 64 << 20
#: Contexts of each language's trees: those it has seen least often are left out until so many remain.
CONTEXTS_PER_LANGUAGE = 1500
#: Parts in which a language's documents are dealt before its smallest hashes meet.
DEALT = 32
UNDETERMINED = "und"
#: Lanes that walk the automaton side by side, and bytes of texts scored at a time.
LANES = 4096
BLOCK_BYTES = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_BREAK = 0xFF  # never a byte of UTF-8


@dataclass(frozen=True)
class Model:
    languages: list[str]
    order: int
    symbols: np.ndarray  # class of each byte value; the last class is the break between texts
    step: np.ndarray  # state * classes + class -> state * classes
    cost: np.ndarray  # state * classes + class, language -> bits

    @property
    def classes(self) -> int:
        return int(self.symbols.max()) + 1


def _grams(data: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the runs of n classes that hold no break (class base - 1)."""
    if len(data) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code, clean = np.zeros(len(data) - n + 1, np.int64), np.ones(len(data) - n + 1, bool)
    for i in range(n):
        part = data[i : len(data) - n + 1 + i]
        code = code * base + part
        clean &= part != base - 1
    return np.unique(code[clean], return_counts=True)


def train(samples: dict[str, list[str]], order: int = ORDER, contexts: int = CONTEXTS_PER_LANGUAGE) -> Model:
    """Builds the trees from whole sample texts, in the order of the language names.

    The automaton's states are the contexts that any language keeps.
    """
    languages = sorted(samples)
    joined = {x: np.frombuffer(b"".join(t.encode() + bytes([_BREAK]) for t in samples[x]), np.uint8) for x in languages}
    used = sorted(set().union(*(np.unique(d).tolist() for d in joined.values())) - {_BREAK})
    other, stop = len(used), len(used) + 1  # unseen bytes share one class
    base = stop + 1
    symbols = np.full(256, other, np.int64)
    symbols[used] = np.arange(len(used))
    symbols[_BREAK] = stop
    data = {x: symbols[d] for x, d in joined.items()}
    grams = {x: [_grams(d, n, base) for n in range(1, order + 2)] for x, d in data.items()}

    kept: list[set[int]] = [set() for _ in range(order)]
    for x in languages:
        every = np.sort(np.concatenate([grams[x][n][1] for n in range(order)]))[::-1]
        least = max(2, int(every[contexts]) + 1 if len(every) > contexts else 2)
        for n in range(order):  # a context is seen no more often than its suffix, so suffixes are kept
            kept[n].update(grams[x][n][0][grams[x][n][1] >= least].tolist())
    index, parent, length = {(0, 0): 0}, [0], [0]
    for n, codes in enumerate(kept, 1):
        for code in sorted(codes):
            index[n, code] = len(parent)
            parent.append(index[n - 1, code % base ** (n - 1)] if n > 1 else 0)
            length.append(n)
    states = len(parent)
    step = np.zeros((states, base), np.int64)
    for (n, code), state in index.items():  # by length: a state starts from what its suffix does
        if n:
            step[state] = step[parent[state]]
        if n < order:
            for c in range(other):
                if (to := index.get((n + 1, code * base + c))) is not None:
                    step[state, c] = to
    step[:, stop] = 0

    up, deep = np.array(parent), np.array(length)
    cost = np.zeros((len(languages), states, base), np.float64)
    for i, x in enumerate(languages):
        counts = np.zeros((states, base))
        for n in range(order + 1):
            for code, k in zip(*(a.tolist() for a in grams[x][n])):
                if (state := index.get((n, code // base))) is not None:
                    counts[state, code % base] = k
        spent, ruled, done = np.zeros(states), np.zeros((states, base), bool), np.zeros((states, base), bool)
        ruled[:, stop] = done[:, stop] = True
        at, left = np.arange(states), deep.copy()
        for _ in range(order + 1):
            live = left >= 0
            seen_here = counts[at] * live[:, None]
            now = np.where(ruled, 0, seen_here)
            total, distinct = now.sum(1), (now > 0).sum(1)
            hit = (now > 0) & ~done
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = spent[:, None] - np.log2(now / (total + distinct)[:, None])
                escape = -np.log2(distinct / (total + distinct))
            cost[i][hit] = bits[hit]
            done |= hit
            spent += np.where(total > 0, escape, 0)
            ruled |= now > 0
            at, left = up[at], left - 1
        remain = np.maximum(1, (~ruled).sum(1))
        rest = (spent + np.log2(remain))[:, None] + np.zeros((1, base))
        cost[i][~done] = rest[~done]
        cost[i][:, other] += np.log2(256 - other if other < 256 else 1)  # which of the unseen bytes it is
        cost[i][:, stop] = 0
    return Model(languages, order, symbols.astype(np.uint8), (step * base).astype(np.int32).reshape(-1), np.ascontiguousarray(cost.reshape(len(languages), -1).T, np.float32))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """bits[text, language] of whole texts, under the frozen statistics."""
    joined = np.frombuffer(bytes([_BREAK]).join(texts) + bytes([_BREAK]), np.uint8)
    lanes = max(1, min(LANES, len(joined) // 64))
    width = -(-len(joined) // lanes)
    classes = np.full(lanes * width, model.classes - 1, np.int32)
    classes[: len(joined)] = model.symbols[joined]
    grid = np.ascontiguousarray(classes.reshape(lanes, width).T)
    at = np.zeros(lanes, np.int32)
    # A state depends on the last bytes only, as many as the order: each lane starts on the end of the one before it.
    for row in grid[-model.order :] if width >= model.order > 0 else ():
        at[1:] = model.step[at[1:] + row[:-1]]
    if width < model.order:
        for i in range(1, lanes):
            state = 0
            for c in classes[max(0, i * width - model.order) : i * width]:
                state = model.step[state + c]
            at[i] = state
    cells = np.empty((width, lanes), np.int32)
    for i in range(width):
        np.add(at, grid[i], out=cells[i])
        at = model.step[cells[i]]
    flat = np.ascontiguousarray(cells.T).reshape(-1)[: len(joined)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    return np.add.reduceat(model.cost[flat], starts, axis=0, dtype=np.float64)


def blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BLOCK_BYTES, or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def held_out(id_col: str) -> Column:
    """True for a document whose label and text no training reads."""
    return F.crc32(id_text(id_col).cast("binary")) % 3 == 1


def fit(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    order: int = ORDER,
    contexts: int = CONTEXTS_PER_LANGUAGE,
    train_bytes: int = TRAIN_BYTES,
) -> Model | None:
    """Learns from ``rows_per_language`` labelled documents of each language, those with the smallest hash.

    Held-out documents, null labels and null texts take no part; None if nothing
    is left. Of repeated ids (null among them) every row counts as a document.
    Documents that would take the texts above ``train_bytes`` are left out. Only
    the picked rows' texts are brought to the driver.
    """
    rows = documents.select(
        id_text(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text"), held_out(id_col).alias("__out")
    ).where(~F.col("__out") & F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    picked = rows.select(draw("lang-1|", F.col("__id")).alias("__h"), "__id", "__hash", F.octet_length("__text").alias("__bytes"), "__lang")
    order_by = ["__h", "__id", "__hash"]
    dealt = Window.partitionBy("__lang", "__part").orderBy(*order_by)
    picked = picked.withColumn("__part", F.pmod(F.hash("__h"), F.lit(DEALT)))
    picked = picked.withColumn("__n", F.row_number().over(dealt)).where(F.col("__n") <= rows_per_language)
    picked = picked.withColumn("__n", F.row_number().over(Window.partitionBy("__lang").orderBy(*order_by))).where(F.col("__n") <= rows_per_language)
    samples: dict[str, list[str]] = {}
    for _, text, lang in training_texts(picked.select(*order_by, "__bytes"), rows, train_bytes, "__lang"):
        samples.setdefault(lang, []).append(text)
    return train(samples, order, contexts) if samples else None


def predict(documents: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` and lang_pred, score.

    ``lang_pred`` is the language whose trees give the whole text the shortest
    code; ``score`` its probability if all languages are as likely. A text that
    is null or holds no letter is ``und`` with score 0, as is every text if there
    is no model. Ties go to the first name. Repeated rows get equal results; an
    empty table gives no rows. Columns of those two names are replaced.
    """
    documents = documents.drop("lang_pred", "score")
    schema = StructType(list(documents.schema.fields)).add("lang_pred", "string").add("score", "double")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    column = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column(column).to_pylist()
            found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
            if at:
                bits = np.concatenate([code_lengths(model, b) for b in blocks([texts[i].encode() for i in at])])
                best = bits.argmin(1)
                odds = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
                for i, b, p in zip(at, best.tolist(), odds.tolist()):
                    found[i], scores[i] = model.languages[b], p
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return texts_of(documents).mapInArrow(run, schema)
