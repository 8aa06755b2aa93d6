"""Near-duplicate documents by b-bit MinHash.

Every document's set of word shingles gives HASHES minima. BANDS groups of them
are hashed into band keys, which generate candidates; of each minimum the low two
bits are kept and packed, and the similarity of two candidates is estimated from
the bits that agree, corrected for those that agree by chance. Candidates whose
estimate is not clearly too low are confirmed on the full sets.

Documents with equal sets form one class, so copies cost one row. Links need not
be listed to find the groups: a first round confirms one link a class, to the
smallest class of one of its buckets. After that only pairs of classes that share
a bucket and lie in different groups are of interest: a second round meets them
bucket by bucket (large buckets block by block), likeliest first, and links what
belongs together without listing pairs. No pair that shares a bucket is passed
over for any reason but its estimate, its sizes, or being in one group already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import WORD, give_back, slices, texts_of
from bytequarry.llm.components import components
from bytequarry.session import drop_scratch, materialize

WORDS = 5
#: A link needs 100 * intersection >= 75 * union.
PERCENT = 75
HASHES = 192
BANDS = 24
ROWS = 3
BITS = 2
#: Least estimate that is confirmed: 4.5 deviations below a true similarity of 0.75.
LEAST_ESTIMATE = 0.58
#: Members of a bucket that meet in one task; larger buckets are met block by block.
BLOCK = 1000
#: Ids of at most this many documents (8 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 19

_U = np.uint64
_random = np.random.default_rng(20_240_501)
_VALUE = _random.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_PLACE = _random.integers(1, 2**63, WORDS, dtype=_U) * _U(2) + _U(1)
_FACTOR = _random.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the base and of its inverse, for texts up to some length."""

    up = down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE)]), dtype=_U)
                cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _INVERSE)]), dtype=_U)
        return cls.up[:n], cls.down[:n]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): each text's distinct shingle hashes, sorted, from starts[i] to starts[i + 1]."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)] if texts else np.empty(0, np.uint8)
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    up, down = _Powers.get(len(data))
    total = np.concatenate([[_U(0)], np.cumsum(_VALUE[data] * up, dtype=_U)])
    words = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _BASE)
    owner = np.searchsorted(bounds, starts, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    whole = np.flatnonzero(owner[: len(owner) - WORDS + 1] == owner[WORDS - 1 :]) if len(owner) >= WORDS else np.empty(0, np.int64)
    value = np.zeros(len(whole), _U)
    for i in range(WORDS):
        value += words[whole + i] * _PLACE[i]
    parts, owners = [_mix(value)], [owner[whole]]
    for n in range(1, WORDS):  # a shorter text is one shingle
        short = np.flatnonzero(count == n)
        value = np.full(len(short), n * int(_BASE) % 2**64, _U)
        for i in range(n):
            value += words[first[short] + i] * _PLACE[i]
        parts.append(_mix(value))
        owners.append(short)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


_WORD_END = re.compile(rb"[\x09-\x0D\x20]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK bytes, cut between words; each begins with the last words of the one before it, so that no shingle is lost."""
    start = 0
    while True:
        end, words = start, np.empty(0, np.int64)
        while len(words) < WORDS and end < len(text):  # very long words
            blank = _WORD_END.search(text, min(end + CHUNK, len(text)))
            end = blank.start() if blank else len(text)
            blanks = _BLANK[np.frombuffer(text[start:end], np.uint8)]
            words = np.flatnonzero(~blanks & np.concatenate([[True], blanks[:-1]]))
        yield text[start:end]
        if not text[end:].strip(b"\x09\x0a\x0b\x0c\x0d\x20"):
            return
        start += int(words[1 - WORDS])


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``shingle_sets`` gives, in memory of some 60 times CHUNK and the sets; long texts are walked piece by piece."""
    values, counts = [np.empty(0, _U)], [0]
    for part in _chunks(texts):
        if len(texts[part.start]) <= 2 * CHUNK:
            value, starts = shingle_sets(texts[part])
            values.append(value)
            counts += np.diff(starts).tolist()
        else:
            found = np.unique(np.concatenate([shingle_sets([piece])[0] for piece in _pieces(texts[part.start])]))
            values.append(found)
            counts.append(len(found))
    return np.concatenate(values), np.cumsum(counts)


def signatures(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, packed, bands) of the sets that are not empty: 128-bit set keys, packed low bits, band keys."""
    live = np.flatnonzero(np.diff(starts))
    at = starts[:-1][live]
    if not len(live):
        return np.empty((0, 2), _U), np.empty((0, HASHES * BITS // 64), np.int64), np.empty((0, BANDS), np.int64)
    keys = np.stack([_mix(np.add.reduceat(_mix(value ^ c), at)) for c in (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))], 1)
    short = (value >> _U(32)).astype(np.uint32)
    minima = np.empty((len(live), HASHES), np.uint32)
    for i in range(HASHES):
        minima[:, i] = np.minimum.reduceat(short * _FACTOR[i] ^ _SHIFT[i], at)
    minima = _mix(minima.astype(_U) + np.arange(HASHES, dtype=_U) * _BASE)
    low = (minima & _U(2**BITS - 1)).reshape(len(live), -1, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=_U) * _U(BITS)), axis=2)
    rows = minima[:, : BANDS * ROWS].reshape(len(live), BANDS, ROWS)
    bands = np.zeros((len(live), BANDS), _U)
    for i in range(ROWS):
        bands = _mix(bands + rows[:, :, i] * _PLACE[i])
    return keys, packed.view(np.int64), _mix(bands + np.arange(BANDS, dtype=_U)).view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > CHUNK:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or b"" for t in batch.column("__text").cast(pa.binary()).to_pylist()]
        for part in _chunks(texts):
            value, starts = sets_of(texts[part])
            counts = np.diff(starts)
            keys, packed, bands = signatures(value, starts)
            empty = counts == 0
            where = pa.array(np.cumsum(~empty) - 1, mask=empty)
            columns = [
                batch.column("doc_id")[part],
                batch.column("text_hash")[part],
                pa.array(counts.astype(np.int64)),
                pa.array([k.tobytes() for k in keys], pa.binary()).take(where),
                pa.FixedSizeListArray.from_arrays(packed.ravel(), packed.shape[1]).cast(pa.list_(pa.int64())).take(where),
                pa.FixedSizeListArray.from_arrays(bands.ravel(), BANDS).cast(pa.list_(pa.int64())).take(where),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "key", "packed", "bands"])


def sketches(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, key, packed, bands of every whole text (null: empty, without a key)."""
    rows = texts_of(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")))
    rows = rows.select("doc_id", F.xxhash64("__text").alias("text_hash"), "__text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_sketch, f"doc_id {kind}, text_hash long, n_shingles long, key binary, packed array<long>, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """The similarity that two packed signatures suggest, corrected for chance agreement."""
    odd = 0x5555555555555555
    differ = F.zip_with(a, b, lambda x, y: F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(F.lit(odd))))
    share = 1 - F.aggregate(differ, F.lit(0), lambda s, x: s + x) / F.lit(float(HASHES))
    chance = 1 / 2**BITS
    return (share - chance) / (1 - chance)


def _alike_in_size(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _is_link(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets are linked."""
    for batch in slices(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        texts: dict[bytes, bytes] = {}
        for keys, column in ((a, "text_a"), (b, "text_b")):
            for key, text in zip(keys, batch.column(column).cast(pa.binary()).to_pylist()):
                texts.setdefault(key, text)
        sets: dict[bytes, np.ndarray] = {}
        names, data = list(texts), list(texts.values())
        for part in _chunks(data):
            value, starts = sets_of(data[part])
            for i, key in enumerate(names[part]):
                sets[key] = value[starts[i] : starts[i + 1]]
        linked = []
        for x, y in zip(a, b):
            linked.append(_is_link(sets[x], sets[y]))
        yield batch.select(["a", "b"]).filter(pa.array(linked))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of the pairs that are linked. A class in many pairs is on the side that Spark splits when it is skewed."""
    left = pairs.select("a", "b").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    full = left.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a binary, b binary"), "links")


def _passing(table: pa.Table) -> list[tuple[float, int, int]]:
    """(estimate, i, j) of the rows of a bucket block that lie in different groups and may be linked.

    A pair that shares several buckets is met in the first of them only.
    """
    roots = table.column("root").to_pylist()
    block, n = np.asarray(table.column("block")), np.asarray(table.column("n"))
    lo, hi, band = (table.column(c)[0].as_py() for c in ("lo", "hi", "band"))
    packed = np.array(table.column("packed").to_pylist(), np.int64).view(_U)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    names = {r: i for i, r in enumerate(set(roots))}
    group = np.array([names[r] for r in roots])
    left, right, out = np.flatnonzero(block == lo), np.flatnonzero(block == hi), []
    for i in left.tolist():
        other = right[right > i] if lo == hi else right
        other = other[(group[other] != group[i]) & (np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * PERCENT)]
        x = packed[other] ^ packed[i]
        share = 1 - np.bitwise_count((x | (x >> _U(1))) & _U(0x5555555555555555)).sum(1) / HASHES
        score = (share - 0.25) / 0.75
        near = score >= LEAST_ESTIMATE
        other, score = other[near], score[near]
        first = bands[i][(bands[other] == bands[i]).argmax(1)] == band
        out += zip(score[first].tolist(), [i] * int(first.sum()), other[first].tolist())
    return out


def _open_members(table: pa.Table) -> pa.Table:
    """The rows of a bucket block that have a partner to be confirmed."""
    pairs = _passing(table)
    return table.take(pa.array(sorted({x for _, i, j in pairs for x in (i, j)}), pa.int64()))


def _confirm_across(table: pa.Table) -> pa.Table:
    """Links between groups of a bucket block on full sets, likeliest pairs first; pairs that a link has joined are settled."""
    keys, roots = table.column("key").to_pylist(), table.column("root").to_pylist()
    up = {r: r for r in roots}

    def find(r):
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    texts = table.column("text").cast(pa.binary()).to_pylist()
    sets: list[np.ndarray] = []
    for part in _chunks(texts):
        value, starts = sets_of(texts[part])
        sets += [value[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
    out = []
    for _, i, j in sorted(_passing(table), key=lambda p: (-p[0], keys[p[1]], keys[p[2]])):
        x, y = find(roots[i]), find(roots[j])
        if x != y and _is_link(sets[i], sets[j]):
            up[x] = y
            out.append((keys[i], keys[j]))
    a, b = zip(*out) if out else ((), ())
    if table.nbytes > CHUNK:
        del sets, texts
        give_back()
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _links_across(members: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: links between all groups that meet in a bucket, as many as it takes to join what is linked.

    Only buckets with members of several groups are met, block by block, and
    only members with a partner whose estimate passes bring their texts.
    """
    rooted = members.select("band", "key").join(labels, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y")
    rows = rooted.join(mixed.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "band")
    rows = rows.join(classes.select("key", F.col("n_shingles").alias("n"), "packed", "bands"), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "key", "root", "n", "packed", "bands", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    # A block is much work for its bytes, by which Spark would put many in one task.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "band", "lo", "hi")
    open_ = materialize(rows.groupBy("band", "lo", "hi").applyInArrow(_open_members, rows.schema), "open")
    full = open_.join(texts, "key").repartition(tasks, "band", "lo", "hi")
    return materialize(full.groupBy("band", "lo", "hi").applyInArrow(_confirm_across, "a binary, b binary"), "links")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, group_key of every row.

    Words are runs without ASCII white space, A to Z in lower case; a document's
    set holds its distinct 5-word shingles, or the whole sequence if it has fewer
    words. Null and empty texts have empty sets and are linked with nothing.
    ``component_id`` is the smallest id reachable over links, ``kept`` tells
    whether it is the row's own. Null ids are never the smallest unless all of
    the group are; repeated rows share a group and are kept or not alike (see
    ``without_duplicates``). ``group_key`` names the group whatever its ids, and
    is null for an empty set. An empty table gives no rows; other columns are
    ignored.
    """
    drawn = materialize(sketches(documents, id_col, text_col), "sketches")
    full = drawn.where(F.col("key").isNotNull())
    classes = full.groupBy("key").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("sample"),
        F.min("n_shingles").alias("n_shingles"),
        F.min("packed").alias("packed"),
        F.min("bands").alias("bands"),
    )
    classes = materialize(classes, "classes")

    rows = classes.select("key", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("m")).where("m > 1")
    members = materialize(rows.join(buckets.select("band", "hub"), "band"), "members")

    wanted = classes.join(members.select("key").distinct(), "key", "left_semi").select("key", "sample")
    wanted = wanted.select("key", F.col("sample.doc_id").alias("doc_id"), F.col("sample.text_hash").alias("text_hash"))
    wanted = materialize(wanted, "wanted")
    if wanted.limit(1).count():
        texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        texts = texts.withColumn("text_hash", F.xxhash64("text"))
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        match = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
        texts = texts.join(wanted, match).select("key", "text").dropDuplicates(["key"])
        texts = materialize(texts, "texts")
        labels = _linked(members, classes, texts)
    else:
        labels = None

    found = classes.select("key", "first_id")
    if labels is not None:
        rooted = found.join(labels, "key")
        least = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
        linked = rooted.join(least, "root").select("key", "root", "least")
        found = found.join(linked, "key", "left").select("key", F.coalesce("root", "key").alias("group_key"), F.coalesce("least", "first_id").alias("component_id"))
    else:
        found = found.select("key", F.col("key").alias("group_key"), F.col("first_id").alias("component_id"))
    out = drawn.select("doc_id", "text_hash", "n_shingles", "key").join(found, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "group_key"
    )


def without_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` with one row of each group left: that with the smallest id (then text hash).

    Rows with empty sets are linked with nothing, so all of them stay. Of equal
    rows that repeat the one that stays, one is left.
    """
    found = near_duplicates(documents, id_col, text_col).select("doc_id", "text_hash", "group_key")
    found = materialize(found.where(F.col("group_key").isNotNull()), "groups")
    rows = found.groupBy("doc_id", "text_hash", "group_key").agg(F.count("*").alias("copies"))
    first = found.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    rows = rows.join(first, "group_key")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    rows = materialize(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), stays.alias("__stays"), "copies"), "verdicts")
    tagged = documents.withColumn("__text_hash", F.xxhash64(F.col(text_col).cast("string")))
    gone = rows.where(~F.col("__stays"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    match = tagged[id_col].eqNullSafe(F.col("__id")) & (tagged["__text_hash"] == F.col("__hash"))
    left = tagged.join(gone, match, "left_anti")
    again = rows.where(F.col("__stays") & (F.col("copies") > 1))
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_IDS else again
        match = left[id_col].eqNullSafe(F.col("__id")) & (left["__text_hash"] == F.col("__hash"))
        once = left.join(again, match, "left_semi").dropDuplicates([id_col, "__text_hash"])
        left = left.join(again, match, "left_anti").union(once)
    return left.drop("__text_hash")


def _linked(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """key, root of every class that is linked to another, or None."""
    facts = classes.select("key", F.col("n_shingles").alias("n"), "packed")
    shared = members.where("key <> hub").groupBy("key", "hub").agg(F.count("*").alias("m"))
    hubs = shared.groupBy("key").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
    hubs = hubs.join(facts.select("key", F.col("n").alias("n_b"), F.col("packed").alias("p_b")), "key")
    hubs = hubs.join(facts.select(F.col("key").alias("hub"), F.col("n").alias("n_a"), F.col("packed").alias("p_a")), "hub")
    hubs = hubs.where(_alike_in_size("n_a", "n_b") & (estimate("p_a", "p_b") >= LEAST_ESTIMATE))
    links = _confirmed(hubs.select(F.col("hub").alias("a"), F.col("key").alias("b")), texts)
    labels = components(links)
    more = _links_across(members, classes, labels, texts)
    if more.limit(1).count():
        labels = components(links.union(more))
    drop_scratch(texts)
    return labels


#: DuckDB SQL for the rows of ``near_duplicates`` over documents, without ``text_hash`` and ``group_key``.
NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i : i + {WORDS - 1}], ' ') FOR i IN range(1, len(ws) - {WORDS - 2})]) END AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
"""
