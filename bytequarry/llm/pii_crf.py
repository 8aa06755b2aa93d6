"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Around them a random field labels every token that
holds a digit or an @ (no other token can be an entity, so all others are fixed
to "none" and cut the chain): neighbouring tokens share a chain potential, and
tokens of one document that are equal, or end in the same seven digits, share a
skip potential, however far apart: each is tied to the occurrence before it, and
to an observed one if there is any. Loopy sum-product message passing runs over
the whole document until it settles; tokens of base spans are observed. A token that the field
gives a kind, and that skip edges tie to a base span of that kind, becomes a span
of its own: a second mention that the pattern misses. So the field finds nothing
in a document without any base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field as member
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.common import draw, id_text, slices, texts_of, training_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Bounds of the training sample: so many documents, by smallest hash of the id, and bytes of text.
TRAIN_ROWS = 4000
TRAIN_BYTES = 64 << 20
#: Least marginal of an added span, change below which a document's messages have settled, and a guard against messages that never do.
CONFIDENCE = 0.9
SETTLED = 1e-6
ROUNDS = 2000
#: Pairs of each label that count as seen to agree over a skip edge before any are.
AGREEING = 20.0
#: Digits at the end that make two tokens similar.
SUFFIX = 7
#: Tokens in one run of message passing.
BLOCK_TOKENS = 20_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits starts where no digit stands before, which keeps long runs linear and changes no match.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPACE = re.compile(r"\s")
_EDGE = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _octets(parts) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start, in code points."""
    found = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            found.append((0, start, low))
        at = text.find("@", low)
    if _DIGIT.search(text) is None:
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs without white space that hold a digit or an @."""
    out, at = [], 0
    while (m := _SIGN.search(text, at)) is not None:
        start, end = m.start(), _SPACE.search(text, m.end())
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = end.start() if end else len(text)
        out.append((start, at))
    return out


def _features(word: str, run_digits: int) -> list[int]:
    """Numbers of the features that hold; FEATURES in all."""
    digits = _NOT_DIGIT.sub("", word)
    n, core = len(digits), word.strip(_EDGE)
    on = [0, 1 + min(n, 20), 22 + min(run_digits, 20)]
    marks = (
        "@" in word,
        "@" in word and "." in word.rpartition("@")[2],
        word.startswith("+"),
        "(" in word or ")" in word,
        core.count(".") == 3 and _octets(p for p in core.split(".") if p.isdigit()),
        "-" in core,
        16 <= n <= 19 and luhn(digits),
        core.isdigit(),
        any(c.isalpha() for c in core),
    )
    return on + [43 + i for i, mark in enumerate(marks) if mark]


FEATURES = 43 + 9


@dataclass
class _Block:
    """Tokens of several documents, and the edges between them."""

    features: list[list[int]]
    label: list[int]  # of base spans, else 0
    near: list[tuple[int, int]]
    far: list[tuple[int, int]]
    held: list[tuple[int, int]] = member(default_factory=list)  # more skip edges, each from an observed token
    firsts: list[int] = member(default_factory=list)  # each document's first token

    def clear(self) -> None:
        for part in (self.features, self.label, self.near, self.far, self.held, self.firsts):
            part.clear()


def _graph(text: str, base: list[tuple[int, int, int]], block: _Block) -> list[tuple[int, int]]:
    """Adds the document's tokens and edges to the block; returns the tokens' places."""
    spots = tokens(text)
    first = len(block.label)
    block.firsts.append(first)
    joined = [i > 0 and text[spots[i - 1][1] : spots[i][0]].isspace() for i in range(len(spots))]
    counts = [len(_NOT_DIGIT.sub("", text[a:b])) for a, b in spots]
    runs, i = [0] * len(spots), 0
    while i < len(spots):
        j = i + 1
        while j < len(spots) and joined[j] and spots[j][0] - spots[j - 1][1] == 1:
            j += 1
        runs[i:j] = [sum(counts[i:j])] * (j - i)
        i = j
    marks = [0] * len(spots)
    if base:
        starts = np.array([s[0] for s in spots])
        ends = np.array([s[1] for s in spots])
        for kind, a, b in base:
            for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
                marks[k] = marks[k] or kind + 1
    last: dict[tuple[int, str], int] = {}
    seen: dict[tuple[int, str], int] = {}
    waiting: dict[tuple[int, str], list[int]] = {}
    for i, (a, b) in enumerate(spots):
        word = text[a:b]
        block.features.append(_features(word, runs[i]))
        block.label.append(marks[i])
        if joined[i]:
            block.near.append((first + i - 1, first + i))
        keys = [(0, word.strip(_EDGE).lower())]
        if counts[i] >= SUFFIX:
            keys.append((1, _NOT_DIGIT.sub("", word)[-SUFFIX:]))
        before, ties = set(), set()
        for key in keys:  # a chain through the occurrences: as connected as all pairs, with one edge a token
            if key in last and last[key] not in before:
                before.add(last[key])
                block.far.append((first + last[key], first + i))
            # Evidence fades along a chain, so each occurrence also has an edge from the last observed one, or the first if none came before.
            if marks[i]:
                ties |= {(i, j) for j in waiting.pop(key, ()) if last[key] != j}
                seen[key] = i
            elif key in seen:
                ties.add((seen[key], i))
            else:
                waiting.setdefault(key, []).append(i)
            last[key] = i
        block.held += [(first + a, first + b) for a, b in sorted(ties) if a not in before]
    return spots


@dataclass(frozen=True)
class Field:
    """Unary weights[feature, label] and the chain and skip potentials[label, label], as logarithms."""

    unary: np.ndarray
    near: np.ndarray
    far: np.ndarray


def _pair_potential(pairs: list[tuple[int, int]], labels: np.ndarray, size: int, agreeing: float = 0.0) -> np.ndarray:
    """Log of observed over expected pair counts, symmetric, smoothed by one and by ``agreeing`` pairs of each label."""
    seen = np.ones((size, size)) + agreeing * np.eye(size)
    if pairs:
        a, b = labels[np.array(pairs)].T
        np.add.at(seen, (a, b), 1)
        np.add.at(seen, (b, a), 1)
    share = seen.sum(0) / seen.sum()
    return np.log(seen / seen.sum() / np.outer(share, share))


def train(texts: list[str], steps: int = 300, rate: float = 1.0, decay: float = 1e-4) -> Field:
    """Piecewise training on the labels of the patterns: each kind of factor is fitted on its own.

    A token that no pattern labels, but that skip edges tie to one that is
    labelled, may be a mention that the patterns miss; it is left out.
    """
    block = _Block([], [], [], [])
    for text in texts:
        _graph(text, base_spans(text), block)
    size, labels = len(LABELS), np.array(block.label, np.int64)
    weights = np.zeros((FEATURES, size))
    known = (labels > 0) | (_tied(block, labels) == 0)
    if known.any():
        on = np.zeros((len(labels), FEATURES))
        for i, f in enumerate(block.features):
            on[i, f] = 1
        each, count = np.unique(np.column_stack([on, labels])[known], axis=0, return_counts=True)
        on, wanted = each[:, :-1], np.eye(size)[each[:, -1].astype(int)]
        count = count / count.sum()
        for _ in range(steps):
            p = np.exp(_normal(on @ weights))
            weights += rate * (on.T @ ((wanted - p) * count[:, None]) - decay * weights)
    near, far = ([p for p in pairs if known[p[0]] and known[p[1]]] for pairs in (block.near, block.far))
    return Field(weights, _pair_potential(near, labels, size), _pair_potential(far, labels, size, AGREEING))


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def marginals(field: Field, block: _Block, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs[token, label] after loopy sum-product message passing with half damping, until each document's messages settle."""
    size, n = len(LABELS), len(block.label)
    unary = np.zeros((n, size))
    for i, f in enumerate(block.features):
        unary[i] = field.unary[f].sum(0)
    labels = np.array(block.label, np.int64)
    seen = labels > 0
    unary[seen] = -np.inf  # whatever many neighbours say
    unary[seen, labels[seen]] = 0.0
    unary = _normal(unary)
    skip = block.far + block.held
    edges = np.array(block.near + skip, np.int64).reshape(-1, 2)
    if not len(edges):
        return np.exp(unary)
    potential = np.concatenate([np.repeat(field.near[None], len(block.near), 0), np.repeat(field.far[None], len(skip), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    opposite = np.roll(np.arange(len(source)), len(edges))
    messages = np.zeros((len(source), size))
    document = np.searchsorted(block.firsts, source, "right")
    live = np.arange(len(source))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target[live], messages[live])
        out = (belief[source[live]] - messages[opposite[live]])[:, :, None] + potential[live]
        top = out.max(1)
        out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new = _normal(0.5 * messages[live] + 0.5 * _normal(out))
        moved = np.abs(new - messages[live]).max(1) >= SETTLED
        messages[live] = new
        live = live[np.isin(document[live], document[live[moved]])]  # by document, so none depends on what shares its block
        if not len(live):
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return np.exp(_normal(belief))


def _tied(block: _Block, label: np.ndarray) -> np.ndarray:
    """The labels of base spans that skip edges carry to a token's group, as a bit set a token."""
    root = list(range(len(block.label)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in block.far:
        root[find(a)] = find(b)
    groups = np.array([find(i) for i in range(len(root))], np.int64)
    held = np.zeros(len(root), np.int64)
    np.bitwise_or.at(held, groups, np.where(label > 0, 1 << label, 0))
    return held[groups] if len(root) else held


def find_spans(field: Field, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base, added) spans of each whole text; null texts have none."""
    out, block, held = [], _Block([], [], [], []), []

    def settle():
        label = np.array(block.label, np.int64)
        belief, tied = marginals(field, block), _tied(block, label)
        best = belief.argmax(1)
        sure = (label == 0) & (best > 0) & (belief.max(1) >= CONFIDENCE) & ((tied >> best) & 1 == 1)
        for index, first, text, spots in held:
            picked = np.flatnonzero(sure[first : first + len(spots)])
            for i in picked.tolist():
                a, b = spots[i]
                word = text[a:b]
                a, b = a + len(word) - len(word.lstrip(_EDGE)), b - (len(word) - len(word.rstrip(_EDGE)))
                base, added = out[index]
                if a < b and not any(a < e and s < b for _, s, e in base):
                    kind = int(best[first + i]) - 1
                    if added and added[-1][0] == kind and text[added[-1][2] : a].strip(_EDGE + " ") == "" and i - 1 in picked:
                        a = added.pop()[1]
                    added.append((kind, a, b))
        block.clear(), held.clear()

    for text in texts:
        base = base_spans(text) if text else []
        out.append((base, []))
        if base:  # without a base span nothing can be tied to one
            first = len(block.label)
            held.append((len(out) - 1, first, text, _graph(text, base, block)))
            if len(block.label) >= BLOCK_TOKENS:
                settle()
    if held:
        settle()
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Field:
    """Trains on ``train_rows`` whole documents, those with the smallest hash of the id, brought to the driver.

    Of repeated ids (null among them) every row counts as a document. Documents
    that would take the texts above ``train_bytes`` are left out, as are null texts.
    """
    rows = documents.select(id_text(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    picked = rows.select(draw("pii-1|", F.col("__id")).alias("__h"), "__id", "__hash", F.octet_length("__text").alias("__bytes"))
    picked = picked.orderBy("__h", "__id", "__hash").limit(train_rows)
    return train([text for _, text in training_texts(picked, rows, train_bytes) if _SIGN.search(text)])


def detect(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans of every whole text.

    Counts and the checksum are those of the base spans; ``spans`` lists base and
    added ones as kind:start:end. Null and empty texts have none (and the
    checksum of the empty string). Added spans never overlap base ones. Repeated
    rows get equal results; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find_spans(shared.value, batch.column(1).to_pylist())
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([sha256(join_spans(base).encode()).hexdigest() for base, _ in found], pa.string())
            added = pa.array([len(x) for _, x in found], pa.int64())
            spans = pa.array([join_spans(base + x) for base, x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, added, spans], names)

    rows = texts_of(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, n_added long, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The same rows and columns, personal data in ``text_col`` replaced; null stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    column = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(column).to_pylist()
            found = find_spans(shared.value, texts)
            clean = [t if t is None else redact_text(t, base + x) for t, (base, x) in zip(texts, found)]
            yield batch.set_column(column, batch.schema.names[column], pa.array(clean, pa.string()))

    return texts_of(documents).mapInArrow(run, documents.schema)
