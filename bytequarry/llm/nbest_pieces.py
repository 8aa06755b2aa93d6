"""SentencePiece encoding and decoding by N-best segmentation.

The lattice of a text has an edge for every vocabulary piece that matches at a
place; a path's score is the sum of its pieces' scores. A forward Viterbi pass
gives the best score from the start to every place. These are exact heuristics
for an A-star search that runs backward from the end, so its k-th arrival at the
start is the k-th best path.

No piece of such a vocabulary holds a space mark behind another character, so a
text falls into groups (space marks, then other characters) whose lattices are
independent; where no piece holds a letter beside another kind of character,
groups end there too. The groups that some texts bring along are solved together,
step by step through the piece tree, and kept; the N best segmentations of a
text are the N best choices of one path a group, and they can differ from the
best only in the N - 1 groups with the smallest gaps to their second path, so
the search over the whole text runs on those.

A space mark that stands in a text itself is no space: it is spelled in byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bytequarry.llm.common import give_back, slices, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Entries of each of the two generations of a cache.
CACHE = 60_000
#: Characters of the texts whose groups are solved together, and of the longest group that is.
BATCH_CHARS = 1 << 18
LONGEST_TOGETHER = 40
#: Groups of one such pass.
TOGETHER = 8_192
#: Ids of one batch of output rows.
BATCH_IDS = 1 << 20
SPACE = "▁"
#: Stands for a space mark of the text itself; no text read from a table holds a lone surrogate.
OWN_MARK = "\udfff"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
_LETTER = r"[^\W\d_]"
#: Groups of a vocabulary without a piece that holds a letter beside another character (the space mark before it aside), and of others.
_FINE_GROUP = re.compile(rf"{SPACE}*{_LETTER}+|{SPACE}*(?:(?!{_LETTER})[^{SPACE}])+|{SPACE}+")
_GROUP = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NO_GAP = float("inf")


#: A group's best path: score, ids as 32-bit integers, gap to the second best (infinite if there is none), and whether the ids decode to the group.
Solved = tuple[float, bytes, float, bool]


class Segmentation(NamedTuple):
    score: float
    ids: bytes
    whole: bool


_SCORE, _IDS, _GAP, _WHOLE = map(itemgetter, range(4))


class _Cache(dict):
    """Two generations: when the younger is full it becomes the older, whose entries come back as they are asked for."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old.pop(key)
        self[key] = found
        return found

    def age(self) -> None:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}


class _Tree:
    """The piece tree as a hash table of (node, character), for many places at a time."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int]):
        nodes = {"": 0}
        for piece in scores:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.score = np.full(len(nodes), -np.inf)
        self.piece = np.full(len(nodes), -1, np.int32)
        for piece, value in scores.items():
            self.score[nodes[piece]], self.piece[nodes[piece]] = value, ids[piece]
        inner = [p for p in nodes if p]
        keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in inner], np.int64)
        values = np.array([nodes[p] for p in inner], np.int32)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):  # whoever is first takes a free slot, the others go on to the next
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            keys, values, slot = (np.delete(x, first) for x in (keys, values, slot))
            slot = slot + 1 & len(self.keys) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node below each node by its character, -1 if there is none."""
        keys = node.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & len(self.keys) - 1
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found


class Pieces:
    """A vocabulary file: pieces, scores and byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.unknown = 0
        self.bytes_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 1:
                self.id[p.piece], self.score[p.piece] = i, p.score
            elif p.type == 2:
                self.unknown = i
            elif p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte[value], self.bytes_of[i] = i, value
        self.has_bytes = len(self.bytes_of) == 256
        self.unknown_score = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.id), default=1)
        #: Scores of pieces, and None for what only starts pieces.
        self.table: dict[str, float | None] = {p[:n]: None for p in self.id for n in range(1, len(p))} | self.score
        #: A tree of characters; a node's score is under None.
        self.tree: dict = {}
        for p, value in self.score.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[None] = value
        letter = re.compile(_LETTER).match
        joins = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        mixed = any((letter(a) is None) != (letter(b) is None) for a, b in joins if a != SPACE)
        self.find_groups = (_GROUP if mixed else _FINE_GROUP).findall
        for p in self.id:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} holds a space mark behind another character")
        self.steps = _Tree(self.score, self.id)
        self.solved = _Cache()
        self.found_paths = _Cache()
        self.piece_bytes = [p.replace(SPACE, " ").encode() for p in self.text]
        for i, value in self.bytes_of.items():
            self.piece_bytes[i] = bytes([value])
        self.piece_width = np.array(list(map(len, self.piece_bytes)))

    def edges(self, group: str) -> list[list[tuple[int, float]]]:
        """For each place the (start, score) of the edges that end there."""
        into: list[list[tuple[int, float]]] = [[] for _ in range(len(group) + 1)]
        table, size = self.table, len(group)
        for start in range(size):
            if group[start] not in self.score:
                into[start + 1].append((start, self.unknown_score))
            for end in range(start + 1, size + 1):
                piece = group[start:end]
                if piece not in table:
                    break
                if table[piece] is not None:
                    into[end].append((start, table[piece]))
        return into

    def ids(self, piece: str) -> list[int]:
        found = self.id.get(piece)
        if found is not None:
            return [found]
        return [self.byte[b] for b in piece.replace(OWN_MARK, SPACE).encode()] if self.has_bytes else [self.unknown]

    def spells(self, ids: Iterable[int], group: str) -> bool:
        """Whether the ids decode to the group."""
        return b"".join([self.piece_bytes[i] for i in ids]) == group.replace(SPACE, " ").replace(OWN_MARK, SPACE).encode()

    def paths(self, group: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids): forward Viterbi, then backward A-star. Ties go to the longer last pieces."""
        into = self.edges(group)
        best = [0.0] + [-_NO_GAP] * len(group)
        for end in range(1, len(group) + 1):
            best[end] = max(best[start] + s for start, s in into[end])
        # (-estimate, -turn, place, score so far, cuts as a chain); among equal estimates the latest goes first
        heap: list[tuple] = [(-best[-1], 0, len(group), 0.0, (len(group), None))]
        found, turn = [], 0
        while heap and len(found) < n:
            _, _, end, behind, cuts = heapq.heappop(heap)
            if end == 0:
                marks = []
                while cuts:
                    marks.append(cuts[0])
                    cuts = cuts[1]
                found.append((behind, [i for a, b in zip(marks, marks[1:]) for i in self.ids(group[a:b])]))
                continue
            for start, s in sorted(into[end], reverse=True):
                turn -= 1
                heapq.heappush(heap, (-(best[start] + behind + s), turn, start, behind + s, (start, cuts)))
        return found

    def solve(self, group: str) -> Solved:
        """The best path of one group, of any length.

        Forward pass that keeps the two best scores at every place; same tie rule as ``paths``.
        """
        tree, unknown, size = self.tree, self.unknown_score, len(group)
        low = -_NO_GAP
        first, second, came = [0.0] + [low] * size, [low] * (size + 1), [0] * (size + 1)
        for start in range(size):
            a, b, end, node = first[start], second[start], start, tree
            for c in group[start:]:
                node = node.get(c)
                end += 1
                if node is None:
                    s = unknown if end == start + 1 else None
                else:
                    s = node.get(None)
                    if s is None and end == start + 1:
                        s = unknown
                if s is not None:
                    x = a + s
                    if x > first[end]:
                        second[end] = first[end] if first[end] > b + s else b + s
                        first[end], came[end] = x, start
                    elif x > second[end]:
                        second[end] = x
                if node is None:
                    break
        cuts = [size]
        while cuts[-1]:
            cuts.append(came[cuts[-1]])
        cuts.reverse()
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            ids += self.ids(group[a:b])
        return first[size], array("i", ids).tobytes(), first[size] - second[size], self.spells(ids, group)

    def solve_all(self, groups: list[str]) -> None:
        """Solves groups that are not kept yet, and keeps them: the pass of ``solve`` for all of them at a time."""
        solved, together = self.solved, []
        for group in groups:
            if len(group) <= LONGEST_TOGETHER:
                together.append(group)
            else:
                solved[group] = self.solve(group)
        together.sort(key=len, reverse=True)  # those that reach a place are the first ones
        for i in range(0, len(together), TOGETHER):
            self._solve_together(together[i : i + TOGETHER])

    def _solve_together(self, groups: list[str]) -> None:
        tree, unknown = self.steps, self.unknown_score
        sizes = np.array([len(g) for g in groups])
        longest, count = int(sizes[0]), len(groups)
        every = np.frombuffer("".join(groups).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.zeros((longest, count), np.int64)
        at = np.repeat(np.arange(count), sizes)
        starts = np.cumsum(sizes) - sizes
        chars[np.arange(len(at)) - np.repeat(starts, sizes), at] = every
        first, second = np.full((2, longest + 1, count), -np.inf)
        first[0] = 0
        came, piece = np.zeros((longest + 1, count), np.int8), np.zeros((longest + 1, count), np.int32)
        reach = [int(np.searchsorted(-sizes, -p, "left")) for p in range(longest + 1)]  # groups longer than p
        for start in range(longest):
            live = np.arange(reach[start])
            node = np.zeros(len(live), np.int32)
            first_here, second_here = first[start], second[start]
            for end in range(start + 1, longest + 1):
                node = tree.step(node, chars[end - 1].take(live))
                value = tree.score.take(node)
                if end == start + 1:
                    who, id_ = live, tree.piece.take(node)
                    none = (node < 0) | (id_ < 0)
                    value[none], id_[none] = unknown, -1
                else:
                    stay = np.flatnonzero(node >= 0)
                    live, node, value = live.take(stay), node.take(stay), value.take(stay)
                    if not len(live):
                        break
                    on = np.flatnonzero(value > -np.inf)
                    who, value, id_ = live.take(on), value.take(on), tree.piece.take(node.take(on))
                x, y = first_here.take(who) + value, second_here.take(who) + value
                f, g = first[end].take(who), second[end].take(who)
                better = np.flatnonzero(x > f)
                second[end][who] = np.maximum(np.minimum(f, x), np.maximum(g, y))
                won = who.take(better)
                first[end][won], came[end][won], piece[end][won] = x.take(better), start, id_.take(better)
                stay = np.flatnonzero((node >= 0) & (live < reach[end]))
                live, node = live.take(stay), node.take(stay)
                if not len(live):
                    break
        all_, place, turns = np.arange(count), sizes.copy(), []
        while len(all_):
            turns.append((all_, piece[place[all_], all_], place[all_] - 1))
            place[all_] = came[place[all_], all_]
            all_ = all_[place[all_] > 0]
        owner, ids, last = map(np.concatenate, zip(*turns))
        order = np.lexsort((last, owner))
        owner, ids, last = owner[order], ids[order], last[order]
        if (ids < 0).any():  # unknown characters
            spelled = np.flatnonzero(ids < 0)
            own = [self.ids(chr(c)) for c in every[starts[owner[spelled]] + last[spelled]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[spelled] = list(map(len, own))
            where = np.repeat(ids < 0, times)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[where] = list(chain.from_iterable(own))
        ends = np.searchsorted(owner, np.arange(count), "right")
        best = first[sizes, np.arange(count)]
        gaps = best - second[sizes, np.arange(count)]
        # All groups decode to themselves if together they do and the lengths are right.
        text = "".join(groups).replace(SPACE, " ").replace(OWN_MARK, SPACE).encode()
        list_ = ids.tolist()
        widths = np.where(every == ord(SPACE), 1, 1 + (every > 0x7F) + (every > 0x7FF) + (every > 0xFFFF))
        fits = np.array_equal(np.add.reduceat(widths, starts), np.bincount(owner, self.piece_width[ids], count))
        whole = fits and b"".join(map(self.piece_bytes.__getitem__, list_)) == text
        start, raw, keep = 0, ids.astype(np.int32).tobytes(), self.solved
        for group, end, score, gap in zip(groups, ends.tolist(), best.tolist(), gaps.tolist()):
            keep[group] = score, raw[4 * start : 4 * end], gap, whole or self.spells(list_[start:end], group)
            start = end

    def forget(self) -> None:
        """Empties the caches, so that a worker's next task of another kind has the memory."""
        self.solved.forget()
        self.found_paths.forget()

    def best_paths(self, group: str, n: int) -> list[Segmentation]:
        try:
            return self.found_paths[group, n]
        except KeyError:
            found = [Segmentation(score, array("i", ids).tobytes(), self.spells(ids, group)) for score, ids in self.paths(group, n)]
            self.found_paths.age()
            self.found_paths[group, n] = found
            return found

    def marked(self, text: str) -> str:
        marked = text.replace(SPACE, OWN_MARK).replace(" ", SPACE)
        return SPACE + marked if self.dummy_prefix and marked else marked

    def groups(self, text: str) -> list[str]:
        return self.find_groups(self.marked(text))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The groups of a text, solved, in parts of about BATCH_CHARS characters, cut where a space mark begins a group."""
        marked, start = self.marked(text), 0
        cuts = re.compile(f"(?<!{SPACE}){SPACE}")
        while start < len(marked):
            cut = cuts.search(marked, start + BATCH_CHARS)
            end = cut.start() if cut else len(marked)
            groups = self.find_groups(marked, start, end)
            self.keep_solved(groups)
            yield groups
            start = end

    def encode_all(self, texts: Iterable[str | None], n: int = N_BEST) -> Iterator[list[Segmentation]]:
        """``encode`` of many whole texts, in order; a null text has no segmentation."""
        held: list[list[str] | None] = []
        size = 0

        def flush() -> Iterator[list[Segmentation]]:
            self.keep_solved(*(g for g in held if g))
            for groups in held:
                yield [] if groups is None else self._encode([groups], n)

        for text in texts:
            long = text is not None and len(text) > BATCH_CHARS
            if long or size >= BATCH_CHARS:
                yield from flush()
                held, size = [], 0
            if long:
                yield self._encode(self.parts(text), n)
            else:
                held.append(None if text is None else self.groups(text))
                size += len(text or "")
        yield from flush()

    def keep_solved(self, *lists: list[str]) -> None:
        """Sees to it that all groups of the lists are solved and kept."""
        self.solved.age()
        wanted = set().union(*lists)
        self.solve_all([g for g in wanted if g not in self.solved and g not in self.solved.old])

    def encode(self, text: str, n: int = N_BEST) -> list[Segmentation]:
        """The n best segmentations of a whole text, best first; the empty text has one, without ids."""
        return next(self.encode_all([text], n))

    def _encode(self, parts: Iterable[list[str]], n: int) -> list[Segmentation]:
        score, ids, whole, at, open_ = 0.0, [], True, 0, []
        for groups in parts:
            solved = list(map(self.solved.__getitem__, groups))
            score += sum(map(_SCORE, solved))
            whole = whole and all(map(_WHOLE, solved))
            ids.append(b"".join(map(_IDS, solved)))
            gaps = list(map(_GAP, solved)) if n > 1 else []
            for _ in range(min(n - 1, len(gaps))):
                least = min(gaps)
                if least == _NO_GAP:
                    break
                i = gaps.index(least)
                gaps[i] = _NO_GAP
                open_.append((least, at + sum(map(len, map(_IDS, solved[:i]))), groups[i]))
            at += len(ids[-1])
        best = Segmentation(score, ids[0] if len(ids) == 1 else b"".join(ids), whole)
        return self._combine(best, sorted(sorted(open_)[: n - 1], key=itemgetter(1)), n)

    def _combine(self, best: Segmentation, open_: list[tuple[float, int, str]], n: int) -> list[Segmentation]:
        """The n best choices of a path for each of the (gap, place in the ids, group), all other groups having their best."""
        choices = [self.best_paths(group, n) for _, _, group in open_]
        heap = [(-0.0, (0,) * len(open_))]
        seen, out = {heap[0][1]}, []
        while heap and len(out) < n:
            loss, ranks = heapq.heappop(heap)
            if not any(ranks):
                out.append(best)
            else:
                ids, whole, done = [], best.whole, 0
                for (_, at, _), paths, r in zip(open_, choices, ranks):
                    if r:
                        ids += best.ids[done:at], paths[r].ids
                        whole, done = whole and paths[r].whole, at + len(paths[0].ids)
                out.append(Segmentation(best.score - loss, b"".join([*ids, best.ids[done:]]), whole))
            for k in range(len(ranks)):
                up = (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :])
                if up[k] < len(choices[k]) and up not in seen:
                    seen.add(up)
                    heapq.heappush(heap, (sum(choices[j][0].score - choices[j][r].score for j, r in enumerate(up)), up))
        return out

    def decode(self, ids) -> str:
        """The text that ids spell; byte pieces that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    return Pieces(path)


def encode_nbest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id and segmentations, an array of (score, ids), best first, for every whole text.

    A null text has a null array; the empty text one segmentation without ids. A
    text has fewer than ``n`` if its lattice has. Equal scores keep a fixed order.
    Repeated rows get equal results; an empty table gives no rows; other columns
    are ignored. Ids are those of the vocabulary file; characters without a piece
    are spelled in byte pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            start, ids, ends, scores, counts = 0, bytearray(), [0], [], [0]

            def pack(stop: int) -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))
                pairs = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lists], ["score", "ids"])
                return pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)], ["doc_id", "segmentations"])

            for row, found in enumerate(pieces.encode_all((t.as_py() for t in batch.column(1)), n)):
                if not found:
                    counts[-1] = None  # a null list
                for best in found:
                    ids += best.ids
                    ends.append(len(ids) // 4)
                    scores.append(best.score)
                counts.append(len(scores))
                if len(ids) >= 4 * BATCH_IDS:
                    yield pack(row + 1)
                    start, ids, ends, scores, counts = row + 1, bytearray(), [0], [], [0]
            if start < batch.num_rows:
                yield pack(batch.num_rows)
        pieces.forget()
        give_back()

    rows = texts_of(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, segmentations array<struct<score: double, ids: array<int>>>")


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and ``text``, the text that the ids spell (null for null)."""
    rows = rows.drop("text")
    column = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add("text", "string"))


def segmentation_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, scores, n_segmentations, restored of every whole text.

    The same search as ``encode_nbest``, with each best segmentation's ids reduced
    to their number and checksum (of 32-bit ids) where they are
    made. ``restored`` tells that decoding every one of the segmentations gives
    the text back: ids are decoded group by group, where a group's path is made,
    and the groups are the text. Null texts have null results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches):
            counts, sums, scores, found, same = [], [], [], [], []
            for best in pieces.encode_all(batch.column(1).to_pylist(), n):
                counts.append(len(best[0].ids) // 4 if best else None)
                sums.append(zlib.crc32(best[0].ids) if best else None)
                scores.append([b.score for b in best] if best else None)
                found.append(len(best) or None)
                same.append(all(b.whole for b in best) if best else None)
            arrays = [pa.array(x, t) for x, t in ((counts, pa.int64()), (sums, pa.int64()), (scores, pa.list_(pa.float64())), (found, pa.int32()), (same, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_tokens", "ids_crc32", "scores", "n_segmentations", "restored"])
        pieces.forget()
        give_back()

    rows = texts_of(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, scores array<double>, n_segmentations int, restored boolean")
