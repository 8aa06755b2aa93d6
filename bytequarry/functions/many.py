"""Codecs over many blobs at once: the streams of ``blocks`` and ``codecs``, worked out by array operations.

A blob of a table is small, so what a blob alone costs counts more than its bytes.
Here blobs are laid end to end and matches, rotations and runs are found for all
of them together; coders with a state step through many blobs side by side. Every
stream is the one that the blob gives alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from bytequarry.functions import blocks

#: Bytes laid end to end at a time: so that working arrays stay near the processor.
JOINED_BYTES = 1 << 16
#: Bytes by which words reach behind the last blob.
_PAD = 64
#: Bytes by which matches of all places are compared; longer ones are measured where the walk takes them.
LOOK = 24
#: By a length, the bytes of a word up to the one behind it; the whole word from eight on.
_BEYOND = np.array([(1 << 8 * min(n + 1, 8)) - 1 for n in range(LOOK + 1)], np.uint64)


def parts(blobs: Sequence[bytes], most: int = JOINED_BYTES) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of blobs of ``most`` bytes together, or one blob that has more."""
    first = held = 0
    for i, blob in enumerate(blobs):
        if i > first and held + len(blob) > most:
            yield first, i
            first, held = i, 0
        held += len(blob)
    if first < len(blobs):
        yield first, len(blobs)


class Joined:
    """Blobs end to end: the bytes, each blob's start and end, and these for every byte."""

    def __init__(self, blobs: Sequence[bytes]):
        self.data = b"".join((*blobs, bytes(_PAD)))
        self.sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.n = int(self.ends[-1]) if len(blobs) else 0
        self.bytes = np.frombuffer(self.data, np.uint8)

    def words(self, behind: int = 0) -> np.ndarray:
        """The eight bytes from every place on, the first one lowest."""
        return np.ndarray((self.n + _PAD - 8 - behind,), "<u8", self.data, behind, (1,))

    def each(self, of_blob: np.ndarray) -> np.ndarray:
        return np.repeat(of_blob, self.sizes)


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Equal bytes from the lowest on, of words that were xored."""
    low = x - np.uint64(1)
    low &= ~x
    found = np.bitwise_count(low)
    found >>= 3
    return found


def longest(joined: Joined, window: int, least: int, most: int, chain: int) -> tuple[np.ndarray, np.ndarray, Callable[[int], tuple[int, int]]]:
    """(length, distance, of long ones) of the longest match at every byte, 0 without one.

    Candidates are the last ``chain`` places in the blob and the window that start
    with the same ``least`` bytes; the nearest of the longest counts. Lengths are
    exact below LOOK bytes; the function tells both for a place of LOOK or more.
    """
    n = joined.n
    place = np.arange(n, dtype=np.uint64)
    end = joined.each(joined.ends)
    key = (joined.words()[:n] & np.uint64((1 << 8 * least) - 1)) << np.uint64(32) | place
    key = key[np.arange(least, n + least) <= end]
    key.sort()
    spot = (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
    room = np.minimum(end[spot] - spot, min(most, LOOK)).astype(np.uint8)
    begin = joined.each(joined.starts)
    low = np.maximum(begin[spot], spot - window).astype(np.int32)
    ahead = [joined.words(b)[spot] for b in range(0, LOOK, 8)]
    size, which = np.zeros(len(spot), np.uint8), np.zeros(len(spot), np.uint8)
    need = np.full(len(spot), _BEYOND[least - 1])  # bytes that a better candidate has in common
    for k in range(1, min(chain, len(spot) - 1) + 1):
        unlike = ahead[0][k:] ^ ahead[0][:-k]
        unlike &= need[k:]
        hit = unlike == 0
        hit &= spot[:-k] >= low[k:]
        i = np.flatnonzero(hit) + k
        if not len(i) and not size.any():
            break
        same = equal_bytes(ahead[0][i] ^ ahead[0][i - k])
        more = np.flatnonzero(same == 8)
        for later in ahead[1:]:
            j = i[more]
            found = equal_bytes(later[j] ^ later[j - k])
            same[more] += found
            more = more[found == 8]
        np.minimum(same, room[i], out=same)
        better = same > size[i]
        i, same = i[better], same[better]
        size[i], which[i] = same, k
        need[i] = _BEYOND[same]
        low[i[same == room[i]]] = n  # none is better
    at = np.flatnonzero(size)
    length, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length[spot[at]] = size[at]
    far[spot[at]] = spot[at] - spot[at - which[at]]
    row: np.ndarray | None = None

    def long_one(start: int) -> tuple[int, int]:
        nonlocal row
        if row is None:
            row = np.zeros(n, np.int64)
            row[spot] = np.arange(len(spot))
        i, best, distance = int(row[start]), 0, 0
        limit, data = min(most, int(end[start]) - start), joined.data
        for k in range(1, min(chain, i) + 1):
            other = int(spot[i - k])
            if other < max(int(begin[start]), start - window) or data[other : other + least] != data[start : start + least]:
                break
            if data[other : other + best + 1] != data[start : start + best + 1]:
                continue
            common = common_bytes(data, other, start, limit)
            if common > best:
                best, distance = common, start - other
                if common == limit:
                    break
        return best, distance

    return length, far, long_one


def common_bytes(data: bytes, a: int, b: int, limit: int) -> int:
    """Equal bytes from two places on, up to a limit."""
    known, step = 0, 32
    while known < limit:
        step = min(step, limit - known)
        if data[a + known : a + known + step] == data[b + known : b + known + step]:
            known, step = known + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
            if data[a + known : a + known + step] != data[b + known : b + known + step]:
                continue
            known += step
            step = max(1, step // 2)
    return known


def greedy(joined: Joined, window: int, least: int, most: int, chain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, distances and lengths of the matches that a greedy walk through every blob takes, places of the bytes between them)."""
    length, far, long_one = longest(joined, window, least, most, chain)
    n = joined.n
    match = np.where(length > 0, np.arange(n), n)
    match = np.append(np.minimum.accumulate(match[::-1])[::-1], n)  # the next place that has one
    hops = match[np.arange(n) + length]
    if most > LOOK:
        hops[length == LOOK] = -1
    hop, walk, at = hops.tolist(), [], int(match[0])
    while at < n:
        walk.append(at)
        to = hop[at]
        if to < 0:
            length[at], far[at] = step = long_one(at)
            to = int(match[at + step[0]])
        at = to
    places = np.array(walk, np.int64)
    size = length[places]
    covered = np.zeros(n + 1, np.int8)
    covered[places] = 1
    covered[places + size] -= 1
    return places, far[places], size, np.flatnonzero(np.cumsum(covered[:n], dtype=np.int8) == 0)


def _varint_sizes(values: np.ndarray) -> np.ndarray:
    size = np.ones(len(values), np.int64)
    for shift in range(7, 35, 7):
        over = values >> shift > 0
        if not over.any():
            break
        size += over
    return size


def _put_varints(out: np.ndarray, at: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
    out[at] = values & 127 | (size > 1) << 7
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[at[more] + k] = values[more] >> 7 * k & 127 | (size[more] > k + 1) << 7


def lz77_encode(blobs: Sequence[bytes]) -> list[bytes]:
    out = []
    for first, last in parts(blobs):
        joined = Joined(blobs[first:last])
        places, far, length, plain = greedy(joined, blocks.WINDOW, blocks.LEAST, 1 << 16, blocks.CHAIN)
        # A turn is a run of plain bytes and the match behind it; each blob's last run has none.
        stops = places.searchsorted(joined.ends) + np.arange(len(joined.ends))
        turns = len(places) + len(joined.ends)
        closing = np.zeros(turns, bool)
        closing[stops] = True
        end, behind = np.empty(turns, np.int64), np.empty(turns, np.int64)
        end[closing], end[~closing] = joined.ends, places
        behind[closing], behind[~closing] = joined.ends, places + length
        run = end - np.concatenate([[0], behind[:-1]])
        run_size, length_size, far_size = _varint_sizes(run), _varint_sizes(length), _varint_sizes(far)
        size = run_size + run
        size[~closing] += length_size + far_size
        after = np.cumsum(size)
        at = after - size
        body = np.empty(int(after[-1]), np.uint8)
        _put_varints(body, at, run, run_size)
        body[np.arange(len(plain)) + np.repeat(at + run_size - (np.cumsum(run) - run), run)] = joined.bytes[plain]
        at = (at + run_size + run)[~closing]
        _put_varints(body, at, length, length_size)
        _put_varints(body, at + length_size, far, far_size)
        start = 0
        for n, stop in zip(joined.sizes.tolist(), after[stops].tolist()):
            out.append(blocks.varint(n) + body[start:stop].tobytes())
            start = stop
    return out


def lzss_encode(blobs: Sequence[bytes]) -> list[bytes]:
    out = []
    for first, last in parts(blobs):
        joined = Joined(blobs[first:last])
        places, far, length, bytes_at = greedy(joined, 4095, 3, 18, blocks.CHAIN)
        kind = np.full(joined.n, 2, np.uint8)
        kind[bytes_at], kind[places] = 1, 0
        plain = kind[kind < 2] == 1
        items = np.concatenate([[0], np.cumsum(kind < 2)])
        cuts = items[joined.ends]
        nth = (np.arange(len(plain)) - np.repeat(items[joined.starts], cuts - items[joined.starts])) & 7
        head = nth == 0
        size = 2 - plain + head
        behind = np.cumsum(size)
        spot = behind - size + head
        body = np.zeros(int(behind[-1]) if len(plain) else 0, np.uint8)
        body[spot[plain]] = joined.bytes[bytes_at]
        pair, at = far << 4 | length - 3, spot[~plain]
        body[at], body[at + 1] = pair >> 8, pair & 255
        if len(plain):
            body[spot[head] - 1] = np.add.reduceat(plain << nth, np.flatnonzero(head))
        start = 0
        for n, stop in zip(joined.sizes.tolist(), np.concatenate([[0], behind])[cuts].tolist()):
            out.append(blocks.varint(n) + body[start:stop].tobytes())
            start = stop
    return out


def lz77_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    return [b for first, last in parts(blobs) for b in _lz77_decode(blobs[first:last], limit)]


def _resolved(value: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Every byte from the place where copying of copies began; that place is its own source."""
    while True:
        further = source[source]
        if (further == source).all():
            return value[source]
        source = further


def _take_varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers at the places, places behind them); -1 for one of more than five bytes."""
    byte = data[at]
    value, at = (byte & 127).astype(np.int64), at + 1
    more = np.flatnonzero(byte > 127)
    for shift in range(7, 35, 7):
        if not len(more):
            break
        byte = data[at[more]]
        value[more] |= (byte & 127).astype(np.int64) << shift
        at[more] += 1
        more = more[byte > 127]
    value[more] = -1
    return value, at


def _lz77_turns(blob: bytes, at: int, start: int) -> list[int]:
    """Where the turns of a stream begin, the last being a run that ends with the stream; none if the stream ends otherwise."""
    walk, end = [], len(blob)
    try:
        while True:
            walk.append(start + at)
            run = blob[at]
            at += 1
            if run > 127:
                run, at = blocks.take_varint(blob, at - 1)
            at += run
            if at >= end:
                return walk if at == end else []
            while blob[at] > 127:
                at += 1
            at += 1
            while blob[at] > 127:
                at += 1
            at += 1
    except (IndexError, ValueError):
        return []


def _lz77_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    """Turns are found blob by blob; every byte of the output then takes its value from where its matches lead."""
    joined = Joined(blobs)
    walk, sizes, stops = [], [], []
    for blob, start in zip(blobs, joined.starts.tolist()):
        n, at = _prepared(blob, limit) or (0, 0)
        turns = _lz77_turns(blob, at, start) if n else []
        walk += turns
        sizes.append(n)
        stops.append(len(walk))
    stop = np.array(stops, np.int64)
    last = stop[np.diff(stop, prepend=0) > 0] - 1
    match = np.ones(len(walk), bool)
    match[last] = False
    run, at = _take_varints(joined.bytes, np.array(walk, np.int64))
    length, far = np.zeros(len(walk), np.int64), np.zeros(len(walk), np.int64)
    length[match], behind = _take_varints(joined.bytes, (at + run)[match])
    far[match], _ = _take_varints(joined.bytes, behind)
    # A stream that does not fit its length is for the decoder of one blob to judge, before anything is made of its numbers.
    blob_of = np.repeat(np.arange(len(blobs)), np.diff(stop, prepend=0))
    total = np.bincount(blob_of, run + length, len(blobs))
    done = np.cumsum(run + length) - length
    first = np.concatenate([[0], np.cumsum(run + length)])[np.concatenate([[0], stop[:-1]])]
    wrong = match & ((far < 1) | (far > done - first[blob_of])) | (run < 0) | (length < 0)
    good = (total == sizes) & (np.array(sizes) > 0) & (np.bincount(blob_of, wrong, len(blobs)) == 0)
    kept = good[blob_of]
    run, at, length, far = run[kept], at[kept], length[kept], far[kept]
    spot = np.cumsum(run + length) - length  # where a match goes
    size = int((run + length).sum())
    before = np.cumsum(run) - run
    plain = np.arange(int(run.sum()))
    value, source = np.zeros(size, np.uint8), np.arange(size)
    source -= np.repeat(np.stack([np.zeros(len(run), np.int64), far], 1).ravel(), np.stack([run, length], 1).ravel())
    value[plain + np.repeat(spot - run - before, run)] = joined.bytes[plain + np.repeat(at - before, run)]
    data, out, start = _resolved(value, source).tobytes(), [], 0
    for blob, n, fits in zip(blobs, sizes, good.tolist()):
        out.append(data[start : start + n] if fits else _alone(blocks.lz77_decode, blob, limit))
        start += n * fits
    return out


def lzss_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    return [b for first, last in parts(blobs) for b in _lzss_decode(blobs[first:last], limit)]


def _lzss_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    """Groups are found blob by blob, their items together; every byte of the output then takes its value from where its matches lead."""
    joined = Joined(blobs)
    widths = (17 - np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(int)).tolist()
    walk, heads = [], []
    for blob, start in zip(blobs, joined.starts.tolist()):
        n, at = _prepared(blob, limit) or (0, len(blob))
        heads.append((n, len(walk)))
        while at < len(blob):
            walk.append(start + at)
            at += widths[blob[at]]
    group = np.array(walk, np.int64)
    counts = np.diff([g for _, g in heads], append=len(walk))
    blob_of = np.repeat(np.arange(len(blobs)), counts)
    plain = (joined.bytes[group][:, None] >> np.arange(8) & 1).astype(bool)
    width = 2 - plain
    at = (group[:, None] + 1 + np.cumsum(width, 1) - width).ravel()
    blob_of, plain, width = np.repeat(blob_of, 8), plain.ravel(), width.ravel()
    whole = at + width <= joined.ends[blob_of]  # the last group of a blob is not always full
    at, blob_of, plain = at[whole], blob_of[whole], plain[whole]
    pair = joined.bytes[at].astype(np.int64) << 8 | joined.bytes[at + 1]
    size = np.where(plain, 1, (pair & 15) + 3)
    behind = np.cumsum(size)
    total = int(behind[-1]) if len(size) else 0
    spot = behind - size
    # Of every byte, the place that it is copied from; bytes in the stream are their own source.
    source = np.arange(total) - np.repeat(np.where(plain, 0, pair >> 4), size)
    items = np.concatenate([[0], np.cumsum(np.bincount(blob_of, minlength=len(blobs)))])
    edges = np.concatenate([spot, [total]])
    begin, end = edges[items[:-1]], edges[items[1:]]
    bad = np.zeros(len(blobs), bool)
    wrong = ~plain & ((pair >> 4 == 0) | (pair >> 4 > spot - begin[blob_of]))
    bad[blob_of[wrong]] = True
    value = np.zeros(total, np.uint8)
    value[spot[plain]] = joined.bytes[at[plain]]
    np.maximum(source, 0, out=source)
    value = _resolved(value, source)
    out: list[bytes | None] = []
    for blob, (n, _), b, e, broken in zip(blobs, heads, begin.tolist(), end.tolist(), bad.tolist()):
        # Broken streams, and bytes behind the end, are for the decoder of one blob to judge.
        out.append(_alone(blocks.lzss_decode, blob, limit) if broken or not n or e - b < n or e - b > n + 18 else value[b : b + n].tobytes())
    return out


def rle_encode(blobs: Sequence[bytes]) -> list[bytes]:
    """(count, value) pairs, counts up to 255."""
    out = []
    for first, last in parts(blobs):
        joined = Joined(blobs[first:last])
        v = joined.bytes[: joined.n]
        new = np.ones(joined.n, bool)
        new[1:] = v[1:] != v[:-1]
        new[joined.starts[joined.sizes > 0]] = True
        begin = np.flatnonzero(new)
        runs = np.diff(begin, append=joined.n)
        pieces = -(-runs // 255)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pairs = np.empty((len(nth), 2), np.uint8)
        pairs[:, 0] = np.minimum(np.repeat(runs, pieces) - 255 * nth, 255)
        pairs[:, 1] = np.repeat(v[begin], pieces)
        stops = np.concatenate([[0], np.cumsum(pieces)])[begin.searchsorted(joined.ends)].tolist()
        start = 0
        for stop in stops:
            out.append(pairs[start:stop].tobytes())
            start = stop
    return out


#: Bytes of a rotation that are compared first; with the blob's number they fill a word.
_ROTATED = 6


def rotations(blobs: Sequence[bytes]) -> np.ndarray:
    """The starts of each blob's sorted rotations, blob after blob, counted from the first blob's start; equal rotations by their start.

    Only rotations that are equal so far are compared on, over twice the length.
    """
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    start, size, blob = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes), np.repeat(np.arange(len(blobs)), sizes)
    wrapped = b"".join(piece for b in blobs for piece in (b, (b[:8] * 8)[:8].ljust(8))) + bytes(8)
    word = np.ndarray((len(wrapped) - 8,), ">u8", wrapped, 0, (1,))[np.arange(n) + 8 * blob].astype(np.uint64)
    key = blob.astype(np.uint64) << np.uint64(8 * _ROTATED) | word >> np.uint64(64 - 8 * _ROTATED)
    order = np.argsort(key)
    spots, rank, length = np.arange(n), np.empty(n, np.int64), _ROTATED
    inside = order
    key = key[order]
    while len(spots):
        new = np.ones(len(spots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[inside] = spots[np.maximum.accumulate(np.where(new, np.arange(len(spots)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = spots[tied]
        inside = order[spots]
        equal = size[inside] <= length
        if equal.any():
            at = inside[equal]
            order[spots[equal]] = at[np.lexsort((at, rank[at]))]
            spots, inside = spots[~equal], inside[~equal]
        turned = start[inside] + (inside - start[inside] + length) % size[inside]
        key = rank[inside].astype(np.uint64) << np.uint64(32) | rank[turned].astype(np.uint64)
        turn = np.argsort(key)
        key, inside = key[turn], inside[turn]
        order[spots] = inside
        length *= 2
    return order


def bwt_encode(blobs: Sequence[bytes]) -> list[bytes]:
    out = []
    for first, last in parts(blobs):
        for a in range(first, last, 1 << 16):  # numbers of blobs have sixteen bits
            some = blobs[a : min(last, a + (1 << 16))]
            joined = Joined(some)
            if not joined.n:
                out += [bytes(4)] * len(some)
                continue
            order = rotations(some)
            before = order - 1
            full = joined.sizes > 0
            heads = np.flatnonzero(order == joined.each(joined.starts))
            before[heads] = joined.ends[full] - 1
            last_bytes, index = joined.bytes[before], np.zeros(len(some), np.int64)
            index[full] = heads - joined.starts[full]
            out += [i.to_bytes(4, "little") + last_bytes[s:e].tobytes() for i, s, e in zip(index.tolist(), joined.starts.tolist(), joined.ends.tolist())]
    return out


#: Blobs that step side by side, and the fewest for which that pays.
SIDE_BLOBS, FEW = 2048, 40


def lanes(sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(numbers of the blobs, longest first; stretches of steps as (from, to, how many of them still run)), down to FEW."""
    order = np.argsort(-sizes, kind="stable")
    size, done, stretches = sizes[order].tolist(), 0, []
    for running in range(len(size), FEW - 1, -1):
        if size[running - 1] > done:
            stretches.append((done, size[running - 1], running))
            done = size[running - 1]
    return order, stretches


def groups(blobs: Sequence[bytes]) -> Iterator[list[int]]:
    """Numbers of the blobs by length, SIDE_BLOBS at a time."""
    order = sorted(range(len(blobs)), key=lambda i: -len(blobs[i]))
    for i in range(0, len(order), SIDE_BLOBS):
        yield order[i : i + SIDE_BLOBS]


def side_by_side(function: Callable[[list[bytes]], list]) -> Callable[[Sequence[bytes]], list]:
    """``function`` for the blobs in groups of like length."""

    def run(blobs: Sequence[bytes]) -> list:
        out: list = [None] * len(blobs)
        for group in groups(blobs):
            for i, found in zip(group, function([blobs[i] for i in group])):
                out[i] = found
        return out

    return run


def shares(blob: bytes) -> np.ndarray:
    """``blocks.shares``."""
    counts = np.bincount(np.frombuffer(blob, np.uint8), minlength=256)
    if not blob:
        return counts
    out = np.where(counts, np.maximum(counts * blocks._ALL // len(blob), 1), 0)
    over = int(out.sum()) - blocks._ALL
    if over > 0:
        order = np.argsort(-out, kind="stable")
    while over > 0:
        less = order[out[order] > 1][:over]
        out[less] -= 1
        over -= len(less)
    out[int(np.argmax(out))] -= over
    return out


@side_by_side
def rans_encode(blobs: list[bytes]) -> list[bytes]:
    joined = Joined(blobs)
    order, stretches = lanes(joined.sizes)
    share = np.array([shares(b) for b in blobs], np.uint32).reshape(-1, 256)
    first = np.cumsum(share, 1, dtype=np.uint32) - share
    both = (first << 16 | share).ravel()
    room = 2 * joined.sizes + 8
    stop = np.cumsum(room)
    buffer = np.zeros(int(stop[-1]), np.uint8)
    place, table, at, state = joined.ends[order] - 1, order * 256, stop[order] - 1, np.full(len(blobs), 1 << 23, np.uint32)
    for begin, end, running in stretches:
        p, base, spot, x = place[:running], table[:running], at[:running], state[:running]
        for _ in range(end - begin):
            pair = both[base + joined.bytes[p]]
            n = pair & 0xFFFF
            full = n << (31 - blocks._BITS)
            out = x >= full
            while out.any():
                buffer[spot] = x  # a byte that is not moved out is written over
                spot -= out
                x >>= out * np.uint32(8)
                out = x >= full
            quotient = x // n
            x += quotient * (np.uint32(blocks._ALL) - n) + (pair >> 16)
            p -= 1
    result: list[bytes] = [b""] * len(blobs)
    for i, left, x, spot in zip(order.tolist(), (place - joined.starts[order] + 1).tolist(), state.tolist(), (at + 1).tolist()):
        if not blobs[i]:
            result[i] = blocks.varint(0)
            continue
        head = blocks.varint(len(blobs[i])) + share[i].astype("<u2").tobytes()
        x, more = blocks.rans_put(x, blobs[i][:left], share[i].tolist(), first[i].tolist()) if left else (x, b"")
        result[i] = head + x.to_bytes(4, "big") + bytes(reversed(more)) + buffer[spot : stop[i]].tobytes()
    return result


def _prepared(data: bytes, limit: int) -> tuple[int, int] | None:
    """(length of the output, place of the code) of a stream that begins well."""
    try:
        return blocks._length(data, limit)
    except ValueError:
        return None


def _alone(decode: Callable[[bytes, int], bytes], data: bytes, limit: int) -> bytes | None:
    try:
        return decode(data, limit)
    except Exception:  # a decoder may fail in any way on any bytes
        return None


def _grouped(function: Callable[[list[bytes], int], list], blobs: Sequence[bytes], limit: int) -> list:
    return side_by_side(lambda some: function(some, limit))(blobs)


def rans_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    return _grouped(_rans_decode, blobs, limit)


def _rans_decode(blobs: list[bytes], limit: int) -> list[bytes | None]:
    result: list[bytes | None] = [None] * len(blobs)
    fit, shares_of = [], []
    for i, blob in enumerate(blobs):
        head = _prepared(blob, limit)
        share = np.frombuffer(blob[head[1] : head[1] + 512], "<u2") if head and len(blob) >= head[1] + 516 else None
        if share is None or not head[0] or share.sum(dtype=np.int64) != blocks._ALL:
            result[i] = _alone(blocks.rans_decode, blob, limit)
        else:
            fit.append((i, *head))
            shares_of.append(share)
    if not fit:
        return result
    joined = Joined([blobs[i] for i, _, _ in fit])
    sizes = np.array([n for _, n, _ in fit], np.int64)
    order, stretches = lanes(sizes)
    share = np.array(shares_of).astype(np.uint32)
    first = np.cumsum(share, 1, dtype=np.uint32) - share
    both = (first << 16 | share).ravel()
    symbol = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(fit)), share.ravel())
    heads = joined.starts + np.array([at + 512 for _, _, at in fit])
    state = (joined.words()[heads].byteswap() >> np.uint64(32)).astype(np.uint32)[order]
    place, stop = heads[order] + 4, joined.ends[order]
    stops = np.cumsum(sizes)
    out = np.empty(int(stops[-1]), np.uint8)
    wide, table, to, last = order << 12, order << 8, (stops - sizes)[order], joined.n + _PAD - 1
    cut = np.zeros(len(fit), bool)
    for begin, end, running in stretches:
        x, p, w, t, o, s = state[:running], place[:running], wide[:running], table[:running], to[:running], stop[:running]
        for _ in range(end - begin):
            low = x & np.uint32(blocks._ALL - 1)
            b = symbol[w + low]
            out[o] = b
            pair = both[t + b]
            x >>= np.uint32(blocks._BITS)
            x *= pair & np.uint32(0xFFFF)
            x += low
            x -= pair >> np.uint32(16)
            o += 1
            small = x < 1 << 23
            while small.any():
                small &= p < s
                if not small.any():
                    break
                np.copyto(x, x << np.uint32(8) | joined.bytes[np.minimum(p, last)], where=small)
                p += small
                small = x < 1 << 23
        cut[:running] |= x < 1 << 23
    ends = stops.tolist()
    for j, x, p, o, bad in zip(order.tolist(), state.tolist(), place.tolist(), to.tolist(), cut.tolist()):
        i, n, at = fit[j]
        if bad:  # bytes ran out: at the end of the data, or before it
            result[i] = _alone(blocks.rans_decode, blobs[i], limit)
            continue
        whole = out[ends[j] - n : o].tobytes()
        if o < ends[j]:
            rest = _alone(lambda data, _, x=x, p=p, j=j, m=ends[j] - o: blocks.rans_take(x, data, p - int(joined.starts[j]), m, share[j].tolist(), first[j].tolist(), symbol[j << 12 : j + 1 << 12].tolist()), blobs[i], limit)
            result[i] = None if rest is None else whole + rest
        else:
            result[i] = whole
    return result


def bwt_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    return _grouped(_bwt_decode, blobs, limit)


def _bwt_decode(blobs: list[bytes], limit: int) -> list[bytes | None]:
    result: list[bytes | None] = [None] * len(blobs)
    fit = []
    for i, blob in enumerate(blobs):
        index = int.from_bytes(blob[:4], "little")
        if index < len(blob) - 4:
            fit.append((i, index))
        else:
            result[i] = b"" if len(blob) == 4 else None
    if not fit:
        return result
    joined = Joined([blobs[i][4:] for i, _ in fit])  # whole: a start of the text needs all of its last bytes
    follow = np.empty(joined.n, np.int32)
    for s, e in zip(joined.starts.tolist(), joined.ends.tolist()):
        follow[s:e] = np.argsort(joined.bytes[s:e], kind="stable")
        follow[s:e] += s
    order, stretches = lanes(joined.sizes)
    at, to = (joined.starts + np.array([index for _, index in fit]))[order], joined.starts[order]
    walk = np.empty(joined.n, np.int32)
    for begin, end, running in stretches:
        a, o = at[:running], to[:running]
        for _ in range(end - begin):
            a[:] = follow[a]
            walk[o] = a
            o += 1
    for j, a, o in zip(order.tolist(), at.tolist(), to.tolist()):
        start, end = int(joined.starts[j]), int(joined.ends[j])
        if o < end:
            way, steps, a = [], (follow[start:end] - start).tolist(), a - start
            for _ in range(end - o):
                a = steps[a]
                way.append(a)
            walk[o:end] = way
            walk[o:end] += start
    out = joined.bytes[walk]
    for (i, _), start, end in zip(fit, joined.starts.tolist(), joined.ends.tolist()):
        result[i] = out[start : min(end, start + limit)].tobytes()
    return result


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each byte value as ``blocks.huffman_lengths`` has them, 0 of one that does not occur."""
    out = np.zeros(256, np.uint8)
    live = np.flatnonzero(counts).tolist()
    if len(live) < 2:
        out[live] = 1
        return out
    heap = [(n, s, i) for i, (n, s) in enumerate(zip(counts[live].tolist(), live))]
    heapq.heapify(heap)
    above = [0] * (2 * len(live) - 1)
    for node in range(len(live), len(above)):
        a, first, x = heapq.heappop(heap)
        b, _, y = heap[0]
        heapq.heapreplace(heap, (a + b, first, node))
        above[x] = above[y] = node
    depth = [0] * len(above)
    for node in range(len(above) - 2, -1, -1):
        depth[node] = depth[above[node]] + 1
    out[live] = depth[: len(live)]
    return out


#: Longest prefix codes for which arrays are made; blobs with longer ones are coded alone.
CODE_BITS = 16


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes of ``blocks.canonical``, as numbers."""
    out = np.zeros(256, np.uint64)
    live = np.flatnonzero(lengths)
    by = live[np.argsort(lengths[live], kind="stable")]
    size = lengths[by].astype(np.int64)
    parts_of = 1 << CODE_BITS - size
    out[by] = np.cumsum(parts_of) - parts_of >> CODE_BITS - size
    return out


def huffman_encode(blobs: Sequence[bytes]) -> list[bytes]:
    out = []
    for first, last in parts(blobs):
        some = blobs[first:last]
        joined = Joined(some)
        lengths = np.array([code_lengths(np.bincount(np.frombuffer(b, np.uint8), minlength=256)) for b in some])
        short = lengths.max(1) <= CODE_BITS
        codes = np.array([canonical_codes(n) if ok else np.zeros(256, np.uint64) for n, ok in zip(lengths, short.tolist())])
        row = joined.each(np.arange(len(some)) << 8) + joined.bytes[: joined.n]
        size = lengths.ravel()[row].astype(np.int64)
        behind = np.concatenate([[0], np.cumsum(size)])
        bits = behind[joined.ends] - behind[joined.starts]
        words = (bits + 31 >> 5) + 1
        base = np.cumsum(words) - words
        at = behind[:-1] + joined.each((base << 5) - behind[joined.starts])
        spot = at >> 5
        code = codes.ravel()[row] << (64 - size - (at & 31) & 63).astype(np.uint64)
        total = int(words.sum()) + 1
        packed = np.bincount(spot, (code >> np.uint64(32)).astype(np.float64), total) + np.bincount(spot + 1, (code & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
        packed = packed.astype(">u4").tobytes()
        for i, (blob, begin, n) in enumerate(zip(some, (4 * base).tolist(), bits.tolist())):
            if not short[i]:
                out.append(blocks.BLOCKS["Huffman"][0](blob))
                continue
            live = np.flatnonzero(lengths[i])
            table = np.stack([live, lengths[i][live]], 1).astype(np.uint8).tobytes()
            out.append(blocks.varint(len(blob)) + blocks.varint(len(live)) + table + packed[begin : begin + (n + 7 >> 3)])
    return out


def huffman_decode(blobs: Sequence[bytes], limit: int) -> list[bytes | None]:
    return _grouped(_huffman_decode, blobs, limit)


def _huffman_decode(blobs: list[bytes], limit: int) -> list[bytes | None]:
    alone = blocks.BLOCKS["Huffman"][1]
    result: list[bytes | None] = [None] * len(blobs)
    fit, tables, base = [], [], 0
    for i, blob in enumerate(blobs):
        made = _code_table(blob, limit)
        if made is None:
            result[i] = _alone(alone, blob, limit)
            continue
        n, at, longest_code, table = made
        fit.append((i, n, at, longest_code, base))
        tables.append(table)
        base += len(table)
    if not fit:
        return result
    joined = Joined([blobs[i] for i, *_ in fit])
    word = np.ndarray((joined.n + _PAD - 8,), ">u4", joined.data, 0, (1,)).astype(np.uint32)
    sizes = np.array([f[1] for f in fit], np.int64)
    order, stretches = lanes(sizes)
    table = np.concatenate(tables)
    bit = ((joined.starts + np.array([f[2] for f in fit])) << 3)[order]
    shift, begin_of = (32 - np.array([f[3] for f in fit], np.uint32))[order].astype(np.uint32), np.array([f[4] for f in fit])[order]
    stops = np.cumsum(sizes)
    out, to, most = np.empty(int(stops[-1]), np.uint8), (stops - sizes)[order], joined.n + _PAD - 9
    for begin, end, running in stretches:
        p, s, t, o = bit[:running], shift[:running], begin_of[:running], to[:running]
        for _ in range(end - begin):
            x = word[np.minimum(p >> 3, most)]
            x <<= (p & 7).astype(np.uint32)
            x >>= s
            found = table[t + x]
            out[o] = found
            p += found >> 8
            o += 1
    limits = (joined.ends << 3)[order].tolist()
    for j, p, o, most_bits in zip(order.tolist(), bit.tolist(), to.tolist(), limits):
        i, n, at, longest_code, _ = fit[j]
        stop = int(stops[j])
        if o < stop or p > most_bits:
            result[i] = _alone(alone, blobs[i], limit)  # the longest blobs, and streams that end early
        else:
            result[i] = out[stop - n : stop].tobytes()
    return result


def _code_table(blob: bytes, limit: int) -> tuple[int, int, int, np.ndarray] | None:
    """(length of the output, place of the bits, bits of the longest code, byte value and bits of the code by what comes next) of whole codes."""
    try:
        n, at = blocks._length(blob, limit)
        count, at = blocks.take_varint(blob, at)
    except ValueError:
        return None
    pairs = np.frombuffer(blob[at : at + 2 * count], np.uint8)
    if not n or not count or count > 256 or len(pairs) < 2 * count:
        return None
    symbols, lengths = pairs[::2].astype(np.int64), pairs[1::2].astype(np.int64)
    most = int(lengths.max())
    if lengths.min() < 1 or most > CODE_BITS or len(np.unique(symbols)) < count:
        return None
    by = np.lexsort((symbols, lengths))
    room = 1 << most - lengths[by]
    if room.sum() != 1 << most:  # codes that are not whole: one value alone, or a broken table
        return None
    return n, at + 2 * count, most, np.repeat((symbols[by] | lengths[by] << 8).astype(np.uint16), room)


#: Encoders of many blobs, and decoders where blobs side by side are faster than one by one.
ENCODERS: dict[str, Callable[[Sequence[bytes]], list[bytes]]] = {"RLE": rle_encode, "BWT": bwt_encode, "Huffman": huffman_encode, "rANS": rans_encode, "LZ77": lz77_encode, "LZSS": lzss_encode}
DECODERS: dict[str, Callable[[Sequence[bytes], int], list[bytes | None]]] = {"BWT": bwt_decode, "Huffman": huffman_decode, "rANS": rans_decode, "LZ77": lz77_decode, "LZSS": lzss_decode}
