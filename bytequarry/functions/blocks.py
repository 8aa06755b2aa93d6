"""More codecs: prefix codes, arithmetic coders and dictionary coders over bytes.

The streams are this library's own: the length of the output as a varint, what the
decoder must know, then the code. They are plain Python, some tenths of a
microsecond to a few microseconds a byte, for blobs of a trial or a benchmark;
corpora are packed with the native codecs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

Encode, Decode = Callable[[bytes], bytes], Callable[[bytes, int], bytes]


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes((*out, value))


def take_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _length(data: bytes, limit: int) -> tuple[int, int]:
    n, at = take_varint(data, 0)
    if n > limit:
        raise ValueError("the output is above the limit")
    return n, at


def pack_bits(bits: str) -> bytes:
    whole = bits + "0" * (-len(bits) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big") if whole else b""


# Prefix codes: a bit string for every byte value.


class _Reader:
    """Reads a prefix code a byte at a time: a table of (node, byte) that fills as it is used."""

    def __init__(self, codes: dict[int, str]):
        self.nodes: list[dict[str, int]] = [{}]  # bit -> node, or -1 - symbol
        for symbol, code in codes.items():
            node = 0
            for bit in code[:-1]:
                node = self.nodes[node].setdefault(bit, len(self.nodes))
                if node < 0:
                    raise ValueError("no prefix code")
                if node == len(self.nodes):
                    self.nodes.append({})
            if code[-1] in self.nodes[node]:
                raise ValueError("no prefix code")
            self.nodes[node][code[-1]] = -1 - symbol
        self.table: dict[int, tuple[bytes, int]] = {}

    def _fill(self, node: int, byte: int) -> tuple[bytes, int]:
        out = bytearray()
        for bit in f"{byte:08b}":
            node = self.nodes[node].get(bit, -1000) if node >= 0 else -1000
            if -257 < node < 0:
                out.append(-1 - node)
                node = 0
        return bytes(out), node

    def read(self, data: bytes, n: int) -> bytes:
        out, node, table = bytearray(), 0, self.table
        for byte in data:
            if len(out) >= n:
                break
            key = node << 8 | byte
            found = table.get(key)
            if found is None:
                found = table[key] = self._fill(node, byte)
            out += found[0]
            node = found[1]
            if node < 0 and len(out) < n:
                raise ValueError("a code that stands for nothing")
        if len(out) < n:
            raise ValueError("the stream ends early")
        return bytes(out[:n])


def _static(code_of: Callable[[int], str]) -> tuple[Encode, Decode]:
    """A fixed code of the numbers 1 to 256 (a byte value and one)."""

    @lru_cache(maxsize=1)
    def codes() -> dict[int, str]:
        return {b: code_of(b + 1) for b in range(256)}

    def encode(data: bytes) -> bytes:
        return varint(len(data)) + pack_bits("".join(map(codes().__getitem__, data)))

    def decode(data: bytes, limit: int) -> bytes:
        n, at = _length(data, limit)
        return _Reader(codes()).read(data[at:], n)

    return encode, decode


def unary(n: int) -> str:
    return "1" * (n - 1) + "0"


def elias_gamma(n: int) -> str:
    return "0" * (n.bit_length() - 1) + f"{n:b}"


def elias_delta(n: int) -> str:
    return elias_gamma(n.bit_length()) + f"{n:b}"[1:]


def exp_golomb(n: int, k: int = 2) -> str:
    high, low = divmod(n - 1, 1 << k)
    return elias_gamma(high + 1) + f"{low:0{k}b}"


def rice(n: int, k: int = 4) -> str:
    high, low = divmod(n - 1, 1 << k)
    return unary(high + 1) + f"{low:0{k}b}"


def fibonacci(n: int) -> str:
    """The sum of distant Fibonacci numbers, smallest first, and a one behind the last."""
    steps = [1, 2]
    while steps[-1] <= n:
        steps.append(steps[-1] + steps[-2])
    bits, started = "", False
    for step in reversed(steps[:-1]):
        if step <= n:
            n, started, bits = n - step, True, bits + "1"
        elif started:
            bits += "0"
    return bits[::-1] + "1"


def levenshtein(n: int) -> str:
    """Lengths of lengths in unary, for the number less one."""
    value, bits, count = n - 1, "", 0
    if value == 0:
        return "0"
    while value:
        bits, count = f"{value:b}"[1:] + bits, count + 1
        value = value.bit_length() - 1
    return "1" * count + "0" + bits


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol in an optimal prefix code; one symbol alone has one bit."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, [s]) for s, n in counts.items()]
    heapq.heapify(heap)
    lengths = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, first, x = heapq.heappop(heap)
        b, _, y = heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, first, x + y))
    return lengths


def shannon_fano_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Bits of each symbol when sorted symbols are halved by weight again and again."""
    lengths: dict[int, int] = {}
    todo = [(sorted(counts, key=lambda s: (-counts[s], s)), 0)]
    while todo:
        symbols, depth = todo.pop()
        if len(symbols) <= 1:
            lengths |= {s: max(1, depth) for s in symbols}
            continue
        sums = list(accumulate(counts[s] for s in symbols))
        cut = min(range(1, len(symbols)), key=lambda i: abs(2 * sums[i - 1] - sums[-1]))
        todo += [(symbols[:cut], depth + 1), (symbols[cut:], depth + 1)]
    return lengths


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    """Codes by length, then symbol, counting up."""
    code, before, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - before
        if code >> length:
            raise ValueError("more codes than the lengths have room for")
        out[symbol] = f"{code:0{length}b}"
        code, before = code + 1, length
    return out


def _measured(lengths_of: Callable[[dict[int, int]], dict[int, int]]) -> tuple[Encode, Decode]:
    """A code of the data's own lengths: the number of symbols, each with its length, then the bits."""

    def encode(data: bytes) -> bytes:
        lengths = lengths_of(Counter(data)) if data else {}
        codes = canonical(lengths)
        return varint(len(data)) + varint(len(lengths)) + b"".join(bytes(x) for x in sorted(lengths.items())) + pack_bits("".join(map(codes.__getitem__, data)))

    def decode(data: bytes, limit: int) -> bytes:
        n, at = _length(data, limit)
        count, at = take_varint(data, at)
        pairs = data[at : at + 2 * count]
        if len(pairs) < 2 * count or count > 256 or 0 in pairs[1::2]:
            raise ValueError("no table of lengths")
        return _Reader(canonical(dict(zip(pairs[::2], pairs[1::2])))).read(data[at + 2 * count :], n)

    return encode, decode


# Arithmetic coders: shares of the byte values in 4096ths come first.
_BITS = 12
_ALL = 1 << _BITS


def shares(data: bytes) -> list[int]:
    """Shares of the byte values that sum to 4096, none of a value that occurs being 0."""
    counts = Counter(data)
    if not counts:
        return [0] * 256
    out = [0] * 256
    for b, n in counts.items():
        out[b] = max(1, n * _ALL // len(data))
    over = sum(out) - _ALL
    if over > 0:
        for b in sorted(counts, key=lambda b: (-out[b], b)) * _ALL:
            if over <= 0:
                break
            over -= out[b] > 1
            out[b] -= out[b] > 1
    out[max(counts, key=lambda b: (out[b], -b))] -= over
    return out


def _table(share: list[int]) -> bytes:
    return b"".join(x.to_bytes(2, "little") for x in share)


def _take_table(data: bytes, at: int) -> tuple[list[int], list[int], list[int], int]:
    """(shares, starts, symbol of each 4096th, place behind)."""
    share = [int.from_bytes(data[i : i + 2], "little") for i in range(at, at + 512, 2)]
    if sum(share) != _ALL:
        raise ValueError("no table of shares")
    starts = [0, *accumulate(share)][:256]
    return share, starts, [b for b in range(256) for _ in range(share[b])], at + 512


def rans_put(state: int, data: bytes, share: list[int], starts: list[int]) -> tuple[int, bytearray]:
    """The state behind the data, last symbol first, and the bytes that went out."""
    out = bytearray()
    for b in reversed(data):
        n = share[b]
        while state >= (1 << 31 - _BITS) * n:
            out.append(state & 255)
            state >>= 8
        state = (state // n << _BITS) + state % n + starts[b]
    return state, out


def rans_encode(data: bytes) -> bytes:
    """A range asymmetric numeral system: the last symbol first, bytes out whenever the state gets too large."""
    if not data:
        return varint(0)
    share = shares(data)
    state, out = rans_put(1 << 23, data, share, [0, *accumulate(share)])
    return varint(len(data)) + _table(share) + state.to_bytes(4, "big") + bytes(reversed(out))


def rans_take(state: int, data: bytes, at: int, n: int, share: list[int], starts: list[int], symbol: list[int]) -> bytes:
    """The next ``n`` symbols of a state and the bytes from a place on."""
    out = bytearray()
    for _ in range(n):
        low = state & _ALL - 1
        b = symbol[low]
        out.append(b)
        state = share[b] * (state >> _BITS) + low - starts[b]
        while state < 1 << 23:
            if at >= len(data):
                if len(out) == n:
                    break
                raise ValueError("the stream ends early")
            state, at = state << 8 | data[at], at + 1
    return bytes(out)


def rans_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    if not n:
        return b""
    share, starts, symbol, at = _take_table(data, at)
    return rans_take(int.from_bytes(data[at : at + 4], "big"), data, at + 4, n, share, starts, symbol)


def _interval(width: int, shift: int) -> tuple[Encode, Decode]:
    """A coder that narrows an interval of ``width`` bits and moves out ``shift`` bits at a time once its ends share them."""
    top, mask = 1 << width, (1 << width) - 1
    unit = 1 << shift

    def encode(data: bytes) -> bytes:
        if not data:
            return varint(0)
        share = shares(data)
        starts, low, span, digits = [0, *accumulate(share)], 0, top, []
        for b in data:
            step = span >> _BITS
            low, span = low + step * starts[b], step * share[b]
            if low >= top:  # carry
                low &= mask
                i = len(digits) - 1
                while digits[i] == unit - 1:
                    digits[i], i = 0, i - 1
                digits[i] += 1
            while span <= top >> shift:
                digits.append(low >> width - shift)
                low, span = low << shift & mask, span << shift
        for _ in range(-(-width // shift)):
            digits.append(low >> width - shift)
            low = low << shift & mask
        return varint(len(data)) + _table(share) + (bytes(digits) if shift == 8 else pack_bits("".join(map(str, digits))))

    def decode(data: bytes, limit: int) -> bytes:
        n, at = _length(data, limit)
        if not n:
            return b""
        share, starts, symbol, at = _take_table(data, at)
        rest = data[at:]
        digits = iter(rest) if shift == 8 else map(int, "".join(f"{x:08b}" for x in rest))
        value = 0
        for _ in range(width // shift):
            value = value << shift | next(digits, 0)
        span, out = top, bytearray()
        for _ in range(n):
            step = span >> _BITS
            place = value // step
            if place >= _ALL:
                raise ValueError("a place outside the interval")
            b = symbol[place]
            out.append(b)
            value, span = value - step * starts[b], step * share[b]
            while span <= top >> shift:
                value, span = value << shift | next(digits, 0), span << shift
        return bytes(out)

    return encode, decode


# Dictionary coders.
WINDOW, LEAST, CHAIN = 1 << 15, 4, 16


def _matches(data: bytes, window: int, least: int, most: int):
    """Greedy parts of the data: (place, distance, length), distance 0 for one byte as it is."""
    heads: dict[bytes, list[int]] = {}
    at = 0

    def remember(place: int) -> None:
        if place + least <= len(data):
            spots = heads.setdefault(data[place : place + least], [])
            spots.append(place)
            if len(spots) > 2 * CHAIN:
                del spots[:CHAIN]

    while at < len(data):
        best, far = 0, 0
        for spot in reversed(heads.get(data[at : at + least], ())[-CHAIN:]):
            if at - spot > window:
                break
            n = least
            limit = min(most, len(data) - at)
            while n < limit and data[spot + n] == data[at + n]:
                n += 1
            if n > best:
                best, far = n, at - spot
                if n == limit:
                    break
        best = min(best, most)
        yield at, far, best
        for place in range(at, at + max(1, best)):
            remember(place)
        at += max(1, best)


def _copy(out: bytearray, distance: int, length: int) -> None:
    if not 0 < distance <= len(out):
        raise ValueError("a distance before the start")
    for _ in range(-(-length // distance)):
        part = out[len(out) - distance :][: min(distance, length)]
        out += part
        length -= len(part)


def lz77_encode(data: bytes) -> bytes:
    """Runs of plain bytes and matches in turn: the run's length and bytes, the match's length and distance."""
    out, held = bytearray(varint(len(data))), bytearray()
    for at, far, n in _matches(data, WINDOW, LEAST, 1 << 16):
        if n:
            out += varint(len(held)) + held + varint(n) + varint(far)
            held.clear()
        else:
            held.append(data[at])
    return bytes(out + varint(len(held)) + held)


def lz77_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    out, end, size = bytearray(), len(data), 0
    while True:
        if at < end and data[at] < 128:
            run, at = data[at], at + 1
        else:
            run, at = take_varint(data, at)
        if at + run > end:
            raise ValueError("the stream ends early")
        if run:
            out += data[at : at + run]
            at += run
            size += run
        if size >= n:
            break
        if at < end and data[at] < 128:
            length, at = data[at], at + 1
        else:
            length, at = take_varint(data, at)
        if at + 1 < end and data[at + 1] < 128 <= data[at]:
            far, at = data[at] & 127 | data[at + 1] << 7, at + 2
        else:
            far, at = take_varint(data, at)
        if size + length > n:
            raise ValueError("a match behind the end")
        if length <= far <= size:
            out += out[size - far : size - far + length]
        else:
            _copy(out, far, length)
        size += length
    return bytes(out)


def lzss_encode(data: bytes) -> bytes:
    """Groups of eight: a byte of flags, then a plain byte (flag 1) or 12 bits of distance and 4 of length."""
    items = [(far, n) if n else data[at] for at, far, n in _matches(data, 4095, 3, 18)]
    out = bytearray(varint(len(data)))
    for i in range(0, len(items), 8):
        part = items[i : i + 8]
        out.append(sum(1 << k for k, x in enumerate(part) if isinstance(x, int)))
        for x in part:
            out += bytes((x,)) if isinstance(x, int) else (x[0] << 4 | x[1] - 3).to_bytes(2, "big")
    return bytes(out)


@lru_cache(maxsize=1)
def _flag_runs() -> list[tuple[int, ...]]:
    """For every byte of flags: lengths of runs of plain bytes, 0 for each pair."""
    out = []
    for flags in range(256):
        runs: list[int] = []
        for k in range(8):
            if not flags >> k & 1:
                runs.append(0)
            elif runs and runs[-1] and flags >> k - 1 & 1:
                runs[-1] += 1
            else:
                runs.append(1)
        out.append(tuple(runs))
    return out


def lzss_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    out, size, runs, whole, safe = bytearray(), 0, _flag_runs(), n - 8 * 18, len(data) - 16
    while size < n:
        flags, at = data[at], at + 1
        if size <= whole and at <= safe:  # neither the output nor the stream ends within this group
            for run in runs[flags]:
                if run:
                    out += data[at : at + run]
                    at += run
                    size += run
                    continue
                low = data[at + 1]
                far, length = data[at] << 4 | low >> 4, (low & 15) + 3
                at += 2
                if length <= far <= size:
                    out += out[size - far : size - far + length]
                else:
                    _copy(out, far, length)
                size += length
            continue
        for k in range(8):
            if len(out) >= n:
                break
            if flags >> k & 1:
                out.append(data[at])
                at += 1
            else:
                pair = int.from_bytes(data[at : at + 2], "big")
                if at + 2 > len(data):
                    raise ValueError("the stream ends early")
                _copy(out, pair >> 4, (pair & 15) + 3)
                at += 2
        size = len(out)
    return bytes(out[:n])


def lz78_encode(data: bytes) -> bytes:
    """Pairs of a known string's number (0: none) and the byte behind it."""
    known, out, node = {}, bytearray(varint(len(data))), 0
    for b in data:
        key = node, b
        if key in known:
            node = known[key]
        else:
            known[key] = len(known) + 1
            out += varint(node)
            out.append(b)
            node = 0
    return bytes(out + varint(node)) if node else bytes(out)


def lz78_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    out, known = bytearray(), [b""]
    while len(out) < n:
        number, at = take_varint(data, at)
        if number >= len(known):
            raise ValueError("a string that is not known yet")
        whole = known[number] + data[at : at + 1]
        at += 1
        known.append(whole)
        out += whole
    return bytes(out[:n])


def lzp_encode(data: bytes) -> bytes:
    """Where the last three bytes stood before tells what follows: lengths of right guesses, and the byte after each."""
    last, out, at = {}, bytearray(varint(len(data))), 0
    while at < len(data):
        spot, n = last.get(data[at - 3 : at]) if at >= 3 else None, 0
        if spot is not None:
            while at + n < len(data) and data[spot + n] == data[at + n]:
                n += 1
        for place in range(at, min(at + n + 1, len(data))):
            if place >= 3:
                last[data[place - 3 : place]] = place
        out += varint(n) + data[at + n : at + n + 1]
        at += n + 1
    return bytes(out)


def lzp_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    last, out = {}, bytearray()
    while len(out) < n:
        length, at = take_varint(data, at)
        here = len(out)
        if length:
            spot = last.get(bytes(out[-3:])) if here >= 3 else None
            if spot is None or here + length > n:
                raise ValueError("a guess without a context")
            _copy(out, here - spot, length)
        out += data[at : at + 1]
        at += 1
        for place in range(here, len(out)):
            if place >= 3:
                last[bytes(out[place - 3 : place])] = place
        if at > len(data) + 1:
            raise ValueError("the stream ends early")
    return bytes(out[:n])


def _pairs(symbols: list[int], rounds: int, next_symbol) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Replaces the most frequent neighbouring pair by a new symbol, round after round."""
    rules = []
    for _ in range(rounds):
        counts = Counter(zip(symbols, symbols[1:]))
        if not counts:
            break
        pair, n = min(counts.items(), key=lambda c: (-c[1], c[0]))
        new = next_symbol()
        if n < 4 or new is None:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
        rules.append((new, *pair))
    return symbols, rules


def _expand(symbols, rules: list[tuple[int, int, int]], limit: int) -> bytes:
    known: dict[int, bytes] = {}
    for new, a, b in rules:
        known[new] = known.get(a, bytes((a & 255,))) + known.get(b, bytes((b & 255,)))
        if len(known[new]) > limit:
            raise ValueError("the output is above the limit")
    return b"".join(known.get(s) or bytes((s,)) for s in symbols)


def bpe_encode(data: bytes) -> bytes:
    """Pairs become byte values that the data does not use."""
    free = iter(sorted(set(range(256)) - set(data)))
    symbols, rules = _pairs(list(data), 128, lambda: next(free, None))
    return varint(len(data)) + varint(len(rules)) + b"".join(map(bytes, rules)) + bytes(symbols)


def bpe_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    count, at = take_varint(data, at)
    if count > 256 or at + 3 * count > len(data):
        raise ValueError("no rules")
    rules = [tuple(data[i : i + 3]) for i in range(at, at + 3 * count, 3)]
    out = _expand(data[at + 3 * count :], rules, n)
    if len(out) != n:
        raise ValueError("the output has another length")
    return out


def repair_encode(data: bytes) -> bytes:
    """Pairs become symbols above 255."""
    numbers = iter(range(256, 1280))
    symbols, rules = _pairs(list(data), 1024, lambda: next(numbers, None))
    return varint(len(data)) + varint(len(rules)) + b"".join(varint(a) + varint(b) for _, a, b in rules) + b"".join(map(varint, symbols))


def repair_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    count, at = take_varint(data, at)
    rules, symbols = [], []
    for i in range(count):
        a, at = take_varint(data, at)
        b, at = take_varint(data, at)
        if max(a, b) >= 256 + i:
            raise ValueError("a rule before its parts")
        rules.append((256 + i, a, b))
    while at < len(data):
        s, at = take_varint(data, at)
        if s >= 256 + count:
            raise ValueError("a symbol without a rule")
        symbols.append(s)
    out = _expand(symbols, rules, n)
    if len(out) != n:
        raise ValueError("the output has another length")
    return out


def tunstall_encode(data: bytes) -> bytes:
    """Words of a tree that grows by the likeliest leaf, each of 12 bits."""
    if not data:
        return varint(0)
    share = shares(data)
    words = {w: i for i, w in enumerate(_tunstall_words(share))}
    out, held = [], b""
    for b in data:
        held += bytes((b,))
        if held in words:
            out.append(f"{words[held]:0{_BITS}b}")
            held = b""
    return varint(len(data)) + _table(share) + varint(len(held)) + held + pack_bits("".join(out))


def _tunstall_words(share: list[int]) -> list[bytes]:
    live = [b for b in range(256) if share[b]]
    leaves = [(-share[b], bytes((b,))) for b in live]
    heapq.heapify(leaves)
    while 1 < len(live) and len(leaves) + len(live) - 1 <= _ALL:
        weight, word = heapq.heappop(leaves)
        for b in live:
            heapq.heappush(leaves, (weight * share[b], word + bytes((b,))))
    return sorted(w for _, w in leaves)


def tunstall_decode(data: bytes, limit: int) -> bytes:
    n, at = _length(data, limit)
    if not n:
        return b""
    share, _, _, at = _take_table(data, at)
    count, at = take_varint(data, at)
    tail, rest = data[at : at + count], data[at + count :]
    words, bits = _tunstall_words(share), "".join(f"{x:08b}" for x in rest)
    out, i = bytearray(), 0
    while len(out) + len(tail) < n:
        number = int(bits[i : i + _BITS] or "0", 2)
        if i + _BITS > len(bits) or number >= len(words):
            raise ValueError("the stream ends early")
        out += words[number]
        i += _BITS
    return bytes(out + tail)


def dpcm_encode(data: bytes) -> bytes:
    """Differences to the straight line through the two bytes before, modulo 256."""
    return bytes((x - 2 * a + b) & 255 for x, a, b in zip(data, b"\0" + data, b"\0\0" + data))


def dpcm_decode(data: bytes, limit: int) -> bytes:
    out = bytearray(2)
    for x in data[:limit]:
        out.append((x + 2 * out[-1] - out[-2]) & 255)
    return bytes(out[2:])


BLOCKS: dict[str, tuple[Encode, Decode]] = {
    "Huffman": _measured(huffman_lengths), "ShannonFano": _measured(shannon_fano_lengths),
    "Unary": _static(unary), "EliasGamma": _static(elias_gamma), "EliasDelta": _static(elias_delta), "ExpGolomb": _static(exp_golomb), "Golomb": _static(rice),
    "Fibonacci": _static(fibonacci), "Levenshtein": _static(levenshtein), "Tunstall": (tunstall_encode, tunstall_decode),
    "rANS": (rans_encode, rans_decode), "Arithmetic": _interval(32, 1), "RangeCoding": _interval(32, 8),
    "LZ77": (lz77_encode, lz77_decode), "LZ78": (lz78_encode, lz78_decode), "LZSS": (lzss_encode, lzss_decode), "LZP": (lzp_encode, lzp_decode),
    "BPE": (bpe_encode, bpe_decode), "RePair": (repair_encode, repair_decode), "DPCM": (dpcm_encode, dpcm_decode),
}
