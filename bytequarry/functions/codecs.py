"""Codecs and transforms as pairs of functions over bytes, and the columns made of them.

A codec that fails on a blob gives null (or an error in ``trial``), never a
failed task; decoders stop at a stated output size, which keeps decompression
bombs out.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import zlib
from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash

from bytequarry.functions import blocks, kernels, many

ENCODERS: dict[str, Callable[[bytes], bytes]] = {}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {}


def codec(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes, int], bytes]) -> None:
    ENCODERS[name], DECODERS[name] = encode, decode


def _zlib(window: int):
    def encode(data: bytes) -> bytes:
        run = zlib.compressobj(6, zlib.DEFLATED, window)
        return run.compress(data) + run.flush()

    def decode(data: bytes, limit: int) -> bytes:
        run = zlib.decompressobj(window)
        out = run.decompress(data, limit)
        if not run.eof and not run.unconsumed_tail:
            raise ValueError("the stream ends early")
        return out

    return encode, decode


def _bounded(make):
    def decode(data: bytes, limit: int) -> bytes:
        run = make()
        out = run.decompress(data, limit)
        if not run.eof and run.needs_input:
            raise ValueError("the stream ends early")
        return out

    return decode


def _framed(name: str):
    """A codec of the Arrow library behind the length of its output, in eight bytes."""

    def decode(data: bytes, limit: int) -> bytes:
        size = int.from_bytes(data[:8], "little")
        if len(data) < 8 or size > limit:
            raise ValueError("no size, or one above the limit")
        return pa.decompress(data[8:], decompressed_size=size, codec=name, asbytes=True)

    return lambda data: len(data).to_bytes(8, "little") + pa.compress(data, codec=name, asbytes=True), decode


#: Dictionary of the Xz preset 6, how a block's header writes it, and the least one with which small blobs are packed.
XZ_DICTIONARY, XZ_DICTIONARY_MARK, XZ_LEAST = 8 << 20, 22, 1 << 16


def xz_encode(data: bytes) -> bytes:
    """The stream of preset 6, which states its dictionary of 8 MiB.

    The encoder clears tables of that dictionary's size for each stream, some five
    times what a small blob takes otherwise. Here they are as large as the blob,
    every byte of which is in reach all the same.
    """
    if not 0 < len(data) < XZ_DICTIONARY:
        return lzma.compress(data)
    out = bytearray(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": max(XZ_LEAST, len(data))}]))
    out[16] = XZ_DICTIONARY_MARK
    out[20:24] = zlib.crc32(out[12:20]).to_bytes(4, "little")  # behind the header's twelve bytes, a block header of eight
    return bytes(out)


codec("Deflate", *_zlib(-15))
codec("Zlib", *_zlib(15))
codec("Gzip", *_zlib(31))
codec("Bzip2", bz2.compress, _bounded(bz2.BZ2Decompressor))
codec("Xz", xz_encode, _bounded(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)))
codec("Lzma", lambda data: lzma.compress(data, lzma.FORMAT_ALONE), _bounded(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE)))
for _name in ("Zstd", "Lz4", "Snappy", "Brotli"):
    codec(_name, *_framed({"Lz4": "lz4_raw"}.get(_name, _name.lower())))


def rle_encode(data: bytes) -> bytes:
    from bytequarry.functions.strings import rle_pairs

    return rle_pairs(data)


def rle_decode(data: bytes, limit: int) -> bytes:
    if len(data) % 2 or 0 in data[::2]:
        raise ValueError("no pairs of a count and a value")
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()[:limit]


def delta_encode(data: bytes, distance: int = 1) -> bytes:
    v = np.frombuffer(data, np.uint8)
    return (v - np.concatenate([np.zeros(distance, np.uint8), v])[: len(v)]).tobytes()


def delta_decode(data: bytes, limit: int, distance: int = 1) -> bytes:
    v = np.frombuffer(data[:limit], np.uint8)
    columns = np.concatenate([v, np.zeros(-len(v) % distance, np.uint8)]).reshape(-1, distance)
    return np.cumsum(columns, 0, dtype=np.uint8).tobytes()[: len(v)]


def mtf_encode(data: bytes) -> bytes:
    order, out = list(range(256)), bytearray()
    for x in data:
        at = order.index(x)
        out.append(at)
        order.insert(0, order.pop(at))
    return bytes(out)


def mtf_decode(data: bytes, limit: int) -> bytes:
    order, out = list(range(256)), bytearray()
    for at in data[:limit]:
        out.append(order[at])
        order.insert(0, order.pop(at))
    return bytes(out)


def _rotations(data: bytes) -> np.ndarray:
    """The starts of the sorted rotations, by doubling the length that ranks compare; equal rotations by their start."""
    rank, size = np.frombuffer(data, np.uint8).astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while size < len(data):
        pair = rank * (len(data) + 256) + np.roll(rank, -size)
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        rank = np.empty(len(data), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank[order[-1]] == len(data) - 1:
            break
        size *= 2
    return order


def bwt_encode(data: bytes) -> bytes:
    """Index of the text among its sorted rotations, in four bytes, and their last bytes. Memory is some fifty times the blob."""
    if not data:
        return bytes(4)
    order = _rotations(data)
    return int(np.flatnonzero(order == 0)[0]).to_bytes(4, "little") + np.frombuffer(data, np.uint8)[order - 1].tobytes()


def bwt_decode(data: bytes, limit: int) -> bytes:
    at, last = int.from_bytes(data[:4], "little"), data[4:]
    if len(data) < 4 or last and at >= len(last):
        raise ValueError("no index")
    follow, out = np.argsort(np.frombuffer(last, np.uint8), kind="stable").tolist(), bytearray()
    for _ in range(min(len(last), limit)):
        at = follow[at]
        out.append(last[at])
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 16 bits; the table stops growing when it is full."""
    table, out, held = {bytes((i,)): i for i in range(256)}, bytearray(), b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        out += table[held].to_bytes(2, "little")
        if len(table) < 65536:
            table[longer] = len(table)
        held = data[i : i + 1]
    return bytes(out + (table[held].to_bytes(2, "little") if held else b""))


def lzw_decode(data: bytes, limit: int) -> bytes:
    if len(data) % 2:
        raise ValueError("half a code")
    table, out, before = [bytes((i,)) for i in range(256)], bytearray(), b""
    for i in range(0, len(data), 2):
        code = int.from_bytes(data[i : i + 2], "little")
        if code > len(table) or code == len(table) and not before:
            raise ValueError("a code before its entry")
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before and len(table) < 65536:
            table.append(before + entry[:1])
        before = entry
        if len(out) >= limit:
            break
    return bytes(out[:limit])


codec("RLE", rle_encode, rle_decode)
codec("Delta", delta_encode, delta_decode)
codec("MTF", mtf_encode, mtf_decode)
codec("BWT", bwt_encode, bwt_decode)
codec("LZW", lzw_encode, lzw_decode)
for _name, (_encode, _decode) in blocks.BLOCKS.items():
    codec(_name, _encode, _decode)

#: Guard against bombs: a larger output of a decoder is an error, never cut.
OUTPUT_BYTES = 32 << 20


def output_limit(data: bytes) -> int:
    return OUTPUT_BYTES


def decode_whole(name: str, data: bytes, limit: int | None = None) -> bytes:
    """The whole output; one above the limit is an error."""
    limit = output_limit(data) if limit is None else limit
    out = DECODERS[name](data, limit + 1)
    if len(out) > limit:
        raise ValueError("the output is above the limit")
    return out


def _each(function, blobs: Sequence[bytes | None]) -> list[bytes | None]:
    out = []
    for blob in blobs:
        try:
            out.append(None if blob is None else function(blob))
        except Exception:  # a decoder may fail in any way on any bytes; null says so
            out.append(None)
    return out


def _together(function, alone, blobs: Sequence[bytes | None]) -> list[bytes | None]:
    """``function`` of the blobs that are there, all at once; if that fails, ``alone`` for each."""
    try:
        found = iter(function([b for b in blobs if b is not None]))
        return [None if b is None else next(found) for b in blobs]
    except Exception:  # one blob stops no other
        return _each(alone, blobs)


def encode_whole(name: str, data: bytes) -> bytes:
    return ENCODERS[name](data)


def encode_each(name: str, blobs: Sequence[bytes | None]) -> list[bytes | None]:
    """The stream of every blob; null for null, and where the codec fails."""
    alone = partial(encode_whole, name)
    return _together(many.ENCODERS[name], alone, blobs) if name in many.ENCODERS else _each(alone, blobs)


def decode_each(name: str, blobs: Sequence[bytes | None], limit: int | None = None) -> list[bytes | None]:
    """The whole output of every stream; null for null, and where the codec fails or the output is above the limit."""
    alone = partial(decode_whole, name, limit=limit)
    if name not in many.DECODERS:
        return _each(alone, blobs)
    most = OUTPUT_BYTES if limit is None else limit
    return [None if b is None or len(b) > most else b for b in _together(lambda some: many.DECODERS[name](some, most + 1), alone, blobs)]


#: Bytes of blobs that go through a codec at a time.
SLICE_BYTES = 24 << 20


def _column(function):
    @kernels.kernel(pa.binary())
    def run(blobs: pa.Array) -> pa.Array:
        values = blobs.to_pylist()
        return pa.array([b for first, last in many.parts([v or b"" for v in values], SLICE_BYTES) for b in function(values[first:last])], pa.binary())

    return run


def encode(name: str):
    return _column(partial(encode_each, name))


def decode(name: str, limit: int | None = None):
    return _column(partial(decode_each, name, limit=limit))


_ROUND_TRIPS = pa.list_(pa.struct([("codec", pa.string()), ("same", pa.bool_())]))


def round_trips(names: Sequence[str], limit: int = 1 << 30):
    """A column function: whether each codec gives a blob back as it was, in the order of ``names``.

    Every blob is encoded and decoded by every codec; streams and outputs stay in
    the worker. A null blob comes back as null, which is the same.
    """

    @kernels.kernel(_ROUND_TRIPS)
    def run(blobs: pa.Array) -> pa.Array:
        values, out = blobs.to_pylist(), []
        for first, last in many.parts([v or b"" for v in values], SLICE_BYTES):
            some = values[first:last]
            same = [[a == b for a, b in zip(some, decode_each(name, encode_each(name, some), limit))] for name in names]
            out += [[{"codec": name, "same": s} for name, s in zip(names, row)] for row in zip(*same)]
        return pa.array(out, _ROUND_TRIPS)

    return run


# Width, reflected polynomial, start, final xor of the reflected checksums.
CRCS = {"crc16": (16, 0xA001, 0, 0), "crc16_ccitt": (16, 0x8408, 0, 0), "crc32c": (32, 0x82F63B78, 0xFFFFFFFF, 0xFFFFFFFF), "crc64": (64, 0xC96C5795D7870F42, 2**64 - 1, 2**64 - 1)}


@lru_cache(maxsize=16)
def crc_table(polynomial: int) -> tuple[int, ...]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (polynomial if value & 1 else 0)
        out.append(value)
    return tuple(out)


def crc(data: bytes, width: int, polynomial: int, start: int, final: int) -> int:
    table, value = crc_table(polynomial), start
    for x in data:
        value = value >> 8 ^ table[(value ^ x) & 255]
    return value ^ final


# Functions of a blob, and whether their values need 64 bits without a sign.
CHECKSUMS: dict[str, tuple[Callable[[bytes], int], bool]] = {
    **{name: ((lambda data, p=parts: crc(data, *p)), parts[0] == 64) for name, parts in CRCS.items()},
    "crc32": (zlib.crc32, False), "adler32": (zlib.adler32, False),
    "xxh32": (lambda data: xxhash.xxh32_intdigest(data), False), "xxh64": (lambda data: xxhash.xxh64_intdigest(data), True),
}


def checksum(name: str):
    """A column function: one of CHECKSUMS of each blob; those of 64 bits are decimals."""
    function, wide = CHECKSUMS[name]
    kind = pa.decimal128(20, 0) if wide else pa.int64()

    @kernels.kernel(kind)
    def run(blobs: pa.Array) -> pa.Array:
        values = [None if blob.as_py() is None else function(blob.as_py()) for blob in blobs]
        return pa.array([Decimal(v) if wide and v is not None else v for v in values], kind)

    return run


def blake2b(size: int = 64):
    """A column function: the BLAKE2b digest of ``size`` bytes in lower-case hexadecimal."""

    @kernels.kernel(pa.string())
    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([None if blob.as_py() is None else hashlib.blake2b(blob.as_py(), digest_size=size).hexdigest() for blob in blobs], pa.string())

    return run
