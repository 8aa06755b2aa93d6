"""Structure templates: a text that names typed fields, and the fields read from bytes.

    struct Header {
      u32le size;            // an integer; be and le give the byte order
      char[size] name;       // as many characters as an earlier field says
      bits[3] kind;          // from the lowest bit; the next plain field starts at a byte
      u16le[*] rest;         // to the end of the bytes
      Point corner;          // another struct of the template
    };

The first struct is read. Reading stops where the bytes end; a name that was not
read counts 0 as a length. Values are strings: integers in decimal, numbers above
64 bits in hexadecimal, floats and fixed-point numbers in decimal, times in ISO
form (UTC), colours as #RRGGBB[AA].
"""

from __future__ import annotations

import ipaddress
import re
import struct
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache
from typing import NamedTuple


class Type(NamedTuple):
    size: int
    read: Callable[[bytes], tuple[int, str]]  # a length that other fields can use, and the value


class Field(NamedTuple):
    type: str
    length: str | None
    name: str


def _integer(order: str, signed: bool) -> Callable[[bytes], tuple[int, str]]:
    def read(b: bytes) -> tuple[int, str]:
        value = int.from_bytes(b, order, signed=signed)
        if len(b) > 8 and not signed:
            return 0, f"0x{value:0{2 * len(b)}X}"
        return value if -(1 << 63) <= value < 1 << 63 else 0, str(value)

    return read


def _float(code: str) -> Callable[[bytes], tuple[int, str]]:
    return lambda b: (0, repr(struct.unpack(code, b)[0]))


def _bfloat(order: str) -> Callable[[bytes], tuple[int, str]]:
    return lambda b: (0, repr(struct.unpack(">f", (b if order == "big" else b[::-1]) + b"\0\0")[0]))


def _small_float(exponent: int, mantissa: int, has_infinity: bool) -> Callable[[bytes], tuple[int, str]]:
    """Eight bits: sign, exponent, mantissa; without infinities only all ones are no number."""

    def read(b: bytes) -> tuple[int, str]:
        e, m = b[0] >> mantissa & (1 << exponent) - 1, b[0] & (1 << mantissa) - 1
        top, bias = (1 << exponent) - 1, (1 << exponent - 1) - 1
        sign = -1.0 if b[0] & 0x80 else 1.0
        if e == top and (has_infinity or m == (1 << mantissa) - 1):
            return 0, repr(sign * float("inf") if has_infinity and not m else float("nan"))
        return 0, repr(sign * (m / (1 << mantissa) + (e > 0)) * 2.0 ** (max(e, 1) - bias))

    return read


def _time(start: datetime, unit: float, order: str = "little", signed: bool = False) -> Callable[[bytes], tuple[int, str]]:
    """So many units of seconds after a start; what no date can hold shows as the number."""

    def read(b: bytes) -> tuple[int, str]:
        n = int.from_bytes(b, order, signed=signed)
        try:
            micros = n * round(unit * 10**7) // 10
            return 0, (start + timedelta(microseconds=micros)).isoformat()
        except (OverflowError, ValueError):
            return 0, str(n)

    return read


def _ole(b: bytes) -> tuple[int, str]:
    days = struct.unpack("<d", b)[0]
    try:
        whole = int(days)
        return 0, (datetime(1899, 12, 30) + timedelta(days=whole, seconds=round(abs(days - whole) * 86400))).isoformat()
    except (OverflowError, ValueError):
        return 0, repr(days)


def _dos_date(b: bytes) -> tuple[int, str]:
    n = int.from_bytes(b, "little")
    return n, f"{1980 + (n >> 9):04d}-{n >> 5 & 15:02d}-{n & 31:02d}"


def _dos_time(b: bytes) -> tuple[int, str]:
    n = int.from_bytes(b, "little")
    return n, f"{n >> 11:02d}:{n >> 5 & 63:02d}:{2 * (n & 31):02d}"


def _fixed(half: int, signed: bool) -> Callable[[bytes], tuple[int, str]]:
    return lambda b: (0, repr(int.from_bytes(b, "little", signed=signed) / (1 << half)))


def _digits(b: bytes) -> tuple[int, str]:
    """Two decimal digits a byte, the highest byte last; other nibbles show as question marks."""
    text = "".join(str(n) if n < 10 else "?" for x in reversed(b) for n in (x >> 4, x & 15))
    return int(text) if text.isdigit() else 0, text


def _colour(order: str) -> Callable[[bytes], tuple[int, str]]:
    return lambda b: (0, "#" + "".join(f"{b[order.index(c)]:02X}" for c in "rgba" if c in order))


def _packed_colour(red: int, green: int, blue: int, alpha: int = 0) -> Callable[[bytes], tuple[int, str]]:
    """Channels from the highest bit on, each spread over a byte."""

    def read(b: bytes) -> tuple[int, str]:
        n, out, at = int.from_bytes(b, "little"), "#", red + green + blue + alpha
        for width in (red, green, blue, alpha):
            if width:
                at -= width
                out += f"{(n >> at & (1 << width) - 1) * 255 // ((1 << width) - 1):02X}"
        return 0, out

    return read


def _types() -> dict[str, Type]:
    out: dict[str, Type] = {}

    def put(names: str, size: int, read: Callable[[bytes], tuple[int, str]]) -> None:
        for name in names.split():
            out[name] = Type(size, read)

    for short, order in (("le", "little"), ("be", "big")):
        mark = "<" if short == "le" else ">"
        for bits in (16, 32, 64, 96, 128, 256, 512):
            put(f"u{bits}{short} uint{bits}{short}", bits // 8, _integer(order, False))
            if bits in (16, 32, 64, 128):
                put(f"i{bits}{short} int{bits}{short}", bits // 8, _integer(order, True))
        put(f"f16{short} half_{short} float16{short}", 2, _float(mark + "e"))
        put(f"f32{short} float32{short} float{short}", 4, _float(mark + "f"))
        put(f"f64{short} float64{short} double{short}", 8, _float(mark + "d"))
        put(f"bf16{short} bfloat16{short}", 2, _bfloat(order))
        for bits in (32, 64):
            put(f"unixts{bits}{short} unix{bits}{short}", bits // 8, _time(datetime(1970, 1, 1), 1, order, bits == 64))
    put("u8 uint8 byte", 1, _integer("little", False))
    put("i8 int8 sbyte", 1, _integer("little", True))
    put("fp8e4m3 fp8_e4m3", 1, _small_float(4, 3, False))
    put("fp8e5m2 fp8_e5m2", 1, _small_float(5, 2, True))
    put("dosdate", 2, _dos_date)
    put("dostime", 2, _dos_time)
    put("filetime", 8, _time(datetime(1601, 1, 1), 1e-7))
    put("webkittime", 8, _time(datetime(1601, 1, 1), 1e-6))
    put("netticks clrticks", 8, _time(datetime(1, 1, 1), 1e-7))
    put("hfsdate macdate", 4, _time(datetime(1904, 1, 1), 1, "big"))
    put("oledate oadate", 8, _ole)
    for half in (8, 16, 32):
        put(f"q{half}_{half}le q{half}.{half}", half // 4, _fixed(half, True))
        put(f"uq{half}_{half}le uq{half}.{half}", half // 4, _fixed(half, False))
    put("bcd8", 1, _digits)
    put("bcd16le bcd16", 2, _digits)
    put("bcd32le bcd32", 4, _digits)
    for names, order in (("rgb24 rgb", "rgb"), ("rgba32 rgba", "rgba"), ("bgr24 bgr", "bgr"), ("bgra32 bgra", "bgra")):
        put(names, len(order), _colour(order))
    put("rgb565le rgb565", 2, _packed_colour(5, 6, 5))
    put("rgb555le rgb555", 2, _packed_colour(5, 5, 5))
    put("rgba5551le rgba5551", 2, _packed_colour(5, 5, 5, 1))
    put("ipv4", 4, lambda b: (0, str(ipaddress.IPv4Address(b))))
    put("ipv6", 16, lambda b: (0, str(ipaddress.IPv6Address(b))))
    put("mac48 mac", 6, lambda b: (0, b.hex(":").upper()))
    put("fourcc fcc", 4, lambda b: (0, b.decode("latin-1")))
    put("guid uuid", 16, lambda b: (0, str(uuid.UUID(bytes_le=b)).upper()))
    put("bool8 bool", 1, lambda b: (b[0], "true" if b[0] else "false"))
    return out


TYPES = _types()
_TOKEN = re.compile(r"//[^\n]*|\s+|(struct)\s+(\w+)\s*\{|(\})\s*;?|([\w.]+)(?:\[\s*(\w+|\*)\s*\])?\s+(\w+)\s*;")


@lru_cache(maxsize=64)
def parse(text: str) -> dict[str, list[Field]]:
    """Fields of the structs, in order; an unreadable template is an error that says where."""
    structs: dict[str, list[Field]] = {}
    current: list[Field] | None = None
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        line = text.count("\n", 0, at) + 1
        if m is None or m[1] and current is not None or (m[3] or m[6]) and current is None:
            raise ValueError(f"line {line}: unexpected {text[at : at + 30]!r}")
        if m[1]:
            current = structs.setdefault(m[2], [])
        elif m[3]:
            current = None
        elif m[6]:
            current.append(Field(m[4], m[5], m[6]))
        at = m.end()
    if current is not None or not structs:
        raise ValueError("a struct has no end" if structs else "there is no struct")
    for fields in structs.values():
        for f in fields:
            if f.type not in structs and f.type.lower() not in TYPES and f.type.lower() not in ("char", "bits"):
                raise ValueError(f"unknown type {f.type!r}")
    return structs


#: Structs within structs, at most.
MOST_DEPTH = 32


def read(template: str, data: bytes, name: str | None = None) -> list[dict]:
    """path, type, offset, size, value of each field; elements of arrays (other than of bytes and characters) have rows of their own."""
    structs, out = parse(template), []

    def walk(fields: list[Field], at: int, path: str, depth: int) -> int:
        lengths: dict[str, int] = {}
        bit = 0

        def put(field: str, kind: str, start: int, size: int, value: str | None) -> None:
            out.append({"path": path + field, "type": kind, "offset": start, "size": size, "value": value})

        for f in fields:
            if at >= len(data):
                break
            kind = f.type.lower()
            if kind == "bits":
                width = max(1, int(f.length) if f.length and f.length.isdigit() else 1)
                whole = int.from_bytes(data[at : at + (bit + width + 7) // 8], "little")
                value = whole >> bit & (1 << width) - 1
                put(f.name, f"bits[{width}]", at, (bit + width + 7) // 8, str(value))
                lengths[f.name] = value
                at, bit = at + (bit + width) // 8, (bit + width) % 8
                continue
            at, bit = at + (bit > 0), 0
            if f.type in structs:
                if depth >= MOST_DEPTH:
                    raise ValueError("structs within structs go too deep")
                put(f.name, f.type, at, 0, None)
                at = walk(structs[f.type], at, f"{path}{f.name}.", depth + 1)
                continue
            if f.length is None:
                size, reader = TYPES.get(kind, TYPES["u8"])
                if at + size > len(data):
                    break
                number, value = reader(data[at : at + size]) if kind != "char" else (data[at], chr(data[at]))
                lengths[f.name] = number
                put(f.name, kind, at, size, value)
                at += size
                continue
            left = len(data) - at
            size = 1 if kind == "char" else TYPES[kind].size
            count = left // size if f.length == "*" else int(f.length) if f.length.isdigit() else lengths.get(f.length, 0)
            count = max(0, min(count, left // size))
            part = data[at : at + count * size]
            if size == 1 and kind in ("char", "u8", "uint8", "byte"):
                put(f.name, f"{kind}[{count}]", at, count, part.decode("ascii", "replace") if kind == "char" else part.hex().upper())
            else:
                put(f.name, f"{kind}[{count}]", at, count * size, None)
                for i in range(count):
                    put(f"{f.name}[{i}]", kind, at + i * size, size, TYPES[kind].read(part[i * size : (i + 1) * size])[1])
            at += count * size
        return at + (bit > 0)

    walk(structs[name or next(iter(structs))], 0, "", 0)
    return out


#: Templates of a few headers.
BUILT_IN = {
    "Gzip": "struct GzipHeader { u8[2] magic; u8 method; u8 flags; unixts32le modified; u8 extra_flags; u8 system; };",
    "Bmp": "struct BmpHeader { char[2] magic; u32le file_size; u16le reserved_1; u16le reserved_2; u32le data_offset; u32le header_size; i32le width; i32le height; u16le planes; u16le bits; };",
    "Zip": """struct ZipEntry {
      u32le signature; u16le version; u16le flags; u16le method; dostime time; dosdate date; u32le crc32;
      u32le packed_size; u32le size; u16le name_length; u16le extra_length; char[name_length] name; u8[extra_length] extra;
    };""",
    "Png": "struct Png { u8[8] magic; u32be length; fourcc type; u32be width; u32be height; u8 bits; u8 colour; u8 method; u8 filter; u8 interlace; u32be crc; };",
    "Elf": "struct Elf { u8[4] magic; u8 width; u8 order; u8 version; u8 system; u8 abi; u8[7] padding; u16le type; u16le machine; u32le file_version; u64le entry; };",
}
