"""Signatures in one blob: places, payload lengths and carving, as plain functions over bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Confidence factors of a payload whose length is only the distance to the next hit, and of one cut off by the blob's end.
NEXT_HIT, CUT_OFF = 0.7, 0.8


class Signature(NamedTuple):
    format: str
    magic: bytes
    offset: int  # of the magic in a blob of the format
    confidence: float
    mask: bytes | None = None

    def at(self, data: bytes, place: int) -> bool:
        """Whether the magic is at the place; masked bits of both sides do not count."""
        part = data[place : place + len(self.magic)]
        if self.mask is None:
            return part == self.magic
        return len(part) == len(self.magic) and all((a ^ b) & m == 0 for a, b, m in zip(part, self.magic, self.mask))


def places(data: bytes, magic: bytes, mask: bytes | None = None) -> Iterator[int]:
    """All places of a magic, overlapping ones too. A masked one is searched by its longest run of whole bytes."""
    if mask is None or all(m == 255 for m in mask):
        at = data.find(magic)
        while at >= 0:
            yield at
            at = data.find(magic, at + 1)
        return
    runs, start = [], None
    for i, m in enumerate((*mask, 0)):
        if m == 255 and start is None:
            start = i
        elif m != 255 and start is not None:
            runs.append((start - i, start, i))
            start = None
    whole = Signature("", magic, 0, 0.0, mask)
    if runs:
        _, a, b = min(runs)
        for at in places(data, magic[a:b]):
            if at >= a and whole.at(data, at - a):
                yield at - a
    else:
        yield from (i for i in range(len(data) - len(magic) + 1) if whole.at(data, i))


def hits(data: bytes, signatures: list[Signature]) -> list[tuple[int, str, float]]:
    """(offset, format, confidence): where blobs of the formats would start, each once with its highest confidence, by offset and format."""
    best: dict[tuple[int, str], float] = {}
    for s in signatures:
        for place in places(data, s.magic, s.mask):
            key = place - s.offset, s.format
            if key[0] >= 0 and s.confidence > best.get(key, -1.0):
                best[key] = s.confidence
    return sorted((offset, form, confidence) for (offset, form), confidence in best.items())


def _behind(marker: bytes, start: int, extra: int = 0) -> Callable[[bytes, int], int | None]:
    """Up to the first marker that lies ``start`` bytes or more behind the blob's start, and so many bytes more."""

    def probe(d: bytes, at: int) -> int | None:
        found = d.find(marker, at + start)
        return None if found < 0 or found + len(marker) + extra > len(d) else found + len(marker) + extra - at

    return probe


def _before(marker: bytes, start: int) -> Callable[[bytes, int], int | None]:
    """Up to the next blob of the same format."""

    def probe(d: bytes, at: int) -> int | None:
        found = d.find(marker, at + start)
        return None if found < 0 else found - at

    return probe


def _png(d: bytes, at: int) -> int | None:
    """Chunks of a length, a type, data and a checksum, to IEND; all that is left if it does not come."""
    if at + 8 > len(d):
        return None
    place = at + 8
    while place + 12 <= len(d):
        kind, place = d[place + 4 : place + 8], place + 12 + int.from_bytes(d[place : place + 4], "big")
        if place > len(d):
            break
        if kind == b"IEND":
            return place - at
    return len(d) - at


def _zip(d: bytes, at: int) -> int | None:
    end = d.find(b"PK\x05\x06", at)
    return None if end < 0 or end + 22 > len(d) else min(len(d), end + 22 + int.from_bytes(d[end + 20 : end + 22], "little")) - at


def _pdf(d: bytes, at: int) -> int | None:
    """The last end mark and the line ends behind it."""
    end = d.rfind(b"%%EOF", at)
    if end < 0:
        return None
    end += 5
    while end < len(d) and d[end] in b"\r\n":
        end += 1
    return end - at


def _bmp(d: bytes, at: int) -> int | None:
    size = int.from_bytes(d[at + 2 : at + 6], "little")
    return size if at + 6 <= len(d) and 14 <= size <= len(d) - at else None


def _riff(d: bytes, at: int) -> int | None:
    return None if at + 8 > len(d) else min(len(d) - at, 8 + int.from_bytes(d[at + 4 : at + 8], "little"))


def _tar(d: bytes, at: int) -> int | None:
    place = at
    while place + 512 <= len(d):
        if not any(d[place : place + 512]) and not any(d[place + 512 : place + 1024][:512]) or place + 1024 > len(d) and not any(d[place : place + 512]):
            return min(len(d), place + 1024) - at
        digits = d[place + 124 : place + 136].split(b"\0")[0].split(b" ")[0]
        if any(c not in b"01234567" for c in digits):
            return None
        place += 512 + -(-int(digits or b"0", 8) // 512) * 512
    return None


def _boxes(d: bytes, at: int) -> int | None:
    """A run of boxes: a size, a printable type and the rest; size 1 has a long one behind the type, 0 goes to the end."""
    place = at
    while place + 8 <= len(d) and all(0x20 <= c <= 0x7E for c in d[place + 4 : place + 8]):
        size = int.from_bytes(d[place : place + 4], "big")
        if size == 1:
            size = int.from_bytes(d[place + 8 : place + 16], "big") if place + 16 <= len(d) else 0
        elif size == 0:
            size = len(d) - place
        if size < 8 or place + size > len(d):
            break
        place += size
    return place - at or None


def _ogg(d: bytes, at: int) -> int | None:
    """Pages up to the one that ends the stream, or up to what is no page."""
    place = at
    while place + 27 <= len(d) and d.startswith(b"OggS", place):
        count = d[place + 26]
        if place + 27 + count > len(d):
            break
        last = d[place + 5] & 4
        place += 27 + count + sum(d[place + 27 : place + 27 + count])
        if last:
            break
    return place - at or None


PROBES: dict[str, Callable[[bytes, int], int | None]] = {
    "Png": _png, "Jpeg": _behind(b"\xff\xd9", 2), "Gif": _behind(b";", 6), "Bmp": _bmp, "Riff": _riff, "Mp4": _boxes, "Zip": _zip, "Pdf": _pdf, "Tar": _tar, "Ogg": _ogg,
    "Gzip": _before(b"\x1f\x8b\x08", 2), "Flac": _before(b"fLaC", 4), "Bzip2": _behind(bytes.fromhex("177245385090"), 4, 4), "Xz": _behind(b"YZ", 6),
}
# Formats whose lengths another's marks tell.
_SAME = {
    "Riff": "Wav Avi Webp Aiff", "Mp4": "Mkv Heif Avif", "Jpeg": "JpegArchive Mpo",
    "Zip": "Apk Jar Docx Xlsx Pptx Odt Ods Odp Epub Cbz Appx NuPkg Kmz Maff Crx Xpi Ipa Ear War",
}
PROBES |= {name: PROBES[like] for like, names in _SAME.items() for name in names.split()}


def payload_length(data: bytes, form: str, at: int = 0) -> int | None:
    """Length of a payload of the format that starts at a place, by its own marks; None if they do not tell."""
    probe = PROBES.get(form)
    found = probe(data, at) if probe and 0 <= at < len(data) else None
    return found if found is not None and found > 0 else None


def carve(data: bytes, signatures: list[Signature], least_confidence: float, min_bytes: int, max_bytes: int) -> list[tuple[int, int, str, float]]:
    """(offset, length, format, confidence) of the outermost payloads of one blob."""
    every = hits(data, signatures)
    offsets = sorted({offset for offset, _, _ in every})
    following = dict(zip(offsets, offsets[1:]))
    spans = []
    for offset, form, confidence in every:
        if confidence < least_confidence:
            continue
        room, length = len(data) - offset, payload_length(data, form, offset)
        if length is None:
            length, factor = following.get(offset, len(data)) - offset, NEXT_HIT
        else:
            factor = CUT_OFF if length > room else 1.0
        if min_bytes <= min(length, room) <= max_bytes:
            spans.append((offset, -min(length, room), form, confidence * factor))
    out, reach = [], -1
    for offset, length, form, confidence in sorted(spans):
        if offset - length > reach:  # not within an earlier one
            out.append((offset, -length, form, confidence))
        reach = max(reach, offset - length)
    return out
