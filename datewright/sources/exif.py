"""EXIF in the bytes of pictures (JPEG, TIFF and raw files like it, PNG, WebP, RAF, CR3): dates, offsets and orientation, read and stamped in place."""

from __future__ import annotations

import struct
from datetime import datetime

# Tag numbers of the EXIF standard.
ORIENTATION, DATE_TIME, EXIF_IFD, ORIGINAL, DIGITIZED = 0x0112, 0x0132, 0x8769, 0x9003, 0x9004
OFFSET, OFFSET_ORIGINAL, OFFSET_DIGITIZED = 0x9010, 0x9011, 0x9012
EXTENSIONS = "jpg jpeg jpe tif tiff png webp heic heif hif avif dng cr2 cr3 nef nrw arw sr2 srf orf rw2 raf pef 3fr".split()
_DATES = (("DateTimeOriginal", ORIGINAL, OFFSET_ORIGINAL), ("DateTimeDigitized", DIGITIZED, OFFSET_DIGITIZED), ("DateTime", DATE_TIME, OFFSET))


_MAGIC = (b"II*\0", b"MM\0*", b"IIU\0", b"IIRO", b"IIRS", b"MMOR")  # of TIFF, and of cameras that write their own


def _chunks(data: bytes, at: int, order: str, kind_first: bool, pad: int) -> dict[bytes, tuple[int, int]]:
    """Where the bodies of a file's chunks lie, by kind; the first of each."""
    found: dict[bytes, tuple[int, int]] = {}
    while at + 8 <= len(data):
        kind, size = (data[at : at + 4], data[at + 4 : at + 8]) if kind_first else (data[at + 4 : at + 8], data[at : at + 4])
        n = int.from_bytes(size, order)
        found.setdefault(kind, (at + 8, min(len(data), at + 8 + n)))
        at += 8 + n + (pad if not kind_first else n % 2)
    return found


def _jpeg(data: bytes, at: int) -> list[tuple[int, int]]:
    at += 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return [(at + 10, min(len(data), at + 2 + size))]
        at += 2 + size
    return []


def _tiffs(data: bytes) -> list[tuple[int, int]]:
    """Where TIFF structures lie: the file itself, blocks of JPEG, PNG and WebP, the preview of a RAF, the boxes of a CR3, or a marked block anywhere."""
    if data[:4] in _MAGIC:
        return [(0, len(data))]
    spans: list[tuple[int, int]] = []
    if data[:2] == b"\xff\xd8":
        spans = _jpeg(data, 0)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        spans = [x for k, x in _chunks(data, 8, "big", False, 4).items() if k == b"eXIf"]
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        spans = [x for k, x in _chunks(data, 12, "little", True, 0).items() if k == b"EXIF"]
        spans = [(a + 6, b) if data[a : a + 6] == b"Exif\0\0" else (a, b) for a, b in spans]
    elif data[:15] == b"FUJIFILMCCD-RAW":
        spans = _jpeg(data, int.from_bytes(data[84:88], "big"))
    elif data[4:12] == b"ftypcrx ":
        spans = [(at + 4, len(data)) for k in (b"CMT1", b"CMT2") if (at := data.find(k)) >= 0]
    spans = [x for x in spans if data[x[0] : x[0] + 4] in _MAGIC]
    if not spans and (at := data.find(b"Exif\0\0")) >= 0 and data[at + 6 : at + 10] in _MAGIC:  # other containers keep the same block
        spans = [(at + 6, len(data))]
    return spans


def _entries(data: bytes) -> dict[int, tuple[int, int, int, int, str]]:
    """tag -> (where its entry lies, its type, the number of its values, where its structure begins, the byte order) of the first directories and the EXIF directory."""
    found: dict[int, tuple[int, int, int, int, str]] = {}
    for base, end in _tiffs(data):
        order = "<" if data[base : base + 2] == b"II" else ">"
        try:
            todo, seen = [struct.unpack_from(order + "I", data, base + 4)[0]], set()
            while todo:
                ifd = base + todo.pop()
                if ifd in seen:
                    continue
                seen.add(ifd)
                for i in range(struct.unpack_from(order + "H", data, ifd)[0]):
                    at = ifd + 2 + 12 * i
                    if at + 12 > end:
                        break
                    tag, kind, n = struct.unpack_from(order + "HHI", data, at)
                    if tag not in found:
                        found[tag] = at, kind, n, base, order
                        if tag == EXIF_IFD:
                            todo.append(struct.unpack_from(order + "I", data, at + 8)[0])
        except struct.error:
            continue
    return found


def _text(data: bytes, tag: int, entries: dict) -> str | None:
    if tag not in entries or entries[tag][1] != 2:
        return None
    at, _, n, base, order = entries[tag]
    where = at + 8 if n <= 4 else base + struct.unpack_from(order + "I", data, at + 8)[0]
    return data[where : where + n].split(b"\0")[0].decode("latin-1").strip()


def dates(data: bytes) -> list[tuple[str, str]]:
    """(tag's name with the UTC offset if it has one, its text), in the order in which they count."""
    entries, out = _entries(data), []
    for name, tag, offset in _DATES:
        if text := _text(data, tag, entries):
            zone = (_text(data, offset, entries) or "").strip('"')
            out.append((f"{name} {zone}" if zone[:1] in ("+", "-") else name, text))
    return out


def orientation(data: bytes) -> int:
    """1 to 8; 1 where nothing says."""
    entries = _entries(data)
    if ORIENTATION not in entries or entries[ORIENTATION][1] != 3:
        return 1
    at, _, _, _, order = entries[ORIENTATION]
    value = struct.unpack_from(order + "H", data, at + 8)[0]
    return value if 1 <= value <= 8 else 1


def stamp(data: bytes, taken: datetime) -> bytes | None:
    """The bytes with their date tags overwritten, where these are of the usual length; None if there are none."""
    text = f"{taken:%Y:%m:%d %H:%M:%S}\0".encode()
    entries, out, done = _entries(data), bytearray(data), False
    for tag in (DATE_TIME, ORIGINAL, DIGITIZED):
        if tag in entries and entries[tag][1] == 2 and entries[tag][2] == len(text):
            at, _, _, base, order = entries[tag]
            where = base + struct.unpack_from(order + "I", data, at + 8)[0]
            if where + len(text) <= len(out):
                out[where : where + len(text)] = text
                done = True
    return bytes(out) if done else None
