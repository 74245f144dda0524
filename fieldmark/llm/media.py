"""Media columns: signature sniffing with structure validators.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass; at each hit a validator walks the
format's structure and gives its length, or refuses. The type of the whole value is what validates at offset 0 over
its whole length; validated hits inside it are embedded media, which carve() cuts out.

Work is linear in the value's length. Walks that go from record to record (zip, ogg, mp4) remember what every place on the
way ends in, and searches what they found, so that no stretch is walked twice. Hits inside an accepted medium are not
walked. The other walks together may read WORK times the value's length; hits that are left then are refused. It
takes bytes made for the purpose to get there: media that lie one after the other are read once.

Defined cases: null bytes have no type, a length of 0 and nothing embedded; empty bytes the type EMPTY. Bytes that no
validator accepts keep their declared type. Of hits at one offset the longest valid one wins; hits inside an accepted
embedded medium are not reported again. Equal bytes give equal results. Values of any length are read whole; repeated rows
are judged each; an empty table gives none; columns of the input with the names that are added are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from itertools import groupby
from struct import error as struct_error
from struct import pack, unpack_from

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

EMPTY = "application/x-empty"
#: The walks that nothing is remembered of may read so many times the value's length.
WORK = 64


def wav_header(n: int) -> bytes:
    """RIFF header of n 8-bit mono samples at 8 kHz."""
    le = lambda v, k: int(v).to_bytes(k, "little")
    fmt = le(1, 2) + le(1, 2) + le(8000, 4) + le(8000, 4) + le(1, 2) + le(8, 2)
    return b"RIFF" + le(36 + n + n % 2, 4) + b"WAVEfmt " + le(16, 4) + fmt + b"data" + le(n, 4)


def wav_store(payload: bytes) -> bytes:
    return wav_header(len(payload)) + payload + b"\0" * (len(payload) % 2)


def wav_read(media: bytes) -> bytes:
    """The samples of the data chunk."""
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def bmp_store(payload: bytes, width: int = 64) -> bytes:
    """An 8-bit grey picture of width pixels a row, from the top down. The payload is a multiple of width, which is one of 4."""
    start = 54 + 4 * 256
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = pack("<IiiHHIIiiII", 40, width, -(len(payload) // width), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return b"BM" + pack("<IHHI", start + len(payload), 0, 0, start) + head + grey + payload


def bmp_read(media: bytes) -> bytes:
    """The pixels of an 8-bit picture without compression, rows from the top down."""
    start, _, width, height, _, bits, packed = unpack_from("<IIiiHHI", media, 10)
    if bits != 8 or packed or width <= 0:
        raise ValueError("not 8 bits a pixel")
    wide = width + -width % 4
    rows = [media[start + i * wide : start + i * wide + width] for i in range(abs(height))]
    if any(len(r) != width for r in rows):
        raise ValueError("too few rows")
    return b"".join(rows if height < 0 else reversed(rows))


#: What gives the payload of a type.
READERS = {"audio/wav": wav_read, "image/bmp": bmp_read}


class Walks:
    """A value's bytes and what the walks over them have found out."""

    def __init__(self, data: bytes):
        self.data, self.ends, self.found = data, {}, {}
        self.left = WORK * len(data) + (1 << 16)

    def spend(self, n: int) -> bool:
        """Whether n more bytes may be read."""
        self.left -= max(n, 1)
        return self.left >= 0

    def chain(self, name: str, at: int, step: Callable):
        """What step leads to from at: step(at) is (next place, None) or (None, what the way ends in)."""
        known, way = self.ends.setdefault(name, {}), []
        while at not in known:
            way.append(at)
            after, end = step(at)
            if after is None:
                break
            at = after
        else:
            end = known[at]
        for place in way:
            known[place] = end
        return end

    def find(self, key: bytes, at: int) -> int:
        """data.find(key, at); a stretch that was searched is not searched again."""
        begin, got = self.found.get(key, (0, -2))
        if got == -2 or at < begin or 0 <= got < at:
            self.found[key] = begin, got = at, self.data.find(key, at)
        return got


# --- Validators: (walks, offset) -> (type, length) or None -----------------------------------------------------------


def _png(w: Walks, o: int):
    b, at = w.data, o + 8
    n = len(b)
    first = True
    while at + 12 <= n:
        size, kind = unpack_from(">I", b, at)[0], b[at + 4 : at + 8]
        if at + 12 + size > n or first and (kind != b"IHDR" or size != 13) or not w.spend(12 + size):
            return None
        if zlib.crc32(b[at + 4 : at + 8 + size]) != unpack_from(">I", b, at + 8 + size)[0]:
            return None
        at, first = at + 12 + size, False
        if kind == b"IEND":
            return "image/png", at - o
    return None


def _jpeg(w: Walks, o: int):
    b, at, scan = w.data, o + 2, False
    n = len(b)
    while at + 2 <= n and w.spend(64):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xD9:
            return ("image/jpeg", at + 2 - o) if scan else None
        if mark == 0xFF:
            at += 1
            continue
        if mark == 1 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        if mark == 0 or at + 4 > n or (size := unpack_from(">H", b, at + 2)[0]) < 2 or at + 2 + size > n:
            return None
        at += 2 + size
        if mark == 0xDA:
            scan, begin = True, at
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < n and (b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7):
                at += 2
            if not w.spend(64 + (at if at >= 0 else n) - begin) or at < 0:
                return None
    return None


def _gif(w: Walks, o: int):
    b, n = w.data, len(w.data)
    if o + 13 > n:
        return None
    at = o + 13 + (3 << ((b[o + 10] & 7) + 1) if b[o + 10] & 0x80 else 0)
    seen = False
    while at < n and w.spend(16):
        kind = b[at]
        if kind == 0x3B:
            return ("image/gif", at + 1 - o) if seen else None
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= n:
            seen = True
            at += 11 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0)
        else:
            return None
        while at < n and b[at]:
            if not w.spend(16):
                return None
            at += 1 + b[at]
        at += 1
    return None


def _riff(w: Walks, o: int):
    b, n = w.data, len(w.data)
    if o + 12 > n:
        return None
    size, form = unpack_from("<I", b, o + 4)[0], b[o + 8 : o + 12]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(form)
    end = o + 8 + size
    if kind is None or size < 4 or end > n:
        return None
    at, chunks = o + 12, 0
    while at + 8 <= end:
        step = unpack_from("<I", b, at + 4)[0]
        if at + 8 + step > end or not w.spend(16):
            return None
        at, chunks = at + 8 + step + step % 2, chunks + 1
    return (kind, end - o) if chunks and at in (end, end + 1) else None


def _bmp(w: Walks, o: int):
    b = w.data
    if o + 26 > len(b):
        return None
    size, zero, start, head = unpack_from("<IIII", b, o + 2)
    return ("image/bmp", size) if zero == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= size and o + size <= len(b) else None


def _gzip(w: Walks, o: int):
    b, work, at = w.data, zlib.decompressobj(31), o
    if o + 4 > len(b) or b[o + 3] & 0xE0:
        return None
    try:
        while not work.eof and at < len(b):
            step = b[at : at + 65536]
            if not w.spend(len(step)):
                return None
            at += len(step)
            while step and not work.eof:
                work.decompress(step, 1 << 20)  # bounded pieces: a bomb costs time, not memory
                step = work.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", at - len(work.unused_data) - o) if work.eof else None


def _zip(w: Walks, o: int):
    """Local files, then the central directory, then its end."""
    b, n = w.data, len(w.data)

    def files(at: int):
        if b[at : at + 4] != b"PK\3\4" or at + 30 > n:
            return None, at
        flags, size, name, extra = unpack_from("<H", b, at + 6)[0], unpack_from("<I", b, at + 18)[0], *unpack_from("<HH", b, at + 26)
        after = at + 30 + name + extra + size
        if flags & 8:
            after = w.find(b"PK\1\2", min(after, n))
        return (after, None) if after >= 0 else (None, n)

    def directory(at: int):
        if b[at : at + 4] == b"PK\1\2" and at + 46 <= n:
            return at + 46 + sum(unpack_from("<HHH", b, at + 28)), None
        if b[at : at + 4] != b"PK\5\6" or at + 22 > n:
            return None, n + 1
        return None, at + 22 + unpack_from("<H", b, at + 20)[0]

    if o + 30 > n:
        return None
    end = w.chain("zip directory", w.chain("zip files", o, files), directory)
    return ("application/zip", end - o) if end <= n else None


def _pdf(w: Walks, o: int):
    b = w.data
    if not (b[o + 5 : o + 6].isdigit() and b[o + 6 : o + 7] == b"."):
        return None
    ref = w.find(b"startxref", o)
    end = w.find(b"%%EOF", ref) if ref > 0 else -1
    return ("application/pdf", end + 5 - o) if end > 0 else None


def _ogg(w: Walks, o: int):
    b, n = w.data, len(w.data)

    def page(at: int):
        if b[at : at + 4] != b"OggS" or at + 27 > n or b[at + 4]:
            return None, n + 1
        after = at + 27 + b[at + 26] + sum(b[at + 27 : at + 27 + b[at + 26]])
        return (None, after) if after > n or b[at + 5] & 4 else (after, None)

    end = w.chain("ogg", o, page)
    return ("audio/ogg", end - o) if end <= n else None


def _mp4(w: Walks, o: int):
    b, n = w.data, len(w.data)

    def sized(at: int) -> int:
        size = unpack_from(">I", b, at)[0] if at + 8 <= n else 0
        return size if size >= 8 and at + size <= n and b[at + 4 : at + 8].isalnum() else 0

    def box(at: int):
        return (at + size, None) if (size := sized(at)) else (None, at)

    def to_movie(at: int):
        return (None, b[at + 4 : at + 8] == b"moov") if not (size := sized(at)) or b[at + 4 : at + 8] == b"moov" else (at + size, None)

    if not sized(o) or not w.chain("mp4 movie", o, to_movie):
        return None
    return "video/mp4", w.chain("mp4", o, box) - o


#: Magic bytes, the place of the medium's start relative to them, the validator.
SIGNATURES: list[tuple[bytes, int, Callable]] = [
    (b"\x89PNG\r\n\x1a\n", 0, _png),
    (b"\xff\xd8\xff", 0, _jpeg),
    (b"GIF87a", 0, _gif),
    (b"GIF89a", 0, _gif),
    (b"RIFF", 0, _riff),
    (b"BM", 0, _bmp),
    (b"\x1f\x8b\x08", 0, _gzip),
    (b"PK\x03\x04", 0, _zip),
    (b"%PDF-", 0, _pdf),
    (b"OggS\x00", 0, _ogg),
    (b"ftyp", -4, _mp4),
]


def _automaton():
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        key = magic.decode("latin-1")
        found.add_word(key, (k, len(key)))
    found.make_automaton()
    return found


_BUILT: list = []


def hits(data: bytes) -> list[tuple[int, str, int]]:
    """(offset, type, length) of all that validates, outermost first, none inside another but the whole value."""
    if not _BUILT:
        _BUILT.append(_automaton())
    places = sorted((offset, k) for end, (k, size) in _BUILT[0].iter(data.decode("latin-1")) if (offset := end - size + 1 + SIGNATURES[k][1]) >= 0)
    walks, kept, upto = Walks(data), [], 0
    for offset, group in groupby(places, key=lambda p: p[0]):
        if offset < upto:
            continue
        if got := max((x for _, k in group if (x := SIGNATURES[k][2](walks, offset))), key=lambda x: x[1], default=None):
            if offset and offset + got[1] == len(data) and kept and kept[0] == (0, got[0], len(data)):
                continue  # the rest of the whole from one of its records on, as from an archive's second file
            kept.append((offset, *got))
            if (offset, got[1]) != (0, len(data)):
                upto = offset + got[1]
    return kept


def sniff(data: bytes | None, declared: str | None) -> tuple[str | None, bool, list[tuple[int, str, int]]]:
    """The corrected type, whether it differs from the declared one, and the embedded media."""
    if data is None:
        return declared, False, []
    if not data:
        return EMPTY, declared != EMPTY, []
    found = hits(data)
    whole = [h for h in found if h[0] == 0]
    kind = whole[0][1] if whole else declared
    inner = [h for h in found if not whole or h != whole[0]]
    return kind, kind != declared, inner


def carve(data: bytes, found: list[tuple[int, str, int]]) -> list[bytes]:
    return [data[o : o + n] for o, _, n in found]


def sniff_media(df: DataFrame, media: str, declared: str) -> DataFrame:
    """df with media_type, corrected and embedded (array of offset, type, length, sha256 of the carved bytes)."""

    def judge(blobs: list, kinds: list) -> dict[str, list]:
        got = [sniff(b, k) for b, k in zip(blobs, kinds)]
        inner = [[{"offset": o, "type": t, "length": n, "sha256": hashlib.sha256(c).hexdigest()} for (o, t, n), c in zip(e, carve(b or b"", e))] for b, (_, _, e) in zip(blobs, got)]
        return {"media_type": [g[0] for g in got], "corrected": [g[1] for g in got], "embedded": inner}

    keep = [c for c in df.columns if c not in {"media_type", "corrected", "embedded"}]
    return map_columns(df, keep, [media, declared], judge, "media_type string, corrected boolean, embedded array<struct<offset:long,type:string,length:long,sha256:string>>")


#: What a wrapped medium has before and after it; neither holds magic bytes.
BEFORE, AFTER = b"fieldmark parcel\n", b"\nend of parcel\n"
#: The forms that a payload can be stored in, all of 8-bit samples.
FORMS: dict[str, Callable[[bytes], bytes]] = {
    "wav": wav_store,
    "bmp": bmp_store,
    "wrapped wav": lambda payload: BEFORE + wav_store(payload) + AFTER,
    "wrapped bmp": lambda payload: BEFORE + bmp_store(payload) + AFTER,
}


def store_text(df: DataFrame, text: str, keep: list[str], unit: int = 64, forms: tuple[str, ...] = ("wav",)) -> DataFrame:
    """keep, n_bytes, media: the text's UTF-8 bytes, filled up with zeros to a positive multiple of unit (itself a multiple of 64).

    The payload is stored in one of forms; which one, its checksum says, so equal texts are stored alike.
    """

    def store_payload(payload: bytes) -> bytes:
        return FORMS[forms[zlib.crc32(payload) % len(forms)]](payload)

    def make(texts: list) -> dict[str, list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return {"n_bytes": [len(r) for r in raw], "media": [store_payload(r + b"\0" * ((-len(r)) % unit if r else unit)) for r in raw]}

    return map_columns(df, keep, [text], make, "n_bytes long, media binary")


def payload_of(data: bytes, kind: str | None, inner: list[tuple[int, str, int]]) -> tuple[str | None, bytes | None]:
    """The type and payload of the value, if its type has a reader, or else of the first embedded medium that can be read."""
    if kind in READERS:
        found = [(kind, data)]
    else:
        found = ((t, data[o : o + n]) for o, t, n in inner if t in READERS)
    for one, medium in found:
        try:
            return one, READERS[one](medium)
        except (ValueError, struct_error):  # valid by its structure, but not of 8-bit samples
            continue
    return None, None


def media_features(df: DataFrame, keep: list[str], media: str = "media", declared: str = "application/octet-stream") -> DataFrame:
    """keep and what is read back from the stored bytes: the payload's length and digests, the bytes' and a feature string.

    The sniffed type decides the reader; where the value itself has none, the carved embedded media are read. The payload's
    columns are null if nothing can be read, and all of them for null bytes.
    """

    def make(blobs: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for blob in blobs:
            kind, corrected, inner = sniff(blob, declared)
            read, payload = payload_of(blob or b"", kind, inner)
            there = payload is not None
            samples = np.frombuffer(payload or b"", np.uint8)
            out["payload_bytes"].append(len(payload) if there else None)
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest() if there else None)
            out["tail_crc32"].append(zlib.crc32(payload[-64:]) if there else None)
            out["media_bytes"].append(None if blob is None else len(blob))
            out["media_sha256"].append(None if blob is None else hashlib.sha256(blob).hexdigest())
            listed = ",".join(f"{t}@{o}+{n}" for o, t, n in inner)
            told = f"type={kind};corrected={int(corrected)};read={read};samples={len(samples)};sum={int(samples.sum(dtype=np.int64))};high={int((samples > 127).sum())};embedded=[{listed}]"
            out["feature"].append(None if blob is None else told)
        return out

    return map_columns(df, keep, [media], make, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
