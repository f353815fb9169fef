"""Media columns: payloads stored in a media container, found again by signature.

``media_column`` stores a text's bytes as the samples of an 8-bit PCM wave file,
under the type that its source declared, that of a text.  ``sniffed`` takes any
binary column: an Aho-Corasick automaton locates the magic bytes and end marks of
known formats in one pass, validators confirm each hit by its structure, lengths
and checksums, the hit at offset zero corrects the declared type, and further
confirmed hits are carved as embedded media.  ``media_features`` reads the stored
payload back and describes it; ``described_texts`` does all three in one pass.

What confirms a hit: RIFF (wave of any uncompressed sample format, WebP, AVI) and PNG,
chunks that add up, a wave's format that agrees with itself, PNG checksums; ISO media
(MP4, QuickTime, HEIC, AVIF), boxes that add up; MP3, a tag and two frames behind it; GIF, its
blocks to the trailer; JPEG, segments with a frame before the scan, and the end
mark; Ogg, pages of one stream with their checksums; FLAC, its metadata blocks and
the checksum of the first frame's head (it has no length: it ends with the buffer);
PDF, a cross-reference where the last lines say; zip, a directory whose place, size
and entries agree with its end record.

Defined results for odd input: a null text is an empty one and is stored as one
block of padding; equal texts give equal values; null media give no segments, keep
their declared type, and have null features; repeated rows give repeated rows; an
empty table gives an empty result; other columns are kept by ``sniffed``, where
media_type, segments and refused give way to its own, and ignored elsewhere.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices, text_of

BLOCK, PAD, RATE = 576, b"\xff", 8000
DECLARED = "text/plain"

# Signatures of media formats, by type.
SIGNATURES = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "audio/ogg": b"OggS",
    "audio/flac": b"fLaC",
    "application/pdf": b"%PDF-",
    "application/zip": b"PK\x03\x04",
    "audio/mpeg": b"ID3",
    "video/mp4": b"ftyp",  # behind the length of its box
}
# What a RIFF file, an ISO media file and its boxes are named; codings of waves that are samples as they are.
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
ISO_BRANDS = {b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"heic": "image/heic", b"mif1": "image/heif", b"avif": "image/avif", b"qt  ": "video/quicktime"}
ISO_BOXES = frozenset((b"ftyp", b"moov", b"moof", b"mdat", b"meta", b"free", b"skip", b"wide", b"styp", b"sidx", b"mfra", b"uuid", b"pdin"))
UNPACKED = (1, 3, 6, 7, 0xFFFE)
# Kilobits a second by index, of MPEG 1 and of the versions of half its rates, and samples a second.
MP3_KILOBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_KILOBITS_LOW = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
MP3_HERTZ = (44100, 48000, 32000)

# Where formats end.
ENDS = {"jpeg end": b"\xff\xd9", "pdf end": b"%%EOF", "zip end": b"PK\x05\x06"}
Where = tuple[int, int, int]  # end, payload start, payload end


def stored_as_wave(payload: bytes) -> bytes:
    """A mono 8-bit PCM wave file whose samples are the payload."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def _wave_form(chunk: bytes) -> bool:
    """Whether a wave's format chunk agrees with itself: any channels, sample size and coding without compression."""
    if len(chunk) < 16:
        return False
    coding, channels, rate, byte_rate, align, bits = struct.unpack("<HHIIHH", chunk[:16])
    return coding in UNPACKED and channels > 0 and rate > 0 and bits > 0 and align == channels * -(-bits // 8) and byte_rate == rate * align


def _riff(b: bytes, at: int) -> tuple[str, Where] | None:
    """Type, end and payload of a RIFF file at an offset, if its chunks add up: a wave, a WebP picture or an AVI film."""
    kind = RIFF_FORMS.get(b[at + 8 : at + 12])
    if kind is None or len(b) < at + 12:
        return None
    end, i, form = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little"), at + 12, False
    if end > len(b):
        return None
    chunks = []
    while i + 8 <= end:
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return None
        name = b[i : i + 4]
        if kind == "audio/wav":
            if name == b"fmt ":
                form = _wave_form(b[i + 8 : i + 8 + min(n, 16)])
            if name == b"data":
                return (kind, (end, i + 8, i + 8 + n)) if form else None
        chunks.append(name)
        i += 8 + n + n % 2
    first = chunks[0] if chunks else b""
    whole = kind == "image/webp" and first in (b"VP8 ", b"VP8L", b"VP8X") or kind == "video/x-msvideo" and first == b"LIST" and b"LIST" in chunks[1:]
    return (kind, (end, at + 12, end)) if whole else None


def _boxes(b: bytes, at: int) -> tuple[str, Where] | None:
    """Type, end and payload of an ISO media file at an offset: boxes whose lengths add up, the brand first, with a movie or its data."""
    if at < 0:
        return None
    i, names, head = at, set(), 0
    while i + 8 <= len(b):
        n, name, short = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8], 8
        if name not in ISO_BOXES:
            break
        if n == 1 and i + 16 <= len(b):
            n, short = int.from_bytes(b[i + 8 : i + 16], "big"), 16
        n = len(b) - i if n == 0 else n
        if n < short or i + n > len(b) or (name == b"ftyp") != (i == at):
            break
        if i == at and (n < 16 or n % 4):
            return None
        head = head or n
        names.add(name)
        i += n
    if not names & {b"moov", b"moof", b"mdat", b"meta"}:
        return None
    brand = b[at + 8 : at + 12]
    return ISO_BRANDS.get(brand, "video/mp4"), (i, at + head, i)


def _frame_bytes(b: bytes, at: int) -> int:
    """Length of the MPEG layer III frame whose head stands there, 0 if none does."""
    head = int.from_bytes(b[at : at + 4], "big")
    version, layer, rate, sampling = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if at + 4 > len(b) or head >> 21 != 0x7FF or version == 1 or layer != 1 or rate in (0, 15) or sampling == 3:
        return 0
    hertz = MP3_HERTZ[sampling] >> {3: 0, 2: 1, 0: 2}[version]
    kilobits = (MP3_KILOBITS if version == 3 else MP3_KILOBITS_LOW)[rate - 1]
    return (144 if version == 3 else 72) * kilobits * 1000 // hertz + (head >> 9 & 1)


def _mp3(b: bytes, at: int) -> Where | None:
    """A tag whose length agrees, and the layer III frames behind it, two at least."""
    head = b[at : at + 10]
    if len(head) < 10 or head[3] not in (2, 3, 4) or head[4] == 255 or max(head[6:10]) > 127:
        return None
    i = first = at + 10 + sum(x << 7 * (3 - k) for k, x in enumerate(head[6:10])) + 10 * bool(head[5] & 16)
    frames = 0
    while n := _frame_bytes(b, i):
        if i + n > len(b):
            break
        i, frames = i + n, frames + 1
    return (i, first, i) if frames > 1 else None


def _png(b: bytes, at: int) -> tuple[int, int, int] | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if first and (kind != b"IHDR" or n != 13) or i + 12 + n > len(b):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i, at + 8, i
    return None


def _gif(b: bytes, at: int) -> tuple[int, int, int] | None:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or len(b) < at + 13:
        return None
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1, at + 6, i
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _jpeg(b: bytes, at: int, ends: list[int]) -> Where | None:
    i, framed = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
        if kind < 0xC0 or n < 2 or i + 2 + n > len(b):
            return None
        framed = framed or 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        if kind == 0xDA:
            k = bisect.bisect_left(ends, i + 2 + n)
            return (ends[k] + 2, at + 2, ends[k]) if framed and k < len(ends) else None
        i += 2 + n
    return None


_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg_checksum(page: bytes) -> int:
    """CRC-32 with the highest bit first, from zero: the usual one over mirrored bytes, mirrored."""
    turned = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{turned:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> Where | None:
    """From a page that begins a stream over the pages that follow."""
    i = at
    while b[i : i + 5] == b"OggS\x00" and i + 27 <= len(b):
        if i == at and not b[i + 5] & 2:
            return None
        end = i + 27 + b[i + 26]
        end += sum(b[i + 27 : end])
        page = b[i:end]
        if end > len(b) or ogg_checksum(page[:22] + bytes(4) + page[26:]) != int.from_bytes(page[22:26], "little"):
            break
        i = end
    return (i, at, i) if i > at else None


def _crc8(part: bytes) -> int:
    out = 0
    for x in part:
        out ^= x
        for _ in range(8):
            out = (out << 1 ^ (7 if out & 128 else 0)) & 255
    return out


def _flac(b: bytes, at: int) -> Where | None:
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind & 127 or n != 34) or kind & 127 == 127:
            return None
        i, first = i + 4 + n, False
        if kind & 128:
            break
    if b[i : i + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        return None
    # the head has 4 bytes, a number of 1 to 7, sizes of 0 to 4, and its checksum
    return (len(b), at + 4, len(b)) if any(_crc8(b[i : i + n]) == b[i + n] for n in range(5, 16) if i + n < len(b)) else None


_XREF = re.compile(rb"startxref[ \t]*\r?\n?[ \t]*([0-9]{1,10})[ \t]*\r?\n?$")
_TABLE = re.compile(rb"xref\s|[0-9]{1,10} [0-9]{1,5} obj")


def _pdf(b: bytes, at: int, ends: list[int], starts: list[int]) -> Where | None:
    """To the last end before another file begins whose cross-reference stands where it says."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    k = bisect.bisect_right(starts, at)
    most = starts[k] if k < len(starts) else len(b)
    for end in reversed(ends[bisect.bisect_left(ends, at) : bisect.bisect_left(ends, most)]):
        said = _XREF.search(b[max(at, end - 40) : end])
        if said and int(said[1]) < end - at and _TABLE.match(b[at + int(said[1]) : at + int(said[1]) + 24]):
            return end + 5, at, end
    return None


def zip_files(b: bytes, ends: list[int]) -> dict[int, Where]:
    """Zip files by their start, from their end records: an end record says where its file starts."""
    out: dict[int, Where] = {}
    for end in ends:
        if end + 22 > len(b):
            continue
        disk, of_disk, here, entries, size, offset, comment = struct.unpack("<HHHHIIH", b[end + 4 : end + 22])
        at, i = end - size - offset, end - size
        if disk or of_disk or here != entries or at < 0 or end + 22 + comment > len(b):
            continue
        for _ in range(entries):
            if b[i : i + 4] != b"PK\x01\x02" or i + 46 > end:
                break
            i += 46 + sum(struct.unpack("<HHH", b[i + 28 : i + 34]))
        else:
            if i == end:
                out[at] = (end + 22 + comment, at, end)
    return out


PLAIN_VALIDATORS = {"audio/mpeg": _mp3, "image/png": _png, "image/gif": _gif, "audio/ogg": _ogg, "audio/flac": _flac}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in (SIGNATURES | ENDS).items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def segments(media: bytes) -> tuple[list[tuple[str, int, int, int, int]], int]:
    """Confirmed (type, start, end, payload start, payload end), by start, and the hits refused."""
    at: dict[str, list[int]] = {kind: [] for kind in SIGNATURES | ENDS}
    for end, (kind, n) in automaton().iter(media.decode("latin-1")):
        at[kind].append(end - n + 1)
    zips = zip_files(media, at["zip end"]) if at["application/zip"] else {}
    found, refused, streamed, zipped, framed = [], 0, 0, 0, 0
    at["video/mp4"] = [x - 4 for x in at["video/mp4"]]
    for start, kind in sorted((start, kind) for kind in SIGNATURES for start in at[kind]):
        if kind == "audio/ogg" and start < streamed:
            continue  # a further page of the stream before
        if kind == "audio/mpeg" and start < framed:
            continue  # within the frames before
        if kind == "image/jpeg":
            where = _jpeg(media, start, at["jpeg end"])
        elif kind == "application/pdf":
            where = _pdf(media, start, at["pdf end"], at[kind])
        elif kind == "application/zip":
            if start < zipped and start not in zips:
                continue  # a further entry of the file before
            where = zips.get(start)
            zipped = max(zipped, where[0]) if where else zipped
        elif kind in ("audio/wav", "video/mp4"):
            named = (_riff if kind == "audio/wav" else _boxes)(media, start)
            kind, where = named or (kind, None)
        else:
            where = PLAIN_VALIDATORS[kind](media, start)
        if where is None:
            refused += 1
            continue
        found.append((kind, start, *where))
        if kind == "audio/ogg":
            streamed = where[0]
        if kind == "audio/mpeg":
            framed = where[0]
    return found, refused


def stored_text(text: str) -> tuple[int, bytes]:
    """Bytes of a text, and the media that hold them, padded to whole blocks."""
    raw = text.encode()
    return len(raw), stored_as_wave(raw + PAD * (-len(raw) % BLOCK if raw else BLOCK))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared_type, media (binary)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("declared_type", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                sizes, stored = zip(*map(stored_text, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([DECLARED] * len(sizes)), pa.array(stored, pa.binary())], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


SNIFFED = T.StructType(
    [
        T.StructField("media_type", T.StringType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("payload_start", T.LongType()), ("payload_end", T.LongType()))]))),
        T.StructField("refused", T.LongType()),
    ]
)


def typed(media: bytes | None, declared: str | None) -> tuple[str | None, list[tuple[str, int, int, int, int]], int]:
    """The type that holds, the segments, and the hits refused."""
    found, refused = segments(media) if media is not None else ([], 0)
    return (found[0][0] if found and found[0][1] == 0 else declared), found, refused


def sniffed(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The table with media_type (the declared one where nothing at offset zero is confirmed), segments and refused hits."""
    added = [T.StructField(f.name, f.dataType) for f in SNIFFED]
    own = {f.name.lower() for f in added}
    clash = [c for c in media.columns if c.lower() in own]
    if clash:
        media = media.drop(*clash)
    schema = T.StructType([*media.schema.fields, *added])
    at, declared = media.columns.index(media_col), media.columns.index("declared_type")

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                types, parts, refused = [], [], []
                for b, said in zip(part.column(at).to_pylist(), part.column(declared).to_pylist()):
                    kind, found, no = typed(b, said)
                    types.append(kind)
                    parts.append([dict(zip(("type", "start", "end", "payload_start", "payload_end"), x)) for x in found])
                    refused.append(no)
                kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("payload_start", pa.int64()), ("payload_end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(types, pa.string()), pa.array(parts, kind), pa.array(refused, pa.int64())], schema.names)

    return media.mapInArrow(run, schema)


FEATURES = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def described(b: bytes, kind: str | None, found: list[tuple[str, int, int, int, int]], refused: int) -> tuple:
    """FEATURES of the payload read back from the first confirmed segment, or of all bytes if none begins the media."""
    read = b[found[0][3] : found[0][4]] if found and found[0][1] == 0 else b
    samples = np.frombuffer(read, np.uint8)
    blocks = samples.reshape(-1, BLOCK).mean(1) if samples.size and samples.size % BLOCK == 0 else np.zeros(1)
    edges = int(np.count_nonzero(np.diff(samples >= 128))) if samples.size else 0
    carved = ",".join(f"{x[0]}@{x[1]}-{x[2]}" for x in found[1:])
    levels = "/".join(map(str, np.bincount(samples >> 5, minlength=8).tolist()))
    feature = f"{kind};rate={RATE};levels={levels};crossings={edges};blocks={len(blocks)};low={blocks.min():.3f};high={blocks.max():.3f};refused={refused};carved={carved}"
    return len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature


def _columns(rows: list[tuple], types: list) -> list[pa.Array]:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return [pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)]


def media_features(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes and FEATURES of sniffed media; null media have null features."""
    schema = T.StructType([found.schema["doc_id"], T.StructField("n_bytes", T.LongType()), *(T.StructField(n, t) for n, t in FEATURES)])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                rows = []
                for b, kind, parts, refused in zip(*(part.column(i).to_pylist() for i in range(2, 6))):
                    rows.append((None,) * len(FEATURES) if b is None else described(b, kind, [tuple(p.values()) for p in parts], refused))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_columns(rows, [t for _, t in FEATURES])], schema.names)

    return found.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "media", "media_type", "segments", "refused").mapInArrow(run, schema)


def described_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, FEATURES, declared_type, media_type: texts stored, sniffed and read back in one pass, so that media do not leave the worker."""
    kinds = [("n_bytes", T.LongType()), *FEATURES, ("declared_type", T.StringType()), ("media_type", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in kinds)])

    def one(text: str) -> tuple:
        n, media = stored_text(text)
        kind, found, refused = typed(media, DECLARED)
        return n, *described(media, kind, found, refused), DECLARED, kind

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                rows = [one(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(rows, [t for _, t in kinds])], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
