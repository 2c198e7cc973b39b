"""ISO media containers as a binary column.

``encode`` stores bytes as the samples of an ISO base media file: one video track of raw 8-bit
24 x 24 frames, so that a sample is 576 bytes. ``inspect`` walks the nested boxes of any such
file, decodes the sample tables (stts, stss, stsc, stsz, stco or co64) and returns codec, duration
and the byte ranges of the keyframes. It never looks into the payload; ``payload`` does.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 24
SAMPLE = SIDE * SIDE
TIMESCALE = 25
SAMPLES_PER_CHUNK = 256
#: Boxes that hold boxes and nothing else.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, unit: int = SAMPLE) -> bytes:
    """Append bytes 255 up to a positive multiple of ``unit``."""
    size = max(1, -(-len(data) // unit)) * unit
    return data + b"\xff" * (size - len(data))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _movie(samples: int, first_byte: int) -> bytes:
    chunks = -(-samples // SAMPLES_PER_CHUNK)
    last = samples - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK if chunks > 1 else last, 1)]
    if chunks > 1 and last != SAMPLES_PER_CHUNK:
        runs.append((chunks, last, 1))
    offsets = [first_byte + i * SAMPLES_PER_CHUNK * SAMPLE for i in range(chunks)]
    wide = offsets[-1] >= 1 << 32
    entry = _box(
        b"raw ",
        struct.pack(">6xH16xHHII4xH32sHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 1, b"", 40, -1),
    )
    table = _box(
        b"stbl",
        _full(b"stsd", 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, struct.pack(">III", 1, samples, 1)),
        _full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", 0, struct.pack(">II", SAMPLE, samples)),
        _full(
            b"co64" if wide else b"stco",
            0,
            struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets),
        ),
    )
    reference = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
    info = _box(b"minf", _full(b"vmhd", 1, bytes(8)), reference, table)
    media = _box(
        b"mdia",
        _full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, samples, 0x55C4, 0)),
        _full(b"hdlr", 0, struct.pack(">I4s12xB", 0, b"vide", 0)),
        info,
    )
    track = _box(
        b"trak",
        _full(
            b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, samples, 0, 0, 0, 0), MATRIX,
            struct.pack(">II", SIDE << 16, SIDE << 16),
        ),
        media,
    )
    header = _full(
        b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, samples, 0x10000, 0x100), MATRIX,
        bytes(24), struct.pack(">I", 2),
    )
    return _box(b"moov", header, track)


def write_container(data: bytes) -> bytes:
    """Bytes of a file that holds ``pad(data)`` as raw frames; the same bytes for the same data."""
    body = pad(data)
    samples = len(body) // SAMPLE
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 8 if len(body) + 8 < 1 << 32 else 16
    first = 0
    for _ in range(3):  # the offsets' width may change the size of what stands before them
        movie = _movie(samples, first)
        first = len(kind) + len(movie) + head
    return kind + movie + _box(b"mdat", body)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the bodies of the boxes in a byte range.

    A size of 0 runs to the end of the range, 1 announces a 64-bit size. A box that claims more
    than its parent holds is an error.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = size or end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit into its parent")
        yield kind, start + head, start + size
        start += size


def _tree(data: bytes, start: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    """Bodies of all boxes below a container, by kind, in file order."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    stack = [(start, end)]
    while stack:
        for kind, a, b in boxes(data, *stack.pop()):
            found.setdefault(kind, []).append((a, b))
            if kind in CONTAINERS:
                stack.append((a, b))
    return found


def _table(data: bytes, span: tuple[int, int], width: int, code: str = "I") -> list[tuple[int, ...]]:
    a, b = span
    count = struct.unpack_from(">I", data, a + 4)[0]
    size = struct.calcsize(f">{width}{code}")
    if a + 8 + count * size > b:
        raise ValueError("sample table is longer than its box")
    return list(struct.iter_unpack(f">{width}{code}", data[a + 8 : a + 8 + count * size]))


def tracks(data: bytes) -> list[dict]:
    """Codec, timing, sample and keyframe byte ranges of each track, from the boxes alone."""
    out = []
    for kind, a, b in boxes(data):
        if kind != b"moov":
            continue
        for kind_, ta, tb in boxes(data, a, b):
            if kind_ == b"trak":
                out.append(_track(data, _tree(data, ta, tb)))
    return out


def _track(data: bytes, found: dict[bytes, list[tuple[int, int]]]) -> dict:
    a, _ = found[b"mdhd"][0]
    wide = data[a] == 1
    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
    codec = data[found[b"stsd"][0][0] + 12 : found[b"stsd"][0][0] + 16].decode("latin-1")
    a, b = found[b"stsz"][0]
    fixed, count = struct.unpack_from(">II", data, a + 4)
    if fixed:
        sizes = [fixed] * count
    else:
        if a + 12 + 4 * count > b:
            raise ValueError("sample table is longer than its box")
        sizes = list(struct.unpack_from(f">{count}I", data, a + 12))
    if b"co64" in found:
        chunks = [x for (x,) in _table(data, found[b"co64"][0], 1, "Q")]
    else:
        chunks = [x for (x,) in _table(data, found[b"stco"][0], 1)]
    runs = _table(data, found[b"stsc"][0], 3)
    offsets: list[int] = []
    for k, (first, per_chunk, _) in enumerate(runs):
        stop = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for chunk in range(first - 1, stop - 1):
            at = chunks[chunk]
            for _ in range(min(per_chunk, count - len(offsets))):
                offsets.append(at)
                at += sizes[len(offsets) - 1]
    if len(offsets) != count:
        raise ValueError("chunks hold fewer samples than the size table names")
    times = list(itertools.chain.from_iterable([d] * n for n, d in _table(data, found[b"stts"][0], 2)))
    keys = [i - 1 for (i,) in _table(data, found[b"stss"][0], 1)] if b"stss" in found else range(count)
    return {
        "codec": codec, "timescale": timescale, "duration": duration, "samples": count,
        "sample_time": sum(times), "offsets": offsets, "sizes": sizes,
        "keyframes": [(offsets[i], sizes[i]) for i in keys],
    }


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges (start, length) with those that touch made one."""
    out: list[tuple[int, int]] = []
    for at, size in ranges:
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((at, size))
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The samples of a track in decoding order."""
    return b"".join(data[a : a + n] for a, n in merged(list(zip(track["offsets"], track["sizes"]))))


def feature(found: list[dict]) -> str:
    """One line for the tracks: codec, duration, samples and merged keyframe byte ranges."""
    return ";".join(
        f"codec={t['codec'].strip()},duration={t['duration']}/{t['timescale']},samples={t['samples']},"
        f"keyframes={len(t['keyframes'])}@" + "+".join(f"{a}:{n}" for a, n in merged(t["keyframes"]))
        for t in found
    )


def encode(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each text (null: empty) as UTF-8 in a container of its own.

    Repeated keys and texts give one row each; other columns are left out, whatever their names.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([write_container(x) for x in raw], pa.binary())],
                [key, "n_bytes", "media"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_bytes long, media binary")


def inspect(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace the media column by what its bytes say.

    Adds media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 (of the last
    32 payload bytes) and feature. A null media value gives nulls; a malformed one gives its size
    and digest, null payload columns and a feature that starts with ``error=``.
    """
    kept = [f for f in df.schema.fields if f.name != media]
    added = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    names = [f.name for f in kept]

    def look(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        head = (len(data), hashlib.sha256(data).hexdigest())
        try:
            found = tracks(data)
            body = b"".join(payload(data, t) for t in found)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (*head, None, None, None, f"error={e}")
        return (*head, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), feature(found))

    def run(batches):
        for batch in batches:
            rows = [look(x) for x in batch.column(len(names)).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                [*names, *(c.split()[0] for c in added.split(", "))],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.select(*(f"`{n}`" for n in names), media).mapInArrow(run, f"{schema}, {added}")
