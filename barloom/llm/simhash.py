"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into segments; if two differ in at most d bits, they differ in at
most d // segments bits of some segment. Each distinct fingerprint is filed under its segments and under
the small Hamming balls around them, and fingerprints that meet are compared in full. Buckets with many
fingerprints are dealt out again by the bits outside their segment.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, unboxed
from .components import connected_components

SHINGLE_WORDS, DISTANCE, SEGMENTS, SEED = 3, 3, 2, 42
_CHUNK = 1 << 16
#: Groups above so many rows are searched breadth-first and give a spanning forest of their links.
_SMALL = 16
#: Groups above so many rows are dealt out again by finer keys; each row is filed under every so many pieces of the other bits.
GROUP_ROWS, PIECES = 4096, 3
_SPREAD = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' XXH64 hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans[at : at + _CHUNK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit integer."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def _segment(s: int, segments: int) -> tuple[int, int]:
    """(lowest bit, number of bits) of a segment."""
    low = sum(64 // segments + (k >= segments - 64 % segments) for k in range(s))
    return low, 64 // segments + (s >= segments - 64 % segments)


def file_keys(fps: np.ndarray, distance: int = DISTANCE, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the buckets of each fingerprint.

    Of two segments that differ, only the one with 0 at the highest differing bit is filed in
    the other's bucket, so that each pair meets from one side.
    """
    keys, rows = [], []
    for s in range(segments):
        low, bits = _segment(s, segments)
        value = (fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        for mask in _masks(bits, distance // segments):
            if mask:
                at = np.flatnonzero(value & np.uint64(1 << (int(mask).bit_length() - 1)) == 0)
            else:
                at = np.arange(len(fps))
            # segment and value make one number, spread over 64 bits
            keys.append(((value[at] ^ mask) * np.uint64(segments) + np.uint64(s)) * np.uint64(_SPREAD))
            rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def finer_keys(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): buckets that split the large ones of ``file_keys``.

    The bits outside a bucket's segment are cut into distance + PIECES pieces. Linked fingerprints have PIECES of them in
    common at least, so each is filed under every so many pieces, together with its bucket. With the two segments of
    32 bits of the default a split bucket can hold 33 * 2**17 fingerprints at most, whatever the input.
    """
    if segments == 1:  # nothing is outside; a bucket is one Hamming ball
        return keys, np.arange(len(keys))
    segment = keys * np.uint64(pow(_SPREAD, -1, 1 << 64)) % np.uint64(segments)
    out, rows = [], []
    for s in range(segments):
        at = np.flatnonzero(segment == s)
        low, bits = _segment(s, segments)
        below = fps[at] & np.uint64((1 << low) - 1)
        above = fps[at] >> np.uint64(low + bits) if low + bits < 64 else np.zeros(len(at), np.uint64)
        rest, parts = below | above << np.uint64(low), distance + PIECES
        marks = [(64 - bits) * i // parts for i in range(parts + 1)]
        piece = [rest >> np.uint64(a) & np.uint64((1 << (b - a)) - 1) for a, b in zip(marks, marks[1:])]
        for number, chosen in enumerate(combinations(piece, PIECES)):
            key = keys[at] ^ np.uint64(number)
            for value in chosen:
                key = (key ^ key >> np.uint64(29) ^ value) * np.uint64(_SPREAD)
            out.append(key)
            rows.append(at)
    return np.concatenate(out), np.concatenate(rows)


def links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints among the rows of equal keys; ``keys`` is sorted.

    Large groups give a spanning forest: every two rows that any chain of links in the group joins
    are joined by it.
    """
    left, right = [], []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, _SMALL):
        at = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(at):
            break
        a, b = fps[at], fps[at + d]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        left.append(a[near])
        right.append(b[near])
    for k in np.flatnonzero(sizes > _SMALL):
        rest = np.unique(fps[starts[k] : starts[k] + sizes[k]])
        while len(rest):
            front, rest = rest[:1], rest[1:]
            while len(front) and len(rest):
                x, front = front[0], front[1:]
                near = np.bitwise_count(rest ^ x) <= distance
                found = rest[near]
                left.append(np.full(len(found), x))
                right.append(found)
                front, rest = np.concatenate([front, found]), rest[~near]
    none = np.array([], np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _meet(batches, distance: int, most: int | None):
    """(a, b, key): links without key; (fp, null, key) for each row of a group of over ``most``. Batches come sorted by key.

    Rows of a large group are passed on as they come, so no more than ``most`` of one are held.
    """
    keys, fps, large = np.array([], np.int64), np.array([], np.int64), None

    def out(k, f):
        runs = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.array([], int)
        sizes = np.diff(np.append(runs, len(k)))
        late = np.repeat(sizes > most, sizes) if most else np.zeros(len(k), bool)
        return *links(k[~late], f[~late].view(np.uint64), distance), k[late], f[late]

    def pack(a, b, k, f):
        is_link = np.arange(len(a) + len(f)) < len(a)
        both = lambda x, y: np.concatenate([x.astype(np.int64), y.astype(np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array(both(a.view(np.int64), f)), pa.array(both(b.view(np.int64), f), mask=~is_link), pa.array(both(a.view(np.int64), k), mask=is_link)], ["a", "b", "key"]
        )

    none = np.array([], np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
        if large is not None and len(keys):  # more rows of a group that was passed on
            more = np.searchsorted(keys, large, side="right")
            yield pack(none, none, keys[:more], fps[:more])
            keys, fps = keys[more:], fps[more:]
            large = None if len(keys) else large
        done = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
        if done:
            yield pack(*out(keys[:done], fps[:done]))
            keys, fps = keys[done:], fps[done:]
        if most and len(keys) > most:
            large = keys[0]
            yield pack(none, none, keys, fps)
            keys, fps = keys[:0], fps[:0]
    yield pack(*out(keys, fps))


def link_table(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, most: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between the fingerprints of a one-column table of distinct ones.

    Every linked pair is joined by a chain of the links returned. Groups of over ``most`` fingerprints are split.
    """

    def file(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, rows = file_keys(fps, distance, segments)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    def refile(batches):
        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            finer, rows = finer_keys(keys, fps, distance, segments)
            yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "fp"])

    def meeting(filed: DataFrame, limit: int | None) -> DataFrame:
        dealt = filed.repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(lambda batches: _meet(batches, distance, limit), "a long, b long, key long")

    met = materialize(meeting(distinct.mapInArrow(file, "key long, fp long"), most), "met")
    large = met.filter("key is not null").select("key", "a").mapInArrow(refile, "key long, fp long")
    return met.filter("key is null").select("a", "b").union(meeting(large, None).select("a", "b")).distinct()


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE_WORDS,
                    distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(key, fingerprint, component_id): one row per row of ``df``.

    component_id is the smallest key reachable over links of at most ``distance`` differing bits. Null and
    blank texts have the fingerprint 0 and are linked like any other. Null keys stay and are
    never the smallest unless a component has no other.
    """
    prints = materialize(fingerprints(df, text, key, words_per_shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("_least"))
    edges = link_table(distinct.select("fp"), distance, segments)
    label = connected_components(edges)
    named = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("component", "fp").alias("_label"))
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    known = materialize(named.join(least, "_label").select("fp", "component_id"), "components")
    return prints.join(known, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words_per_shingle: int = SHINGLE_WORDS,
             distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``df`` but one document only of each component: that with the smallest key, then the smallest hash.

    Rows equal in key and text become one.
    """
    marked = df.select(boxed(df), F.xxhash64(F.col(key), F.col(text)).alias("_id"))
    who = df.select(F.struct(F.xxhash64(F.col(key), F.col(text)).alias("_id"), F.col(key).alias("_key")).alias("_who"), F.col(text).alias("_text"))
    prints = materialize(fingerprints(who, "_text", "_who", words_per_shingle), "fingerprints")
    rows = prints.select("fp", F.col("_who._id").alias("_id"), F.col("_who._key").alias("_key"))
    distinct = rows.groupBy("fp").agg(F.min(F.struct("_key", "_id")).alias("_least"))
    label = connected_components(link_table(distinct.select("fp"), distance, segments))
    named = distinct.join(label, F.col("fp") == F.col("node"), "left").select("_least", F.coalesce("component", "fp").alias("_label"))
    kept = materialize(named.groupBy("_label").agg(F.min("_least").alias("_least")).select(F.col("_least._id").alias("_id")).distinct(), "kept")
    return marked.join(kept, "_id", "left_semi").dropDuplicates(["_id"]).select(*unboxed(df.columns))
