"""Line deduplication by a segment-partition edit join.

A line within t edits of another holds one of that line's t + 1 segments unchanged, at nearly the
same place. Lines are filed under their segments and under the substrings that could be a segment of an equally
long or slightly shorter line; lines that meet are compared by a bigram signature that t edits can
change little, and then by banded bit-parallel edit distance. Large groups are dealt out again by what
else their lines share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

MAX_EDITS, CHARS_PER_EDIT = 2, 20
#: Groups above so many lines are compared in blocks; those with more than DENSE candidates a line by their texts.
_SMALL, _DENSE, _BLOCK = 48, 16, 512
#: Groups above so many rows are dealt out again by finer keys.
GROUP_ROWS = 4096
_DIGITS, _DIGITS2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def edits_allowed(chars: int) -> int:
    """Edits that make two lines near-duplicates, by the shorter one's length: one in 20 characters, 2 at most."""
    return min(MAX_EDITS, chars // CHARS_PER_EDIT)


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a bit-parallel band along the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) <= most
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    band = 2 * most + 1
    ones, bottom = (1 << band) - 1, band - 1
    # bit k stands for row j - most + k of column j; rows above the first hold no differences
    up, down, distance = ones & ~((1 << most) - 1), 0, min(most, m)
    for j, c in enumerate(b, 1):
        shift, equal = j - most - 1, place.get(c, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & ones
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & ones
        right, left = (down | ~(diagonal | up)) & ones, diagonal & up
        if j + most <= m:
            distance += not diagonal >> bottom & 1
        else:
            row = m - j + most
            distance += (right >> row & 1) - (left >> row & 1)
        up = (left | ~(diagonal >> 1 | right)) & ones
        down = diagonal >> 1 & right
    return distance <= most


def segments(chars: int) -> list[tuple[int, int]]:
    """(first, end) of the segments of a line of that length, as even as can be."""
    parts = edits_allowed(chars) + 1
    marks = [chars * i // parts for i in range(parts + 1)]
    return list(zip(marks, marks[1:]))


def probes(chars: int) -> list[tuple[int, int, int, int]]:
    """(length, segment, first, end): the substrings of a line that may be a segment of a line of ``length``.

    A segment with i before it can have moved by i edits at most, counted from the left, and by as many as
    segments come after it, counted from the right.
    """
    out = []
    for length in range(max(0, chars - MAX_EDITS), chars + 1):
        allowed, gap = edits_allowed(length), chars - length
        if gap > allowed or not allowed:
            continue
        for i, (a, b) in enumerate(segments(length)):
            low = max(a - i, a + gap - (allowed - i), 0)
            high = min(a + i, a + gap + (allowed - i), chars - (b - a))
            out += [(length, i, p, p + b - a) for p in range(low, high + 1)]
    return out


_probes: dict[int, list[tuple[int, int, int, int]]] = {}


def _split(text: str | None):
    """(line, half of its hash) of each line; blank lines have None for a hash."""
    for line, digest in _digests(text):
        yield line, None if digest is None else (digest & (2**64 - 1)) - 2**63


def _digests(text: str | None):
    """(line, its 128-bit hash) of each line; blank lines have None for a hash."""
    from xxhash import xxh3_128_intdigest

    for line in (text or "").split("\n"):
        yield line, xxh3_128_intdigest(line.encode("utf-8", "surrogatepass")) if line.strip() else None


def signature(line: str) -> int:
    """Parities of the line's hashed bigrams in 64 bits: an edit changes 4 of them at most."""
    s = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    g = (s[:-1] * np.uint64(_DIGITS) + s[1:] * np.uint64(_DIGITS2)) >> np.uint64(58)
    return int(np.bitwise_xor.reduce(np.uint64(1) << g)) if len(g) else 0


def _probes_of(chars: int) -> list[tuple[int, int, int, int]]:
    if chars not in _probes:
        if len(_probes) > 20_000:
            _probes.clear()
        _probes[chars] = probes(chars)
    return _probes[chars]


def file_line(line: str) -> list[int]:
    """Keys of a line: its own segments and the segments of others that it may hold."""
    from xxhash import xxh3_64_intdigest

    wide = line.encode("utf-32-le", "surrogatepass")
    return list({xxh3_64_intdigest(wide[4 * a : 4 * b], (length << 8 | i)) - 2**63 for length, i, a, b in _probes_of(len(line))})


def pieces(length: int, segment: int) -> list[tuple[bool, int, int]]:
    """(right of the segment, first, end): what is left of a line without a segment, cut in more pieces than edits are allowed."""
    edits, (a, b) = edits_allowed(length), segments(length)[segment]
    parts = -(-(edits + 1) // 2) if 0 < a and b < length else edits + 1
    return [
        (right, low + (high - low) * k // parts, low + (high - low) * (k + 1) // parts)
        for right, low, high in ((False, 0, a), (True, b, length)) if high > low for k in range(parts)
    ]


def refile_line(key: int, line: str) -> list[int]:
    """Finer keys of a line of the group ``key``.

    Two near lines that share a segment share a piece of the rest too, moved by no more places than edits are
    allowed: a line is filed under all that could be such a piece.
    """
    from xxhash import xxh3_64_intdigest

    wide, out = line.encode("utf-32-le", "surrogatepass"), set()
    for length, i, a, b in _probes_of(len(line)):
        if xxh3_64_intdigest(wide[4 * a : 4 * b], (length << 8 | i)) - 2**63 != key:
            continue
        edits, end = edits_allowed(length), segments(length)[i][1]
        for number, (right, u, v) in enumerate(pieces(length, i)):
            move, low, high = (b - end, b, len(line)) if right else (0, 0, a)
            for at in range(u + move - edits, u + move + edits + 1):
                if low <= at and at + v - u <= high:
                    out.add(xxh3_64_intdigest(wide[4 * at : 4 * (at + v - u)], (key + number * _DIGITS) & (2**64 - 1)) - 2**63)
    return list(out)


def candidates(ids: np.ndarray, signs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Pairs of one group's lines whose signatures are near; None if there are too many for its size."""
    near, total = [], 0
    for a in range(0, len(ids), _BLOCK):
        for b in range(a, len(ids), _BLOCK):
            x, y = np.nonzero(np.bitwise_count(signs[a : a + _BLOCK, None] ^ signs[None, b : b + _BLOCK]) <= 4 * MAX_EDITS)
            keep = x + a < y + b
            near.append((ids[x[keep] + a], ids[y[keep] + b]))
            total += int(keep.sum())
            if len(ids) > _SMALL and total > _DENSE * len(ids):
                return None
    return near


def _groups(batches, columns: int, most: int | None = None):
    """(column arrays, True) of whole groups of rows: ``batches`` come sorted by their first column.

    Rows of a group of over ``most`` that spans batches come as they are read, with False.
    """
    held = large = None
    for batch in batches:
        now = [batch.column(i) for i in range(columns)]
        held = now if held is None else [pa.concat_arrays([h, n]) for h, n in zip(held, now)]
        keys = held[0].to_numpy(zero_copy_only=False)
        if large is not None and len(keys):
            more = int(np.searchsorted(keys, large, side="right"))
            if more:
                yield [h.slice(0, more) for h in held], False
            held, keys = [h.slice(more) for h in held], keys[more:]
            large = None if len(keys) else large
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield [h.slice(0, done) for h in held], True
            held = [pa.concat_arrays([h.slice(done)]) for h in held]
        if most and len(held[0]) > most:
            large = keys[-1]
            yield held, False
            held = None
    if held is not None and len(held[0]):
        yield held, True


def _starts(keys: np.ndarray) -> list[tuple[int, int]]:
    marks = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return list(zip(marks, [*marks[1:], len(keys)]))


#: Kinds of rows that ``_meet`` gives.
PAIR, DENSE, LARGE = 0, 1, 2


def _meet(batches, most: int | None):
    """(kind, a, b, key): candidate pairs; (DENSE, a, null, key) and (LARGE, a, null, key) for each line of such a group."""
    for (key, line, sign), whole in _groups(batches, 3, most):
        keys, ids, signs = (c.to_numpy(zero_copy_only=False) for c in (key, line, sign))
        signs = signs.view(np.uint64)
        left, right, alone = [], [], []
        for a, b in _starts(keys):
            if whole and b - a < 2:
                continue
            own, first = np.unique(ids[a:b], return_index=True)
            if not whole or most and b - a > most:
                alone.append((LARGE, keys[a], own))
                continue
            if len(own) < 2:
                continue
            found = candidates(own, signs[a:b][first])
            if found is None:
                alone.append((DENSE, keys[a], own))
            else:
                left += [x for x, _ in found]
                right += [y for _, y in found]
        none = np.array([], np.int64)
        left, right, members = np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([none, *(o for _, _, o in alone)])
        is_pair = np.arange(len(left) + len(members)) < len(left)
        kinds, groups = (np.concatenate([none, *(np.full(len(x[2]), x[i], np.int64) for x in alone)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(left), PAIR), kinds]).astype(np.int32)), pa.array(np.concatenate([left, members])),
             pa.array(np.concatenate([right, members]), mask=~is_pair), pa.array(np.concatenate([left, groups]), mask=is_pair)],
            ["kind", "a", "b", "key"],
        )


def _verify(batches):
    for batch in sliced(batches, 1024):
        a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
        keep = [edit_distance_within(s, t, edits_allowed(min(len(s), len(t)))) for s, t in zip(x, y)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([i for i, k in zip(a, keep) if k], pa.int64()), "b": pa.array([i for i, k in zip(b, keep) if k], pa.int64())})


def _verify_dense(batches):
    """For each line of a dense group the first line before it, in the order given, that is near."""
    for (key, line, text), _ in _groups(batches, 3):
        ids, texts = line.to_pylist(), text.to_pylist()
        out = []
        for a, b in _starts(key.to_numpy(zero_copy_only=False)):
            signs = np.array([signature(t) for t in texts[a:b]], np.uint64)
            for i in range(a + 1, b):
                near = np.flatnonzero(np.bitwise_count(signs[: i - a] ^ signs[i - a]) <= 4 * MAX_EDITS)
                for k in near.tolist():
                    s, t = texts[a + k], texts[i]
                    if edit_distance_within(s, t, edits_allowed(min(len(s), len(t)))):
                        out.append((ids[a + k], ids[i]))
                        break
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def repeated_lines(df: DataFrame, text: str = "text", key: str = "doc_id", most: int = GROUP_ROWS) -> DataFrame:
    """(key, row, line): the lines to drop, numbered from 0; ``row`` is a hash of the row's text.

    A line is dropped if an equal line stands before it, by key (null first), text hash and place, or if some line whose first
    place is before its own first place is within ``edits_allowed`` of it. Blank lines stay.
    Rows equal in key and text count as one document. Groups of over ``most`` rows that share a segment are split.
    """
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def place(batches):
        for batch in sliced(batches):
            at, number, ids, halves = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for k, (_, h) in enumerate(_digests(t)):
                    if h is not None:
                        at.append(i)
                        number.append(k)
                        ids.append((h & (2**64 - 1)) - 2**63)
                        halves.append((h >> 64) - 2**63)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(halves, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32())],
                ["id", "half", "key", "row", "line"],
            )

    def file(batches):
        seen: set[int] = set()  # lines this task has filed lately
        for batch in sliced(batches):
            keys, ids, signs = [], [], []
            for t in batch.column(0).to_pylist():
                for line, h in _split(t):
                    if h is None or h in seen or not edits_allowed(len(line) + MAX_EDITS):
                        continue
                    seen.add(h)
                    own, sign = file_line(line), signature(line)
                    keys += own
                    ids += [h] * len(own)
                    signs += [sign] * len(own)
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.array(signs, np.uint64).view(np.int64))], ["key", "id", "sign"])

    places = materialize(rows.mapInArrow(place, f"id long, half long, key {kind}, row long, line int"), "places")
    def refile(batches):
        for batch in sliced(batches, 1024):
            keys, ids, signs = [], [], []
            for k, h, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own, sign = refile_line(k, line), signature(line)
                keys += own
                ids += [h] * len(own)
                signs += [sign] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.array(signs, np.uint64).view(np.int64))], ["key", "id", "sign"])

    def meeting(filed: DataFrame, limit: int | None) -> DataFrame:
        dealt = filed.repartition("key").sortWithinPartitions("key")
        return materialize(dealt.mapInArrow(lambda batches: _meet(batches, limit), "kind int, a long, b long, key long").distinct(), "met")

    met = meeting(rows.select("text").mapInArrow(file, "key long, id long, sign long"), most)

    # lines are equal if both halves of their hashes are; one half names them where texts are compared anyway
    first = materialize(places.groupBy("id", "half").agg(F.min(F.struct("key", "row", "line")).alias("first"), F.count("*").alias("n")), "first")
    wanted = met.select(F.col("a").alias("id")).union(met.filter("b is not null").select("b")).distinct()
    bits = wanted.groupBy(F.shiftright(F.col("id").bitwiseAND((1 << 24) - 1), 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits")
    ).collect()  # fmt: skip  # at most 2**18 rows
    bloom = np.zeros(1 << 18, np.uint64)
    for word, value in bits:
        bloom[word] = value & (2**64 - 1)
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    def texts(batches):
        filter_ = shared.value
        for batch in sliced(batches):
            ids, out = [], []
            for t in batch.column(0).to_pylist():
                for line, h in _split(t):
                    if h is not None and int(filter_[(h & (1 << 24) - 1) >> 6]) >> (h & 63) & 1:
                        ids.append(h)
                        out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["id", "line"])

    known = rows.select("text").mapInArrow(texts, "id long, line string").dropDuplicates(["id"]).join(wanted, "id", "left_semi")
    known = materialize(known, "candidate-lines")
    large = met.filter(F.col("kind") == LARGE).select("key", F.col("a").alias("id"))
    if not large.isEmpty():
        finer = large.join(known, "id").select("key", "id", "line").mapInArrow(refile, "key long, id long, sign long")
        met = met.filter(F.col("kind") != LARGE).union(meeting(finer, None))
    pairs, dense = met.filter(F.col("kind") == PAIR).select("a", "b").distinct(), met.filter(F.col("kind") == DENSE)
    x, y = (known.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    links = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "line_a", "line_b").mapInArrow(_verify, "a long, b long")
    ordered = dense.select("key", F.col("a").alias("id")).join(known, "id").join(first.select("id", "first"), "id")
    ordered = ordered.repartition("key").sortWithinPartitions("key", "first").select("key", "id", "line")
    links = links.union(ordered.mapInArrow(_verify_dense, "a long, b long"))

    fa, fb = (first.select(F.col("id").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    later = links.join(fa, "a").join(fb, "b").select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    status = first.select("id", "half", "first", "n").join(later.withColumn("near", F.lit(True)), "id", "left").filter("n > 1 or near")
    status = materialize(status, "lines")
    here = F.struct("key", "row", "line")
    return (
        places.join(status, ["id", "half"]).filter(F.col("near") | (here != F.col("first")))
        .select(F.col("key").alias(key), "row", "line")
    )


def drop_repeated(df: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = False) -> DataFrame:
    """``df`` with the repeated lines taken out of its texts; every row stays, null texts stay null.

    With ``counts`` n_lines and n_dropped are added, and replace columns of these names.
    """
    gone = repeated_lines(df, text, key).distinct().groupBy(F.col(key).alias("_key"), F.col("row").alias("_at")).agg(F.collect_list("line").alias("_gone"))
    # null keys match null keys; the row's hash alone does not tell documents apart
    new = ("n_lines", "n_dropped") if counts else ()
    names = [c for c in df.columns if c not in new]
    rest = [c for c in names if c not in (key, text)]
    base = df.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(key).alias("_own"), F.xxhash64(text).alias("_hash"), F.split(text, "\n", -1).alias("_lines")
    )
    both = base.join(gone, (F.col("_hash") == F.col("_at")) & F.col("_own").eqNullSafe(F.col("_key")), "left")
    # linear in the lines: what is left of all places, and the lines that stand there
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i)))
    cells = {c: F.col(f"_row.`{c}`") for c in rest} | {key: F.col("_own")}
    cells[text] = F.array_join(kept, "\n")
    if counts:
        cells["n_lines"] = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
        cells["n_dropped"] = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    return both.select(*(cells[c].alias(c) for c in (*names, *new)))
