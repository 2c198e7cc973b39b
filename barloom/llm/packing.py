"""Best-fit packing of token pieces into sequences after a dominance reduction.

The plan is made on the histogram of piece lengths: at most ``capacity`` numbers, however many
pieces there are. Martello and Toth's reduction first fixes small sets of lengths that provably
belong to some best packing, for all their pieces at once; best-fit-decreasing places the rest.
Both give patterns (lengths of a sequence, how often), which the pieces then fill by their rank
within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, uniform
from .tokens import default_vocabulary, encoder

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked in groups of about so many.
GROUP_ROWS = 1024

Pattern = tuple[tuple[int, ...], int]


class _Counts:
    """Pieces left of each length, with the largest length up to a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.n)

    def most(self, bound: int) -> int:
        """Largest length up to ``bound`` that is left, or 0."""
        i = bisect_left(self.lengths, bound + 1)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect_left(self.lengths, length))


def reduce(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the histogram that is left.

    For the longest piece j, with room r = capacity - j, let k be the longest piece that fits
    beside it. {j} dominates if nothing fits. {j, k} dominates if k fills the room, since whatever
    stands beside j elsewhere can change places with k, or if no two pieces fit into the room
    together, since j then has one companion at most, no longer than k. Both stay true while
    pieces are taken away, so equal sets are fixed at once. A length for which no set dominates is
    passed over; the pass is repeated as long as one fixes something.
    """
    left = _Counts(histogram)
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in list(reversed(left.lengths)):
            while left.n.get(j):
                n = left.n[j]
                room = capacity - j
                left.take(j, n)  # what can stand beside one j: the other pieces
                k = left.most(room)
                if n > 1 and j <= room:
                    k = max(j, k)
                if not k:
                    fixed.append(((j,), n))
                    changed = True
                    continue
                two = _two_least(left, j, n)
                if k == room or two > room:
                    if k == j:
                        pairs = n // 2
                        fixed.append(((j, j), pairs))
                        if n % 2:
                            _give(left, j, 1)
                    else:
                        m = min(n, left.n[k])
                        left.take(k, m)
                        fixed.append(((j, k), m))
                        if n > m:
                            _give(left, j, n - m)
                    changed = True
                    continue
                _give(left, j, n)
                break
    return fixed, dict(left.n)


def _two_least(left: _Counts, j: int, n: int) -> int:
    """Least sum of two pieces besides one j; more than any capacity if there are not two."""
    least: list[int] = []
    for length in [*left.lengths[:2], *([j] if n > 1 else [])]:
        least += [length] * min(2, n - 1 if length == j else left.n[length])
    least.sort()
    return sum(least[:2]) if len(least) > 1 else 1 << 62


def _give(left: _Counts, length: int, count: int) -> None:
    if length not in left.n:
        insort(left.lengths, length)
    left.n[length] = left.n.get(length, 0) + count


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit-decreasing: each piece goes where the least room is left, longest pieces first.

    Equal sequences are handled together, so the work depends on the lengths, not on the pieces.
    """
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}
    done: list[Pattern] = []

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done.append((pattern, count))
            return
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, full, capacity - each * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                break
            room = rooms[i]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // length
            whole = min(count, n // each)
            if whole:
                put(pattern + (length,) * each, whole, room - each * length)
                n -= whole * each
            if count > whole:
                if n and n < each:
                    put(pattern + (length,) * n, 1, room - n * length)
                    count, n = count - 1, 0
                if count > whole:
                    put(pattern, count - whole, room)
    return done + [(p, c) for group in open_.values() for p, c in group]


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that take every piece of the histogram once."""
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    fixed, rest = reduce(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, ranks in a sequence, first sequence, offset), sorted.

    A run of equal lengths within a pattern is one row: piece r of the row stands in sequence
    first + r // run at offset + (r % run) * length.
    """
    rows, at, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = i = 0
        while i < len(pattern):
            length, run = pattern[i], 1
            while i + run < len(pattern) and pattern[i + run] == length:
                run += 1
            rows.append((length, at.get(length, 0), run, sequence, offset))
            at[length] = at.get(length, 0) + run * count
            offset += run * length
            i += run
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None,
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32): documents' ids and end id, cut only where too long.

    Null texts are empty and give one piece, the end id. Rows with equal or null keys give rows of
    their own.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        coder = encoder(path)
        for batch in sliced(batches):
            keys, out = batch.column(0), []
            for i, ids in enumerate(coder.encode_all(batch.column(1).to_pylist())):
                ids += end
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    b = min(len(ids), a + 4 * capacity)
                    out.append((i, p, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(table: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """Add sequence_id and offset to rows that have (key, piece, length).

    Every row is placed once; sequences are gapless from offset 0. ``table`` is read several
    times: give a stored one. An empty table gives an empty result.
    """
    spark = table.sparkSession
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    runs = slots(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast(runs)

    # a piece's rank within its length: the pieces before its group, and its place in the group
    groups = spark.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in histogram.items()], "length long, _groups long")
    grouped = (
        table.join(F.broadcast(groups), "length")
        .withColumn("_u", uniform(seed, F.col(key), F.col("piece")))
        .withColumn("_group", F.floor(F.col("_u") * F.col("_groups")))
        .drop("_groups")
    )
    before = grouped.groupBy("length", "_group").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_group")) - F.col("count")
    )
    place = Window.partitionBy("length", "_group").orderBy("_u", key, "piece", "start", "ids_crc32")
    ranked = (
        grouped.withColumn("_place", F.row_number().over(place) - 1)
        .join(before.select("length", "_group", "_before"), ["length", "_group"])
        .withColumn("_rank", F.col("_before") + F.col("_place"))
    )
    names = table.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)

    def fill(batches):
        rows = shared.value
        codes = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(codes, length << 44 | rank, side="right") - 1] if len(length) else rows[:0]
            r = rank - row[:, 1]
            sequence, offset = row[:, 3] + r // np.maximum(row[:, 2], 1), row[:, 4] + r % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "_rank").mapInArrow(fill, f"{out_schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``pieces`` stored once, and packed."""
    return pack(materialize(pieces(df, text, key, vocabulary, capacity, end_id), "pieces"), key, capacity)
