"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Token capacity
flows from patterns to the quotas of their sources; every further repetition of a pattern's
documents costs more than the one before, so the flow repeats as little as it can. Each pattern's
flow is then turned into whole documents, chosen by a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, unboxed, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Documents of a pattern are chosen in groups of about so many.
GROUP_ROWS = 1024
#: Patterns and sources are solved on the driver; beyond this many the mix is refused, not cut.
MAX_PATTERNS = 100_000


def source_targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes dealt out by weight.

    Sources in code-point order, null last, take the weights in turn. No target exceeds ``most``
    times its source's size; what is over goes to the others by weight, again and again. If all
    sources are at their limit the rest is not dealt out.
    """
    names: list[str | None] = sorted(s for s in sizes if s is not None)
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest = Fraction(share) * sum(sizes.values())
    limit = {s: Fraction(most) * sizes[s] for s in names}
    target: dict[str | None, Fraction] = {}
    open_ = names
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > limit[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        target |= {s: limit[s] for s in over}
        rest -= sum(limit[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    return {s: float(target[s]) for s in names}


def route(capacity: dict[tuple, int], quota: dict, repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Flow from each membership pattern to each of its sources.

    The largest flow of least cost, where the i-th repetition of a pattern's capacity costs i. The
    costs are convex and sit on the arcs into the patterns, so shortest augmenting paths use up all
    paths through repetition i before any through i + 1: a largest flow is found for one repetition
    after the other, with earlier flow free to change its way.
    """
    patterns, sources = list(capacity), list(quota)
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in patterns}
    holders: dict = {s: [p for p in patterns if s in flow[p]] for s in sources}
    nowhere = object()  # null is a source
    used, got = dict.fromkeys(patterns, 0), dict.fromkeys(sources, 0)
    for turn in range(1, repeats + 1):
        while True:
            # breadth-first from every pattern with capacity left to a source with quota left
            came: dict = {("p", p): None for p in patterns if used[p] < turn * capacity[p]}
            line, end = deque(came), nowhere
            while line and end is nowhere:
                side, x = line.popleft()
                if side == "p":
                    steps = [("s", s) for s in x if s in got]
                else:
                    if got[x] < quota[x]:
                        end = x
                        break
                    steps = [("p", p) for p in holders[x] if flow[p][x] > 0]
                for step in steps:
                    if step not in came:
                        came[step] = (side, x)
                        line.append(step)
            if end is nowhere:
                break
            path = [("s", end)]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            first = path[0][1]
            amount = min(turn * capacity[first] - used[first], quota[end] - got[end])
            for (side, a), (_, b) in zip(path, path[1:]):
                if side == "s":
                    amount = min(amount, flow[b][a])
            for (side, a), (_, b) in zip(path, path[1:]):
                if side == "p":
                    flow[a][b] += amount
                else:
                    flow[b][a] -= amount
            used[first] += amount
            got[end] += amount
    return flow


def choose(sizes: Sequence[int], room: int) -> list[bool]:
    """Which documents of one group to take, in the given order: those that fit, then perhaps one more.

    The one more is the smallest left, taken if the sum then ends nearer to the room.
    """
    taken = []
    for n in sizes:
        taken.append(0 < n <= room)
        room -= n * taken[-1]
    left = [(n, i) for i, n in enumerate(sizes) if n > 0 and not taken[i]]
    if left and min(left)[0] < 2 * room:
        taken[min(left)[1]] = True
    return taken


def mix(df: DataFrame, sources: Column, size: Column, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        repeats: int = MAX_REPEATS, seed: int = 29, key: str = "doc_id") -> DataFrame:
    """Add size, source_size, target and taken to every row; input columns of these names are replaced.

    ``sources`` is an array of the sources that hold a document (null counts as a source, an
    empty or null array as the one source null); a null size counts as 0. taken is the document's size times how often the
    mix takes it, 0 to ``repeats``. source_size and target are those of the first of its sources. Rows with
    equal keys are documents of their own. Sums are exact; whole documents are taken, so a
    source's sum may miss its target by part of one short document.
    """
    spark = df.sparkSession
    pattern = F.array_sort(F.array_distinct(sources))
    pattern = F.when(F.coalesce(F.size(pattern), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(pattern)
    base = df.select(boxed(df), F.col(key).alias("_own"), F.coalesce(size.cast("long"), F.lit(0)).alias("_size"), pattern.alias("_pattern"))
    stats = base.groupBy("_pattern").agg(F.sum("_size").alias("tokens"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()
    if len(stats) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {tuple(r["_pattern"]): r["tokens"] for r in stats}
    sizes: dict = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = source_targets(sizes, weights, share, repeats) if sizes else {}
    flow = route(capacity, {s: round(t) for s, t in target.items()}, repeats)

    rows = []
    for r in stats:
        p, n = tuple(r["_pattern"]), r["tokens"]
        t = sum(flow[p].values())
        copies, rest = divmod(t, n) if n else (0, 0)
        rows.append((list(p), n, copies, rest, -(-r["docs"] // GROUP_ROWS), sizes[p[0]], target[p[0]]))
    schema = "_pattern array<string>, _tokens long, _copies long, _rest long, _groups long, source_size long, target double"
    table = F.broadcast(spark.createDataFrame(rows, schema))  # at most MAX_PATTERNS rows
    same = F.to_json(F.struct("_pattern"), {"ignoreNullFields": "false"})
    docs = (
        base.withColumn("_key", same).join(table.withColumn("_key", same).drop("_pattern"), "_key")
        .withColumn("_u", uniform(seed, F.col("_own"), F.col("_key")))
        .withColumn("_group", F.floor(F.col("_u") * F.col("_groups")))
    )

    # The rest of a pattern's flow takes whole groups in seeded order up to the one where it ends.
    sums = docs.filter("_rest > 0").groupBy("_key", "_group", "_rest").agg(F.sum("_size").alias("_sum"))
    cut = (
        sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_group")))
        .filter("_upto >= _rest and _upto - _sum < _rest")
        .select("_key", F.col("_group").alias("_cut"), (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_room"))
    )
    docs = docs.join(F.broadcast(cut), "_key", "left")  # a row for each pattern
    ended = F.coalesce(F.col("_group") == F.col("_cut"), F.lit(False))
    given = ["_row", "_size", "source_size", "target"]
    more = F.coalesce((F.col("_group") < F.col("_cut")).cast("long"), F.lit(0))
    rest = docs.filter(~ended).withColumn("_taken", F.col("_size") * (F.col("_copies") + more)).select(*given, "_taken")

    def end(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("_u", "ascending"), ("_own", "ascending"), ("_size", "ascending")]))
        n = table["_size"].to_numpy()
        extra = choose(n.tolist(), table["_room"][0].as_py())
        return table.select(given).append_column("_taken", pa.array(n * (table["_copies"].to_numpy() + np.array(extra, np.int64)), pa.int64()))

    # one group of about GROUP_ROWS documents for each pattern
    last = docs.filter(ended).select(*given, "_u", "_own", "_room", "_copies", "_key").groupBy("_key").applyInArrow(end, rest.schema)
    new = {"size": "_size", "source_size": "source_size", "target": "target", "taken": "_taken"}
    return rest.unionByName(last).select(*unboxed([c for c in df.columns if c not in new]), *(F.col(c).alias(n) for n, c in new.items()))
