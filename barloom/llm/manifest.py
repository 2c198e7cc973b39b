"""A Merkle manifest of a dataset: a tree of SHA-256 digests for each group, a tree over the groups' roots, and proofs by coordinates.

The nodes of a tree are named by level and place and stored as tables. From its place and the size of its group a leaf knows
the coordinates of all its siblings; they are exploded, joined with the stored nodes, put in order and folded. Trees are built, and coordinates
looked up, in tiers of ``TIER`` nodes at most: the siblings above a tier are the same for all its nodes, so they are looked up
once for each block and handed down, and no node is asked for by more than ``TIER`` others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, placed

#: Leaves of a block at most; also how often one node is asked for.
TIER = 256
#: The levels of the tree over the groups are counted from here on.
ABOVE = 64
_ENTRY = "array<struct<level:int,slot:int,after:boolean,hash:binary>>"


def digest(text: Column) -> Column:
    """The lower-case hex SHA-256 of a text."""
    return F.sha2(text, 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its number of bytes, a colon and its text; null as a dash."""
    return digest(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values)))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, _hex), "")


def _height(count: Column, fan: int) -> Column:
    """Levels above the leaves until one node is left."""
    powers = [fan**i for i in range(63) if fan**i < 1 << 63]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < count))


def _div(value: Column | str, by: int) -> Column:
    """``value`` / ``by``, rounded down, in whole numbers."""
    return F.call_function("div", F.col(value) if isinstance(value, str) else value, F.lit(by))


def _over(count: Column, by: int) -> Column:
    """``count`` / ``by``, rounded up."""
    return _div(count + (by - 1), by)


def _depth(fan: int) -> int:
    """Levels of a tier."""
    return max(1, next(k for k in range(63) if fan ** (k + 1) > TIER))


def _parents(nodes: Column, fan: int) -> Column:
    """Digests of each ``fan`` nodes that follow each other; the last run may be shorter."""
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(fan))
    return F.transform(starts, lambda i: digest(F.array_join(F.slice(nodes, i + 1, F.lit(fan)), "")))


def _grow(leaves: DataFrame, fan: int, name: str) -> list[tuple[int, DataFrame, DataFrame]]:
    """For each tier its lowest level, its lowest nodes (_g, _place, _count, _hash) and all its stored nodes (_g, level, _at, _hash)."""
    depth = _depth(fan)
    most, base, tiers = leaves.agg(F.max("_count")).first()[0] or 0, 0, []
    current = leaves.select("_g", "_place", "_count", "_hash")
    while True:
        span = fan**depth
        steps = reduce(lambda a, b: a + b, ((F.col("_count") > fan**j).cast("int") for j in range(depth)))
        blocks = current.groupBy("_g", _div("_place", span).alias("_block")).agg(
            F.sort_array(F.collect_list(F.struct("_place", "_hash"))).alias("_x"), F.first("_count").alias("_count")
        )
        low = F.transform("_x", lambda x: _hex(x["_hash"]))
        levels = F.aggregate(
            F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), steps), F.array(low), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), fan)))
        )
        widths = F.array(*(F.lit(span // fan**j) for j in range(depth + 1)))
        rows = blocks.select("_g", "_block", "_count", F.posexplode(levels).alias("_j", "_nodes")).select("_g", "_block", "_count", "_j", F.posexplode("_nodes").alias("_i", "_h"))
        at = F.col("_block") * F.element_at(widths, F.col("_j") + 1) + F.col("_i")
        nodes = materialize(rows.select("_g", (F.col("_j") + base).alias("level"), at.cast("long").alias("_at"), "_count", F.unhex("_h").alias("_hash")), f"{name}-{base}")
        tiers.append((base, current, nodes))
        most, base = -(-most // span), base + depth
        if most <= 1:
            return tiers
        current = nodes.filter((F.col("level") == base) & (F.col("_count") > span)).select("_g", F.col("_at").alias("_place"), _over(F.col("_count"), span).alias("_count"), "_hash")


def _tops(tiers: list[tuple[int, DataFrame, DataFrame]], fan: int) -> DataFrame:
    """(_g, _root, _height): the last node of each group."""
    depth = _depth(fan)
    span, out = fan**depth, None
    for base, _, nodes in tiers:
        height = _height(F.col("_count"), fan)
        one = nodes.filter((F.col("_count") <= span) & (F.col("level") == height + base)).select("_g", F.col("_hash").alias("_root"), F.col("level").alias("_height"))
        out = one if out is None else out.unionByName(one)
    return out


def _lookups(current: DataFrame, base: int, nodes: DataFrame, fan: int, shift: int) -> DataFrame:
    """(_g, _place, _proof): the siblings within the tier of each of its lowest nodes, by joining coordinates with stored nodes."""
    depth = _depth(fan)
    wanted = []
    for j in range(depth):
        own, width = _div("_place", fan**j), _over(F.col("_count"), fan**j)
        for slot in range(fan):
            at = own - own % fan + slot
            there = (width > 1) & (own % fan != slot) & (at < width)
            wanted.append(F.when(there, F.struct(F.lit(base + j).alias("level"), at.alias("_at"), F.lit(slot).alias("slot"), (own % fan < slot).alias("after"))))
    asked = current.select("_g", "_place", F.inline(F.array_compact(F.array(*wanted))))
    stored = nodes.select(F.col("_g").alias("_of"), F.col("level").alias("_l"), F.col("_at").alias("_a"), "_hash")
    met = asked.join(stored, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("level") == F.col("_l")) & (F.col("_at") == F.col("_a")))
    entry = F.struct((F.col("level") + shift).cast("int").alias("level"), "slot", "after", F.col("_hash").alias("hash"))
    return met.groupBy("_g", "_place").agg(F.sort_array(F.collect_list(entry)).alias("_proof"))


def _proofs(tiers: list[tuple[int, DataFrame, DataFrame]], fan: int, above: DataFrame, name: str, shift: int = 0) -> DataFrame:
    """(_g, _block, _proof, _above): what the lowest nodes of each block of the first tier share, all siblings above it.

    ``above``: (_g, _proof, _above), what all nodes of a group share.
    """
    depth = _depth(fan)
    span, shared = fan**depth, None
    for base, current, nodes in reversed(tiers):
        ended = nodes.filter((F.col("level") == base) & (F.col("_at") == 0) & (F.col("_count") <= span)).select(F.col("_g").alias("_of"))
        tops = above.join(ended, F.col("_g").eqNullSafe(F.col("_of"))).select("_g", F.lit(0).cast("long").alias("_block"), "_proof", "_above")
        here = tops if shared is None else tops.unionByName(shared)
        if base == 0:
            return here
        own = handed(current, _lookups(current, base, nodes, fan, shift), here, span)
        shared = materialize(own.select("_g", F.col("_place").alias("_block"), "_proof", "_above"), f"{name}-proofs-{base}")
    return shared


def handed(current: DataFrame, found: DataFrame, shared: DataFrame, span: int) -> DataFrame:
    """``current`` with the siblings found in the tier and those that its block shares."""
    f = found.select(F.col("_g").alias("_g1"), F.col("_place").alias("_p1"), F.col("_proof").alias("_low"))
    s = shared.select(F.col("_g").alias("_g2"), F.col("_block").alias("_b2"), F.col("_proof").alias("_high"), "_above")
    out = current.join(f, F.col("_g").eqNullSafe(F.col("_g1")) & (F.col("_place") == F.col("_p1")), "left")
    out = out.withColumn("_b", _div("_place", span)).join(s, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2")))
    proof = F.concat(F.coalesce("_low", F.array().cast(_ENTRY)), "_high")
    return out.withColumn("_proof", proof).drop("_g1", "_p1", "_low", "_g2", "_b2", "_high", "_b")


def fold(start: Column, proof: Column, height: Column, above: Column) -> Column:
    """The root that a leaf and its siblings give: level by level, in a group and over the groups."""
    def levels(first: int, n: Column) -> Column:
        return F.transform(F.slice(F.sequence(F.lit(0), F.lit(63)), F.lit(1), n), lambda i: i + first)

    def side(level: Column, after: bool) -> Column:
        return _joined(F.transform(F.filter(proof, lambda p: (p["level"] == level) & (p["after"] == F.lit(after))), lambda p: p["hash"]))

    return F.aggregate(F.concat(levels(0, height), levels(ABOVE, above)), start, lambda acc, l: digest(F.concat(side(l, False), acc, side(l, True))))


def manifest(df: DataFrame, columns: list[str], group: str, key: str, fan: int = 2, claims: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root, verified): every row with its proof, checked by folding it.

    Leaves, digests of ``columns``, ascend by ``key`` within ``group``; each ``fan`` nodes that follow each other become the digest of
    their hex digests, a last run of fewer too, until one is left, the subroot; subroots, by group, give the root alike.
    ``proof`` holds the siblings as array of (level, slot, after, hash), from the leaf up; levels from ``ABOVE`` on are those over the groups.
    The fold starts from the digest in ``claims`` and, where that is null, from the leaf itself. Null groups and keys come first; rows that repeat
    a key stand in the order of their leaves, repeated rows are leaves each. A lone leaf is its own root and has an empty proof. An
    empty table gives no rows. Other columns play no part, whatever their names.
    """
    if fan < 2:
        raise ValueError("fan must be an integer >= 2")
    own = leaf(*(F.col(f"`{c}`") for c in columns))
    rows = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{key}`").alias("_k"), F.unhex(own).alias("_hash"), F.unhex(F.lit(None) if claims is None else claims).alias("_claim"))
    rows = rows.withColumn("_claim", F.coalesce("_claim", "_hash"))
    leaves = materialize(placed(rows, ["_g"], ["_k", "_hash", "_claim"], "leaves"), "leaves-placed")
    tiers = _grow(leaves, fan, "nodes")
    subroots = materialize(_tops(tiers, fan), "subroots")
    heads = materialize(placed(subroots.select(F.col("_g").alias("_k"), F.col("_root").alias("_hash"), F.lit(0).alias("_g")), ["_g"], ["_k"], "heads"), "heads-placed")
    upper = _grow(heads, fan, "head-nodes")
    root = _tops(upper, fan)
    span = fan ** _depth(fan)
    whole = root.select("_g", F.array().cast(_ENTRY).alias("_proof"), F.struct("_root", F.col("_height").alias("_levels")).alias("_above"))
    over = handed(heads, _lookups(heads, 0, upper[0][2], fan, ABOVE), _proofs(upper, fan, whole, "heads", ABOVE), span)
    tops = over.select(F.col("_k").alias("_of"), "_proof", "_above").join(subroots.withColumnRenamed("_root", "_sub"), F.col("_of").eqNullSafe(F.col("_g")))
    above = materialize(tops.select("_g", "_proof", F.struct("_sub", "_height", "_above").alias("_above")), "subroot-proofs")
    full = handed(leaves, _lookups(leaves, 0, tiers[0][2], fan, 0), _proofs(tiers, fan, above, "leaves"), span)
    folded = fold(_hex(F.col("_claim")), F.col("_proof"), F.col("_above._height"), F.col("_above._above._levels"))
    top = _hex(F.col("_above._above._root"))
    out = full.select(
        F.col("_k").alias(key), F.col("_g").alias(group), _hex(F.col("_hash")).alias("leaf"), _hex(F.col("_above._sub")).alias("subroot"), top.alias("root"),
        F.col("_proof").alias("proof"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings in order."""
    return digest(_joined(F.transform(proof, lambda p: p["hash"])))
