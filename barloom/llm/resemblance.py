"""Near-copies by the exact similarity of word shingles: every pair at or above 4/5 is linked.

SimHash and multi-index hashing give the first links and gather large groups of copies. Their fingerprints differ in some
10 of 64 bits at that similarity, so they cannot find all: two sets with a similarity of 4/5 also share one of their
rarest shingles, as many as a fifth of the larger set and one more (prefix filter). Rows that meet there and are in
different groups yet are compared, in rounds of growing reach, until no pair is left out. Every link is
verified on the whole sets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, drop_stored, materialize, scratch, sliced, unboxed
from .components import connected_components
from .simhash import SEED, fingerprint, link_table

SHINGLE_WORDS = 5
#: Bits and segments of the SimHash step, which only gives first links.
DISTANCE, SEGMENTS = 5, 3
#: Documents, about, whose shingles tell which are common, and how many common ones are known; this sets the order of shingles, not what is found.
ORDER_ROWS, COMMON = 20_000, 1 << 17
#: Rows of a group that each row is compared with in the first round, and the growth from round to round.
REACH, GROWTH = 4, 32
SIGN_BITS = 512


def shingles(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; the whole text is one if it has fewer words, none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    k = min(words_per_shingle, len(words))
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)] if words else [], np.uint64)).view(np.int64)


def set_id(members: np.ndarray) -> int:
    """A signed 64-bit number of a set of shingles."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(members.tobytes()) - 2**63


def signature(members: np.ndarray) -> bytes:
    """Parities of a set's members in SIGN_BITS places: two sets' signatures differ in no more places than the sets in members."""
    bits = np.bincount((members.view(np.uint64) >> np.uint64(40)).astype(np.int64) % SIGN_BITS, minlength=SIGN_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def similar(shared, a, b):
    """Whether sets of ``a`` and ``b`` members with ``shared`` in common have a Jaccard similarity of 4/5 at least."""
    return 9 * shared >= 4 * (a + b)


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set in order: two similar sets share the first of those they have in common within both prefixes."""
    rank = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))][: len(own) - -(-4 * len(own) // 5) + 1]


def meet(keys, ids, labels, sizes, places, signs, reach: int, old: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b, cut): pairs of a group's rows that may be similar and have different labels; ``cut`` if there may be more beyond ``reach``.

    Rows come sorted by key and size, ``places`` are those of the key in the order of each row's set, ``signs`` the sets' signatures
    as rows of 64-bit numbers. Pairs among the first ``old`` rows were given before.
    """
    left, right, d = [], [], 0
    none = np.array([], np.int64)
    live = np.arange(len(keys))
    while True:
        d += 1
        live = live[live + d < len(keys)]
        live = live[(keys[live + d] == keys[live]) & (4 * sizes[live + d] <= 5 * sizes[live])]
        if not len(live) or d > reach:
            return np.concatenate([none, *left]), np.concatenate([none, *right]), bool(len(live))
        here = live[live + d >= old]
        other = here + d
        most = np.minimum(sizes[here] - places[here], sizes[other] - places[other])
        good = (labels[here] != labels[other]) & similar(most, sizes[here], sizes[other])
        here, other = here[good], other[good]
        # a similarity of 4/5 leaves at most a ninth of both sets' members that only one has
        good = 9 * np.bitwise_count(signs[here] ^ signs[other]).sum(1, dtype=np.int64) <= sizes[here].astype(np.int64) + sizes[other]
        left.append(ids[here[good]])
        right.append(ids[other[good]])


def _pairs(batches, reach: int):
    """(a, b) of rows that come sorted by key and size; a row without b says that pairs were left. Holds ``reach`` rows and a batch."""
    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, SIGN_BITS // 64))
        old = 0 if held is None else len(held[0])
        rows = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        a, b, cut = meet(*rows, reach, old)
        held = [x[-reach - 1 :] for x in rows]
        more = np.zeros(1 if cut else 0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.minimum(a, b), more])), pa.array(np.concatenate([np.maximum(a, b), more]), mask=np.arange(len(a) + len(more)) >= len(a))], ["a", "b"]
        )


def _crowded(batches):
    """The rows whose key several ids have, one a key and id; they come sorted by key and id."""
    held, given = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        keys, ids = columns[:2]
        columns = [c[np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if given:  # the row held was given already
            keep[0] = False
        given = bool(keep[-1]) or given and len(keep) == 1
        held = [c[-1:] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["key", "id", "n", "place"])


def _verify(batches):
    for batch in sliced(batches):
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = []
        for s, t in zip(x.to_pylist(), y.to_pylist()):
            s, t = shingles(s), shingles(t)
            keep.append(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def common_shingles(texts: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in ascending order, their counts): the most frequent ones of about ORDER_ROWS texts, chosen by their hash."""

    def run(batches):
        for batch in sliced(batches):
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], np.int64), *found]))], ["key"])

    every = max(1, n_rows // ORDER_ROWS)
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(run, "key long").groupBy("key").count().filter("count > 2")
    rows = sorted(some.orderBy(F.desc("count"), "key").limit(COMMON).collect())
    return np.array([k for k, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def similar_pairs(texts: DataFrame, rows: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): links between the ids of ``rows`` (row, id, fp, sign), of which ``texts`` (row, text) holds the texts.

    Rows with equal ids have equal sets of shingles. Each link has a similarity of 4/5 at least, and any two rows with that similarity
    are joined by a chain of links. Sets are made from the texts wherever they are needed: stored they would take more than these.
    """
    spark = texts.sparkSession
    one_row = materialize(rows.groupBy("id").agg(F.min("row").alias("row"), F.first("sign").alias("sign")), "rows")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        chosen = one_row.select("id", "row").join(wanted, "id", "left_semi")
        known = materialize(texts.join(chosen, "row").select("id", "row", "text").dropDuplicates(["row"]).drop("row"), "members")
        x, y = (known.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
        found = materialize(both.mapInArrow(_verify, "a long, b long"), "similar")
        drop_stored(known)
        return found

    by_print = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    one = link_table(by_print.select("fp"), DISTANCE, SEGMENTS)
    x, y = (by_print.select(F.col("fp").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    apart = one.join(x, "a").join(y, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    alike = rows.select("fp", F.col("id").alias("b")).distinct().join(by_print, "fp").filter("id != b").select(F.col("id").alias("a"), "b")
    edges = verified(materialize(apart.union(alike), "first-pairs"))
    shared = spark.sparkContext.broadcast(common_shingles(texts.select("text"), rows.count()))

    def file(batches):
        common, ranks = shared.value
        seen: set[int] = set()  # sets this task has filed lately
        for batch in sliced(batches):
            found, ids = [], []
            for t in batch.column(0).to_pylist():
                own = shingles(t)
                i = set_id(own)
                if i not in seen:
                    seen.add(i)
                    found.append(own)
                    ids.append(i)
            if len(seen) > 200_000:
                seen.clear()
            sizes = np.array([len(s) for s in found], np.int64)
            keys = [prefix(s, common, ranks) for s in found]
            of = np.repeat(np.arange(len(found)), [len(k) for k in keys])
            places = np.concatenate([np.array([], np.int64), *(np.arange(len(k)) for k in keys)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array([], np.int64), *keys])), pa.array(np.array(ids, np.int64)[of]), pa.array(sizes[of], pa.int32()), pa.array(places, pa.int32())],
                ["key", "id", "n", "place"],
            )

    schema = "key long, id long, n int, place int"
    filed = texts.select("text").mapInArrow(file, schema)
    crowd = materialize(filed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_crowded, schema), "crowds")
    tested = None
    while True:
        label = connected_components(edges).select(F.col("node").alias("id"), "component")
        named = crowd.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"), "n", "place")
        named = materialize(named, "named")
        mixed = named.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("key")
        signed = named.join(mixed, "key", "left_semi").join(one_row.select("id", "sign"), "id").select("key", "id", "label", "n", "place", "sign")
        dealt = signed.repartition("key").sortWithinPartitions("key", "n", "id")
        met = materialize(dealt.mapInArrow(lambda batches, reach=reach: _pairs(batches, reach), "a long, b long").distinct(), f"met-{reach}")
        drop_stored(named)
        pairs = met.filter("b is not null")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        edges = edges.union(verified(pairs))
        if met.filter("b is null").isEmpty():
            return edges
        tested = pairs if tested is None else tested.union(pairs)
        reach *= GROWTH


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", reach: int = REACH) -> DataFrame:
    """The rows of ``df`` but one document only of each component of near-copies: that with the smallest key, then the smallest hash.

    Near-copies have sets of five-word shingles with a Jaccard similarity of 4/5 at least; null texts and those without words are copies
    of each other. Rows equal in key and text become one, null keys come first. Other columns, whatever their names, stay with their row; an
    empty table gives an empty one.
    """
    row = F.xxhash64(F.col(key), F.col(text))
    kind = df.schema[key].dataType.simpleString()

    def read_sets(batches):
        for batch in sliced(batches):
            texts = batch.column(2).to_pylist()
            sets = [shingles(t) for t in texts]
            ids = np.array([set_id(x) for x in sets], np.int64)
            fps = np.array([fingerprint(t, SHINGLE_WORDS) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids), pa.array(fps), pa.array([signature(x) for x in sets], pa.binary())], ["row", "_key", "id", "fp", "sign"]
            )

    found = df.select(row.alias("row"), F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(read_sets, f"row long, _key {kind}, id long, fp long, sign binary")
    with scratch(df.sparkSession) as keep:
        rows = materialize(found, "shingles")
        texts = df.select(row.alias("row"), F.col(text).alias("text"))
        distinct = rows.groupBy("id").agg(F.min(F.struct("_key", "row")).alias("_least"))
        label = connected_components(similar_pairs(texts, rows, reach))
        named = distinct.join(label, F.col("id") == F.col("node"), "left").select("_least", F.coalesce("component", "id").alias("_label"))
        least = named.groupBy("_label").agg(F.min("_least").alias("_least")).select(F.col("_least.row").alias("_id")).distinct()
        times = rows.groupBy(F.col("row").alias("_id")).agg(F.count("*").alias("_times"))
        kept = keep(materialize(least.join(times, "_id"), "kept"))
    marked = df.select(boxed(df), row.alias("_id")).join(kept, "_id")
    # texts are dealt out again only for the few rows that stand several times
    twice = marked.filter("_times > 1").dropDuplicates(["_id"])
    return marked.filter("_times = 1").union(twice).select(*unboxed(df.columns))
