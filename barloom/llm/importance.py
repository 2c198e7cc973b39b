"""Resampling documents by importance towards a target text: hashed n-gram features, a gain for each bucket, a seeded draw.

Each task keeps a trie of words. A node stands for the run of words on its path and holds how often the run came and the CRC-32 state
of its UTF-8 bytes, so a longer run's checksum goes on from its parent's. The levels of a trie are arrays: a node's children are the pairs of its
number and a word's, so all runs of one length are walked, counted and check-summed at once. The buckets' totals of all tries are added up; for
scoring, nodes get the gain of their bucket, and a document is scored by walking its runs. A trie takes ``TRIE_WORDS`` words of text, then the
next one begins: its size does not follow the input's.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, placed, unboxed

LONGEST, BUCKETS, LEAST_WORDS, SEED = 2, 10_000, 20, 7
#: Words of text of a trie, unless one text has more, and different words that a task knows before it forgets them.
TRIE_WORDS, KNOWN_WORDS = 1 << 20, 1 << 20
#: Bytes of UTF-8 that words are made of: ASCII digits and letters, and all of other letters; A to Z become small, the rest is space.
_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, null: none."""
    return [] if text is None else text.translate(_BYTES).split()


class Words(dict):
    """Numbers of words, given when they are first asked for; for each number the CRC-32 of the word alone and after a space, and its bytes."""

    def __init__(self):
        self.crcs, self.spaced, self.sizes = (np.empty(0, np.int64) for _ in range(3))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, words: Iterator[bytes], n: int) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, n)
        new = list(itertools.islice(self, len(self.crcs), None))
        self.crcs = np.concatenate([self.crcs, np.array([zlib.crc32(w) for w in new], np.int64)])
        self.spaced = np.concatenate([self.spaced, np.array([zlib.crc32(b" " + w) for w in new], np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array([len(w) + 1 for w in new], np.int64)])
        return out


def _shifts(size: int) -> np.ndarray:
    """What ``size`` zero bytes make of each byte of a CRC-32 state; a state's four are combined by exclusive or."""
    zeros = bytes(size)
    none = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << i) ^ none for i in range(32)]
    out = np.zeros((4, 256), np.int64)
    for i in range(4):
        for j in range(8):
            out[i, 1 << j : 2 << j] = out[i, : 1 << j] ^ bits[8 * i + j]
    return out


def after_word(states: np.ndarray, spaced: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 states after a space and a word each: a checksum is linear in the state that it starts from."""
    found, at = np.unique(sizes, return_inverse=True)
    tables = np.array([_shifts(int(n)) for n in found], np.int64).reshape(-1, 4, 256)
    out = spaced.copy()
    for i in range(4):
        out ^= tables[at, i, (states >> (8 * i)) & 255]
    return out


class Trie:
    """The runs of up to ``longest`` words of some texts. For each level: nodes' CRC-32 states, how often they came, the node of each run and its text."""

    def __init__(self, texts: list[list[bytes]], longest: int, words: Words):
        sizes = np.array([len(t) for t in texts], np.int64)
        total = int(sizes.sum())
        ids = words.numbers(itertools.chain.from_iterable(texts), total)
        text, at = np.repeat(np.arange(len(texts)), sizes), np.arange(total)
        left = np.repeat(np.cumsum(sizes), sizes) - at
        known, node, counts = np.unique(ids, return_inverse=True, return_counts=True)
        states = words.crcs[known]
        self.n_runs = np.maximum(sizes[:, None] - np.arange(longest), 0).sum(1)
        self.levels = [(states, counts, node, text)]
        for depth in range(1, longest):
            keep = left[at] > depth
            at, node = at[keep], node[keep]
            pairs, node, counts = np.unique(node * len(words) + ids[at + depth], return_inverse=True, return_counts=True)
            parent, word = np.divmod(pairs, max(1, len(words)))
            states = after_word(states[parent], words.spaced[word], words.sizes[word])
            self.levels.append((states, counts, node, text[at]))

    def buckets(self, n: int) -> np.ndarray:
        """The counts of all nodes by bucket."""
        return sum(np.bincount(states % n, counts, n) for states, counts, _, _ in self.levels).astype(np.int64)

    def totals(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's runs; whole numbers, and exact as long as they are below 2^53."""
        n = len(self.n_runs)
        return sum(np.bincount(text, gains[states % len(gains)][node], n) for states, _, node, text in self.levels).astype(np.int64)


def _tries(column: pa.Array, longest: int, known: list[Words]) -> Iterator[tuple[list[list[bytes]], Trie]]:
    """The texts of a column, as words, in parts of one trie each. ``known`` holds the task's words."""
    held, size = [], 0
    for i, value in enumerate(column, 1):
        held.append(words(value.as_py()))
        size += len(held[-1])
        if size >= TRIE_WORDS or i == len(column):
            if len(known[0]) > KNOWN_WORDS:
                known[0] = Words()
            yield held, Trie(held, longest, known[0])
            held, size = [], 0


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features of each bucket come in all texts; buckets without any have no row."""

    def run(batches):
        totals, known = np.zeros(buckets, np.int64), [Words()]
        for batch in batches:
            for _, trie in _tries(batch.column(0), longest, known):
                totals += trie.buckets(buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["bucket", "n"])

    parts = df.select(F.col(f"`{text}`").cast("binary").alias("_t")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Importance:
    """The gain of each bucket: how much likelier it is in the target than in the corpus, in thousandths of a natural log, rounded down."""

    gains: tuple[int, ...]
    longest: int

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The table with n_words, n_features and weight, the mean gain of a text's features rounded down (0 without any).

        Equal texts have equal weights; other columns, whatever their names, stay with their rows, and the new ones replace columns called alike.
        """
        gains, longest = self.gains, self.longest

        def run(batches):
            values, known = np.array(gains, float), [Words()]
            for batch in batches:
                found = [(np.array([len(t) for t in texts], np.int64), trie.n_runs, trie.totals(values)) for texts, trie in _tries(batch.column(1), longest, known)]
                n_words, n_runs, total = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
                weight = np.where(n_runs > 0, total // np.maximum(n_runs, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_runs, weight))], ["_row", "n_words", "n_features", "weight"])

        rows = df.select(boxed(df, text), F.col(f"`{text}`").cast("binary").alias("_t"))
        kind = rows.schema["_row"].dataType.simpleString()
        out = rows.mapInArrow(run, f"_row {kind}, n_words long, n_features long, weight long")
        new = ("n_words", "n_features", "weight")
        return out.select(*unboxed([c for c in df.columns if c not in (text, *new)]), *new)


def fit(corpus: DataFrame, target: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> Importance:
    """Gains from all texts of both tables; ``buckets`` numbers of each go through the driver, whatever the tables' size."""

    def counts(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(df, text, longest, buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    base, aim = counts(corpus), counts(target)
    s, t = float(sum(base) + buckets), float(sum(aim) + buckets)
    gains = (math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(base, aim))
    return Importance(tuple(gains), longest)


def luck(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number of a key in thousandths, rounded down, from the first 8 hex digits of the digest of ``seed:key``; a null key is empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 25, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): every row, drawn ones with their rank from 1.

    Of the rows with at least ``least_words`` words the ``percent`` with the highest scores are drawn, without replacement; a score is the
    weight plus the key's luck. Ties go to the smaller key, a null one first, and then to fewer features; rows that repeat a key share its luck and are drawn each.
    Null and empty texts have no features and weigh 0. Ranks are places in ranges of scores, so no task holds all rows. An empty table
    gives no rows, an empty target gives gains by the corpus alone. Other columns play no part, whatever their names.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    docs = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    model = fit(docs, target.select(F.col(f"`{text}`").alias("_text")), "_text")
    scored = model.score(docs, "_text").withColumn("score", F.col("weight") + luck(F.col("_key"), seed))
    # rows that may not be drawn have a group of their own; stored, as dealing by ranges reads its input twice
    ranked = placed(materialize(scored, "scores").withColumn("_may", F.col("n_words") >= least_words), ["_may"], [F.col("score").desc(), F.col("_key"), F.col("n_features"), F.col("weight")], "scored")
    drawn = F.col("_may") & (F.col("_place") < F.call_function("div", F.col("_count") * percent, F.lit(100)))
    return ranked.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", F.when(drawn, F.col("_place") + 1).alias("rank"))
