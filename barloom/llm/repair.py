"""Token-id output in Re-Pair grammar-compressed shards with random access.

A shard holds consecutive documents in ascending key order. Frequent pairs of neighbouring symbols are replaced by
nonterminals round after round, until no pair is frequent or a round makes the shard no smaller; the rules, each symbol's expansion
length and each document's first symbol are stored, so that one document, or a range of its ids, is decoded
without the others. The end id stays out of all rules: no rule crosses documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced
from .tokens import default_vocabulary, encoder

MAGIC = b"RPG1"
END_ID = 2
#: A shard is closed once it has so many ids; a document is never cut.
SHARD_IDS = 2_000_000
PAIRS_PER_ROUND, LEAST_COUNT = 3072, 16
#: A round that takes less than this share off a shard is undone and the last.
LEAST_GAIN = 0.01
#: Bytes of a rule with its expansion length.
_RULE_BYTES = 12
#: A row group of the stored table holds about one shard, so that one document's shard is read without the others.
ROW_GROUP_BYTES = 4 << 20
_BINS = 20


def symbol_bytes(symbols: int) -> int:
    """Bytes that so many different symbols take each."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


def _bin(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77))) >> np.uint32(32 - _BINS)


def _ranks(pairs: np.ndarray, bins: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Each pair's place among the chosen ones, or their number if it is none of them; ``bins`` are the pairs' bins."""
    places = np.arange(len(chosen), dtype=np.int32)
    own = _bin((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))
    table = np.full((1 << _BINS) + 1, len(chosen), np.int32)
    table[own] = places
    rank = table[bins]
    rank[np.append(chosen, chosen[:1])[rank] != pairs] = len(chosen)
    rest = np.flatnonzero(table[own] != places)  # those that share the bin of another chosen one
    if len(rest):
        shared = np.zeros((1 << _BINS) + 1, bool)
        shared[own[rest]] = True
        at = np.flatnonzero(shared[bins])
        rest = rest[np.argsort(chosen[rest])]
        near = np.minimum(np.searchsorted(chosen[rest], pairs[at]), len(rest) - 1)
        same = chosen[rest[near]] == pairs[at]
        rank[at[same]] = rest[near[same]]
    return rank


def build_grammar(ids: np.ndarray, vocabulary: int, end_id: int = END_ID, pairs_per_round: int = PAIRS_PER_ROUND, least: int = LEAST_COUNT):
    """(symbols, rules): rule k, a row of two symbols, defines symbol ``vocabulary + k``."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    size, most = vocabulary, pairs_per_round
    cost = len(seq) * symbol_bytes(size)
    while len(seq) > 1:
        # symbols take two bytes as long as they can
        pairs_per_round = min(most, (1 << 16) - size) if size < 1 << 16 else most
        bins = _bin(seq[:-1], seq[1:])
        ends = seq == end_id
        bins[ends[:-1] | ends[1:]] = 1 << _BINS  # a bin of no count for what no rule may hold
        counts = np.bincount(bins, minlength=(1 << _BINS) + 1)
        counts[-1] = 0
        # bins' counts bound their pairs' counts from above: only well-filled bins can hold frequent pairs
        filled = counts[counts >= least]
        floor = max(least, int(np.partition(filled, -pairs_per_round)[-pairs_per_round])) if len(filled) > pairs_per_round else least
        at = np.flatnonzero((counts >= floor)[bins])
        here = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
        ordered = np.sort(here)
        begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        pairs, n = ordered[begins], np.diff(begins, append=len(ordered))
        order = np.flatnonzero(n >= least)
        order = order[np.argsort(-n[order], kind="stable")][:pairs_per_round]
        if not len(order):
            break
        new_size = size + len(order)
        new_cost = (len(seq) - int(n[order].sum())) * symbol_bytes(new_size) + _RULE_BYTES * (new_size - vocabulary)
        if new_cost > (1 - LEAST_GAIN) * cost:  # even if none of the pairs overlapped
            break
        rank = np.full(len(seq) + 1, len(order), np.int32)  # one place in front
        rank[at + 1] = _ranks(here, bins[at], pairs[order])
        # where chosen pairs overlap, the more frequent one wins, then the one to the left
        here, after = rank[1:], np.append(rank[2:], len(order))
        taken = np.flatnonzero((here < len(order)) & (here < rank[:-1]) & (here <= after))
        new_cost = (len(seq) - len(taken)) * symbol_bytes(new_size) + _RULE_BYTES * (new_size - vocabulary)
        if new_cost > (1 - LEAST_GAIN) * cost:
            break
        rules.append(np.stack([pairs[order] >> np.uint64(32), pairs[order] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq[taken] = size + here[taken]
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        seq = seq[keep]
        size, cost = new_size, new_cost
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids below each rule."""
    out = np.ones(vocabulary + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[vocabulary + k] = out[a] + out[b]
    return out[vocabulary:]


def write_shard(docs: list[bytes], vocabulary: int, end_id: int = END_ID) -> bytes:
    """The file image of documents, each given as its little-endian 32-bit ids without the end id."""
    end = struct.pack("<I", end_id)
    ids = np.frombuffer(b"".join([x + end for x in docs]), "<u4")
    symbols, rules = build_grammar(ids, vocabulary, end_id)
    lengths = expansion_lengths(rules, vocabulary)
    width = symbol_bytes(vocabulary + len(rules))
    ends = np.flatnonzero(symbols == end_id) + 1
    if len(ends) != len(docs):  # the end id also stands inside a text: index the documents by their ids
        at = np.cumsum(np.concatenate([lengths, [1]])[np.where(symbols >= vocabulary, symbols - vocabulary, len(rules))])
        ends = np.searchsorted(at, np.cumsum([len(x) // 4 + 1 for x in docs])) + 1
    head = struct.pack("<4sIIIQIB", MAGIC, vocabulary, end_id, len(rules), len(symbols), len(docs), width)
    return head + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + ends.astype("<u8").tobytes() + symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


class Shard:
    """A shard's image; ``document`` decodes one document, ``documents`` all of them."""

    def __init__(self, image: bytes):
        head = "<4sIIIQIB"
        magic, self.vocabulary, self.end_id, n_rules, n_symbols, n_docs, width = struct.unpack_from(head, image)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at = struct.calcsize(head)
        self.rules = np.frombuffer(image, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(image, "<u4", n_rules, at)
        at += 4 * n_rules
        self.ends = np.frombuffer(image, "<u8", n_docs, at).astype(np.int64)
        self.symbols = np.zeros((n_symbols, 4), np.uint8)
        self.symbols[:, :width] = np.frombuffer(image, np.uint8, width * n_symbols, at + 8 * n_docs).reshape(-1, width)
        self.symbols = self.symbols.view("<u4")[:, 0]
        self._flat = None

    def __len__(self) -> int:
        return len(self.ends)

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all symbols' expansions, where each begins, how long each is)."""
        if self._flat is None:
            below: list[list[int]] = []
            for a, b in self.rules.tolist():
                below.append([x for s in (a, b) for x in (below[s - self.vocabulary] if s >= self.vocabulary else (s,))])
            flat = np.concatenate([np.arange(self.vocabulary), *(np.array(x) for x in below)]).astype("<u4")
            size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)])
            self._flat = flat, np.cumsum(size) - size, size
        return self._flat

    def expand(self, first: int, last: int) -> np.ndarray:
        """Ids below a range of symbols."""
        flat, begin, size = self._tables()
        s = self.symbols[first:last]
        n = size[s]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return flat[np.repeat(begin[s], n) + inside]

    def document(self, i: int) -> np.ndarray:
        return self.expand(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> list[np.ndarray]:
        _, _, size = self._tables()
        ids = self.expand(0, len(self.symbols))
        ends = np.cumsum(size[self.symbols])[self.ends - 1]
        return np.split(ids, ends[:-1])


def write_shards(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None,
                 shard_ids: int = SHARD_IDS, target: str | None = None) -> DataFrame:
    """(part, before, first, last, keys, n_ids, image): written grammar shards in ascending key order.

    Parts are ranges of keys; ``before`` counts the ids of the part's earlier shards; first and last are a shard's least and
    greatest key. Null texts are empty; null keys come first; rows with equal keys stand in the order of their texts and stay
    one row each. Other columns play no part; an empty table gives no shards. The table is stored at ``target``, or in the
    shared folder, and read back from there.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        part, coder = TaskContext.get().partitionId(), encoder(path)
        top = coder.tokenizer.get_vocab_size()
        keys, docs, size, before = [], [], 0, 0

        def close():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "before": pa.array([before], pa.int64()),
                "first": pa.array([next((k for k in keys if k is not None), None)], key_type), "last": pa.array(keys[-1:], key_type),
                "keys": pa.array([keys], pa.list_(key_type)), "n_ids": pa.array([size], pa.int64()),
                "image": pa.array([write_shard(docs, top)], pa.binary()),
            })

        for batch in sliced(batches):
            key_type = batch.schema.field(0).type
            for k, ids in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1).to_pylist())):
                keys.append(k)
                docs.append(ids)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield close()
                    keys, docs, size, before = [], [], 0, before + size
        if docs:
            yield close()

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    ordered = df.select(key, text).repartitionByRange(parts, key).sortWithinPartitions(key, text)
    shards = ordered.mapInArrow(run, f"part int, before long, first {kind}, last {kind}, keys array<{kind}>, n_ids long, image binary")
    return materialize(shards, "shards", target, {"parquet.block.size": ROW_GROUP_BYTES})


def read_documents(shards: DataFrame, wanted: Sequence, key: str = "doc_id") -> DataFrame:
    """(key, ids): the documents with the given keys, each decoded by itself from its shard.

    Only row groups whose range of keys holds one of them are read. Keys that no document has give no row, null is none.
    """
    kind, asked = shards.schema["keys"].dataType.elementType.simpleString(), sorted({k for k in wanted if k is not None})
    here = reduce(or_, (F.lit(k).between(F.col("first"), F.col("last")) for k in asked), F.lit(False))

    def run(batches):
        want = set(asked)
        for batch in batches:
            for keys, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(image)
                at = [i for i, k in enumerate(keys) if k in want]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in at], batch.schema.field(0).type.value_type), pa.array([shard.document(i).tolist() for i in at], pa.list_(pa.int64()))], [key, "ids"]
                )

    return shards.filter(here).select("keys", "image").mapInArrow(run, f"`{key}` {kind}, ids array<long>")


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): every document decoded from its shard's image.

    ``start`` is the number of ids of all documents before it.
    """
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    # a number for each range partition, of which there are as many as shuffle partitions
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    first, at = {}, 0
    for part, n in totals:
        first[part], at = at, at + n

    def run(batches):
        for batch in batches:
            for part, before, keys, image in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "keys", "image"))):
                docs = Shard(image).documents()
                n = np.array([len(d) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, batch.schema.field("keys").type.value_type), pa.array(first[part] + before + np.cumsum(n) - n),
                     pa.array(n), pa.array([zlib.crc32(np.ascontiguousarray(d).tobytes()) for d in docs], pa.int64())],
                    [key, "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")
