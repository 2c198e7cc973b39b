"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks, found by
beam search over the residuals. Inner products with a query are then sums of lookup-table entries,
one per codebook; the squared norm of the sum is stored beside the codes for distances. The best
candidates of each block are reranked exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, uniform

CODEBOOKS, CODEWORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on, chosen by a seeded hash of their ids; all are encoded.
TRAIN_ROWS = 16_384
#: Most base vectors and queries of one block; base blocks are smaller, down to LEAST_ROWS, where cores would idle.
BASE_ROWS, QUERY_ROWS, LEAST_ROWS = 65_536, 65_536, 4_096
#: Candidates of a query and block that are reranked: one in so many of the block's vectors, and LEAST_RERANK at least.
RERANK_PART, LEAST_RERANK = 25, 256


#: Rows of one matrix product: products this small stay on the core of their task.
_ROWS = 16
#: Queries whose lookup tables are read side by side.
_TOGETHER = 8


def _products(x: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """x @ turned for a number of rows that _ROWS divides."""
    return (x.reshape(-1, _ROWS, x.shape[1]) @ turned).reshape(len(x), -1)


def _closest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The codeword nearest to each row."""
    half, out = 0.5 * (book**2).sum(1), np.empty(len(x), np.int64)
    turned = np.ascontiguousarray(book.T)
    for a in range(0, len(x), 64 * _ROWS):
        some = x[a : a + 64 * _ROWS]
        padded = np.concatenate([some, np.zeros((-len(some) % _ROWS, x.shape[1]), x.dtype)])
        out[a : a + len(some)] = (half - _products(padded, turned)).argmin(1)[: len(some)]
    return out


def train(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Codebooks (codebooks, codewords, dimensions): each fitted by k-means on the residuals of those before it."""
    rng = np.random.default_rng(seed)
    rest = x.astype(np.float32)
    books = np.zeros((codebooks, codewords, x.shape[1]), np.float32)
    for m in range(codebooks):
        centre = rest[rng.choice(len(rest), codewords, replace=len(rest) < codewords)].copy()
        for _ in range(rounds):
            near = _closest(rest, centre)
            n = np.bincount(near, minlength=codewords)
            order, some = np.argsort(near, kind="stable"), n > 0
            total = np.add.reduceat(rest[order], (np.cumsum(n) - n)[some], axis=0)
            centre = rest[rng.integers(len(rest), size=codewords)]
            centre[some] = total / n[some, None]
        books[m] = centre
        rest -= centre[_closest(rest, centre)]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the sums): beam search over the codebooks in turn, some rows at a time."""
    codes = np.empty((len(x), len(books)), np.uint8)
    halves = 0.5 * (books**2).sum(2)
    turned = np.ascontiguousarray(books.transpose(0, 2, 1))
    for a in range(0, len(x), 4 * _ROWS):
        some = x[a : a + 4 * _ROWS].astype(np.float32)
        padded = np.concatenate([some, np.zeros((-len(some) % _ROWS, x.shape[1]), np.float32)])
        codes[a : a + len(some)] = _search(padded, books, halves, turned, beam)[: len(some)]
    total = np.zeros(x.shape, np.float32)
    for m, book in enumerate(books):
        total += book[codes[:, m]]
    return codes, (total.astype(np.float64) ** 2).sum(1)


def _search(x: np.ndarray, books: np.ndarray, halves: np.ndarray, turned: np.ndarray, beam: int) -> np.ndarray:
    n, k, d = len(x), books.shape[1], books.shape[2]
    rest, codes, cost = x[:, None, :], np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
    for book, half, flipped in zip(books, halves, turned):
        # |r - c|^2 / 2 = |r|^2 / 2 + |c|^2 / 2 - r.c, of which |r|^2 / 2 is the cost so far
        flat = (cost[:, :, None] + half - _products(rest.reshape(-1, d), flipped).reshape(n, -1, k)).reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(flat, best, 1)
        parent, word = best // k, best % k
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(n), cost.argmin(1)]


def block_neighbours(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, codes: np.ndarray,
                     norms: np.ndarray, books: np.ndarray, top: int, rerank: int | None = None, euclidean: bool = False):
    """(query id, id, score) of each query's ``top`` in a block whose ids ascend.

    Approximate scores are sums of lookup-table entries, for distances less half of the stored norm. Candidates with equal
    approximate scores are kept by id, smallest first. Exact scores are summed row by row, so equal vectors have equal ones.
    """
    out = ([], [], [])
    rerank = rerank or max(LEAST_RERANK, top, len(ids) // RERANK_PART)
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    half = (0.5 * norms).astype(np.float32)
    # some queries at a time, side by side, so that a code's entries for all of them are read together
    for first in range(0, len(queries), _TOGETHER):
        asked = queries[first : first + _TOGETHER]
        tables = np.einsum("mkd,qd->mkq", books, asked.astype(np.float32))
        scores, part = np.empty((2, len(ids), len(asked)), np.float32)
        tables[0].take(columns[0], axis=0, out=scores, mode="clip")
        for words, at in zip(tables[1:], columns[1:]):
            words.take(at, axis=0, out=part, mode="clip")
            scores += part
        if euclidean:
            scores -= half[:, None]
        for q, qid, score in zip(asked, query_ids[first:], np.ascontiguousarray(scores.T)):
            _rerank(out, q, qid, score, base, ids, top, rerank, euclidean)
    return tuple(np.concatenate(c) if c else np.array([], kind) for c, kind in zip(out, (np.int64, np.int64, float)))


def _rerank(out, q, qid, score, base, ids, top: int, rerank: int, euclidean: bool) -> None:
    """Add one query's best to ``out``: the ``rerank`` highest approximate scores, scored exactly."""
    own = slice(np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right"))
    score[own] = -np.inf
    keep = min(rerank, len(ids) - (own.stop - own.start))
    if keep <= 0:
        return
    edge = np.partition(score, len(score) - keep)[len(score) - keep]
    above = np.flatnonzero(score > edge)
    at = np.concatenate([above, np.flatnonzero(score == edge)[: keep - len(above)]])
    near = base[at].astype(np.float64)
    exact = -((near - q) ** 2).sum(1) if euclidean else (near * q).sum(1)
    order = np.lexsort((ids[at], -exact))[:top]
    out[0].append(np.full(len(order), qid))
    out[1].append(ids[at][order])
    out[2].append(exact[order])


def nearest(df: DataFrame, queries: DataFrame | None = None, top: int = 20, vector: str = "embedding", key: str = "vec_id",
            codebooks: int = CODEBOOKS, rerank: int | None = None, seed: int = 5, measure: str = "inner_product") -> DataFrame:
    """(query_id, rank, key, score): for each query the ``top`` found by inner product or, as ``measure``, "euclidean".

    Scores are exact, in double precision: the inner product, or minus the squared distance. Ties go to the smaller key. All rows
    with the query's key are its own and left out; else equal keys are rows of their own. Rows whose key or vector is null, whose
    vector is zero, holds null, NaN or infinite components, or has another length than most vectors take no part on either
    side. Fewer candidates give fewer rows, an empty table none. Other columns play no part.
    """
    if measure not in ("inner_product", "euclidean"):
        raise ValueError(f"unknown measure {measure!r}")
    spark = df.sparkSession
    short = all(t.schema[vector].dataType.simpleString() == "array<float>" for t in (df, queries) if t is not None)

    def usable(t: DataFrame, id_: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
        kept = F.col(vector) if short else v  # floats are exact as they are and half the size
        return t.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fit).select(F.col(key).cast("long").alias(id_), kept.alias("x"))

    base = usable(df, "id")
    lengths = base.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"query_id long, rank int, `{key}` long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["d"]
    base = base.filter(F.size("x") == dims)
    asked = base.withColumnRenamed("id", "qid") if queries is None else usable(queries, "qid").filter(F.size("x") == dims)

    sample = np.array([r["x"] for r in base.select("x", uniform(seed, F.col("id")).alias("u")).orderBy("u").limit(TRAIN_ROWS).select("x").collect()])
    books = spark.sparkContext.broadcast(train(sample, codebooks, min(CODEWORDS, len(sample))))

    def index(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            codes, norms = encode(x, books.value)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codebooks), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed.cast(pa.binary()), pa.array(norms)], ["id", "x", "codes", "norm"])

    indexed = materialize(base.mapInArrow(index, f"id long, x array<{'float' if short else 'double'}>, codes binary, norm double"), "codes")
    n_base, n_query = indexed.count(), asked.count()
    query_blocks = max(1, -(-n_query // QUERY_ROWS))
    cores = -(-spark.sparkContext.defaultParallelism // query_blocks)
    base_blocks = max(-(-n_base // BASE_ROWS), min(cores, -(-n_base // LEAST_ROWS)))

    # Every block of queries meets every block of base vectors: both are dealt by the pair of blocks.
    left = indexed.select("id", "x", "codes", "norm", F.floor(uniform(seed, F.col("id")) * base_blocks).cast("int").alias("b"),
                          F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = asked.select("qid", "x", F.floor(uniform(seed + 1, F.col("qid")) * query_blocks).cast("int").alias("q"),
                         F.explode(F.sequence(F.lit(0), F.lit(base_blocks - 1))).alias("b"))

    def scan(_, rows: pa.Table, asks: pa.Table) -> pa.Table:
        if rows.num_rows and asks.num_rows:
            rows = rows.take(pc.sort_indices(rows["id"]))
            x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            y = asks["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, codebooks)
            found = block_neighbours(y, asks["qid"].to_numpy(), x, rows["id"].to_numpy(), codes, rows["norm"].to_numpy(), books.value, top, rerank, measure == "euclidean")
        else:
            found = (np.array([], np.int64), np.array([], np.int64), np.array([], float))
        return pa.table(dict(zip(("query_id", key, "score"), map(pa.array, found))))

    met = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(scan, f"query_id long, `{key}` long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", key, "score")
