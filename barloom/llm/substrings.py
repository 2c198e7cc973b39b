"""Repeated passages by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the bytes before has its high bits zero, so the cuts depend on the text alone
and come back in step soon after an insertion. Neighbouring chunks are compared in twos by digest; runs of twos
that also stand elsewhere are repeated, and runs that fall short of a passage are carried on into the
chunks at their ends, byte by byte, beside another place that has them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize

#: Cut where so many high bits of the hash are zero: one cut in 2**CUT_BITS bytes on average.
CUT_BITS = 4
LEAST_BYTES, MOST_BYTES = 12, 128
#: Words of a passage, and of a run of chunks that may be the middle of one: up to a chunk and the hash's window are
#: lost at the left end of what two texts share, up to a chunk at the right one.
PASSAGE_WORDS, SEED_WORDS = 50, 16
#: Bytes beside a run that are compared with the other place.
BESIDE = 512
#: Digests that stand more often are joined by broadcast, up to this many of them; runs to carry on likewise.
HOT_ROWS, BROADCAST_ROWS = 10_000, 1_000_000
_WIDTH = 16
#: Bytes that part words.
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def _gear(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << _WIDTH, 256, dtype=np.uint16)


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[data[i]] modulo 2**16, for all i at once by doubling: the last 16 bytes count."""
    h = _GEAR[data]
    step = 1
    while step < _WIDTH:
        h[step:] += h[:-step] << np.uint16(step)  # numpy buffers the overlap
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text, each of LEAST_BYTES to MOST_BYTES bytes but the last, which may be shorter."""
    n = len(data)
    h = gear_hashes(np.frombuffer(data, np.uint8))
    marks = (np.flatnonzero((h >> np.uint16(_WIDTH - CUT_BITS)) == 0) + 1).tolist()
    out, last = [], 0
    for m in marks:
        while m - last > MOST_BYTES:
            last += MOST_BYTES
            out.append(last)
        if m - last >= LEAST_BYTES:
            out.append(m)
            last = m
    while n - last > MOST_BYTES:
        last += MOST_BYTES
        out.append(last)
    if last < n:
        out.append(n)
    return out


def words_before(data: bytes) -> np.ndarray:
    """How many words begin before each place of a text, its end included."""
    white = _WHITE[np.frombuffer(data, np.uint8)]
    begins = ~white
    begins[1:] &= white[:-1]
    return np.concatenate([[0], np.cumsum(begins)])


def _row(key: str, text: str) -> Column:
    """A number for a document: rows equal in key and text have one."""
    return F.xxhash64(F.col(key), F.col(text))


def twos(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, key, digest, begin, size): each two neighbouring chunks of every text. Texts of fewer than two chunks have none.

    size packs ``SIZES`` in one number of a byte or two each: the first chunk's bytes and words, and those of both.
    """
    from xxhash import xxh3_64_intdigest  # noqa: F401  (fails here rather than on an executor)

    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            at, digest, begin, size = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                data = (t or "").encode()
                ends = cuts(data) if data else ()
                if len(ends) < 2:
                    continue
                marks = np.array([0, *ends])
                before = words_before(data)[marks]
                digest += [xxh3_64_intdigest(data[a:b]) for a, b in zip(marks[:-2].tolist(), ends[1:])]
                at.append(np.full(len(ends) - 1, i))
                first, both = marks[1:-1] - marks[:-2], marks[2:] - marks[:-2]
                begin.append(marks[:-2])
                size.append(first | both << 8 | before[1:-1] - before[:-2] << 17 | before[2:] - before[:-2] << 24)
            none = np.array([], np.int64)
            of = pa.array(np.concatenate([none, *at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.array(digest, np.uint64).view(np.int64)),
                 pa.array(np.concatenate([none, *begin]), pa.int32()), pa.array(np.concatenate([none, *size]), pa.int64())],
                ["row", "key", "digest", "begin", "size"],
            )

    rows = df.select(_row(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row long, key {kind}, digest long, begin int, size long")


#: (first bit, bits) of what ``twos`` packs: MOST_BYTES bytes hold at most half as many words.
SIZES = {"step": (0, 8), "bytes": (8, 9), "head": (17, 7), "words": (24, 8)}


def _matched(table: DataFrame) -> DataFrame:
    """The rows of ``table`` whose digest several documents have, with n, first and final: its places, the least and the greatest.

    Very frequent digests, of which there are few, never meet in one task: they are counted by partial sums and joined by broadcast.
    """
    counted = table.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("least"), F.max("row").alias("most"))
    repeated = materialize(counted.filter("least < most").select("digest", "n"), "repeated")
    place = F.struct("key", "row", "begin")
    hot, own = repeated.filter(F.col("n") > HOT_ROWS), Window.partitionBy("digest")
    n_hot = hot.count()
    few = 0 < n_hot <= BROADCAST_ROWS
    rest = table.join(repeated.filter(F.col("n") <= HOT_ROWS) if few else repeated, "digest")
    rest = rest.withColumns({"first": F.min(place).over(own), "final": F.max(place).over(own)})
    if not few:
        return rest
    found = table.join(F.broadcast(hot), "digest")
    ends = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    return found.join(F.broadcast(ends), "digest").unionByName(rest)


def _whole(byte: bytes, edge: bool) -> bool:
    """Whether a word ends beside this byte; there is none at an end of the text."""
    return byte.isspace() if byte else edge


def _begins(data: bytes, last: bytes) -> int:
    """Words that begin in ``data`` after the byte ``last``."""
    white = [not x or chr(x).isspace() for x in last + data]
    return sum(1 for a, b in zip(white, white[1:]) if a and not b)


def carry_on(left_a: bytes, left_b: bytes, right_a: bytes, right_b: bytes, edges: tuple[bool, bool, bool, bool] = (True,) * 4) -> tuple[int, int, int]:
    """(bytes to the left, bytes to the right, words more) by which two places agree beside a run they share, whole words only.

    left is what stands before the run, right its last byte and what stands after it, edges whether these reach the ends of their texts.
    """
    n = 0
    while n < min(len(left_a), len(left_b)) and left_a[-1 - n] == left_b[-1 - n]:
        n += 1
    before = [x[len(x) - n - 1 : len(x) - n] if n < len(x) else b"" for x in (left_a, left_b)]
    if not all(map(_whole, before, edges[:2])):  # a word that only one of them has whole
        while n and not left_a[len(left_a) - n - 1 : len(left_a) - n].isspace():
            n -= 1
    m = 1
    while m < min(len(right_a), len(right_b)) and right_a[m] == right_b[m]:
        m += 1
    cut = 0
    if not all(map(_whole, (right_a[m : m + 1], right_b[m : m + 1]), edges[2:])):
        while m > 1 and not (right_a[m : m + 1].isspace() or right_a[m - 1 : m].isspace()):
            m -= 1
        cut = m == 1 and not right_a[1:2].isspace() and not right_a[:1].isspace()  # the run's own last word is not whole
    return n, m - 1, _begins(left_a[len(left_a) - n :], b" ") + _begins(right_a[1:m], right_a[:1]) - cut


def repeated_passages(df: DataFrame, text: str = "text", key: str = "doc_id", passage_words: int = PASSAGE_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """(key, begin, end, words, occurrences, first_key, kept): passages that several documents share.

    Byte offsets into the UTF-8 text. A passage has ``passage_words`` words at least. Its core is a longest run of twos of neighbouring
    chunks whose digests all occur in two documents or more; a core of ``seed_words`` to ``passage_words`` words is carried on, whole word by whole
    word, while the text agrees with that beside its first and last two at another place. occurrences is the least number of
    places that one of its twos has, first_key the smallest key that holds its first one, kept whether all of it stands here
    for the first time, by key and then place. Null and empty texts have no passages; what repeats within one document only is none; rows
    equal in key and text are one document. Other columns play no part.
    """
    return _passages(df, text, key, passage_words, seed_words).drop("row")


def _passages(df: DataFrame, text: str, key: str, passage_words: int, seed_words: int = SEED_WORDS) -> DataFrame:
    """The passages of ``repeated_passages``, after the number of their document, row."""
    table = materialize(twos(df, text, key), "twos")
    other = F.when(F.col("first.row") == F.col("row"), F.col("final")).otherwise(F.col("first"))
    sizes = [F.shiftright("size", low).bitwiseAND((1 << bits) - 1).cast("int").alias(n) for n, (low, bits) in SIZES.items()]
    marked = _matched(table).select(
        "row", "key", "begin", *sizes, "n", F.col("first.key").alias("first_key"), (F.struct("key", "row", "begin") == F.col("first")).alias("is_first"), other.alias("other"),
    )
    # only rows with repeats are left; their twos that overlap make a run
    order = Window.partitionBy("row").orderBy("begin")
    marked = marked.withColumn("_again", F.lag("begin").over(order).eqNullSafe(F.col("begin"))).filter("not _again")  # of rows that stand several times
    starts = F.coalesce(F.lag(F.col("begin") + F.col("step")).over(order) != F.col("begin"), F.lit(True))
    runs = marked.withColumn("_run", F.sum(starts.cast("int")).over(order))
    ordered = F.struct("begin", F.col("other.row").alias("row"), F.col("other.begin").alias("at"), F.col("bytes"))
    found = materialize(runs.groupBy("row", "_run").agg(
        F.first("key").alias("key"), F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("bytes")).alias("end"),
        (F.sum("head") + F.max_by(F.col("words") - F.col("head"), "begin")).alias("words"), F.min("n").alias("occurrences"),
        F.min_by("first_key", "begin").alias("first_key"), F.bool_and("is_first").alias("kept"), F.min(ordered).alias("left"), F.max(ordered).alias("right"),
    ).filter(F.col("words") >= seed_words).withColumn("id", F.xxhash64("row", "begin")), "runs")
    short = found.filter(F.col("words") < passage_words)
    grown = _carried(df, short, text, key)
    columns = ["row", F.col("key").alias(key), "begin", "end", "words", "occurrences", "first_key", "kept"]
    return found.filter(F.col("words") >= passage_words).select(*columns).union(grown.filter(F.col("words") >= passage_words).select(*columns))


def _carried(df: DataFrame, short: DataFrame, text: str, key: str) -> DataFrame:
    """``short`` runs with begin, end and words carried on beside another place."""
    at = F.col("right.at") + F.col("right.bytes")
    asked = short.select("id", F.explode(F.array(
        F.struct(F.lit("la").alias("side"), "row", F.col("begin").alias("at")), F.struct(F.lit("ra").alias("side"), "row", F.col("end").alias("at")),
        F.struct(F.lit("lb").alias("side"), F.col("left.row").alias("row"), F.col("left.at").alias("at")), F.struct(F.lit("rb").alias("side"), F.col("right.row").alias("row"), at.alias("at")),
    )).alias("w")).select("id", "w.side", "w.row", "w.at")
    asked = materialize(asked, "beside")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    data = F.encode("text", "utf-8")
    low = F.greatest(F.lit(0), F.col("at") - BESIDE)
    is_left = F.substring("side", 1, 1) == "l"
    beside = F.when(is_left, F.substring(data, low + 1, F.col("at") - low)).otherwise(F.substring(data, F.col("at"), F.lit(BESIDE + 1)))
    edge = F.when(is_left, low == 0).otherwise(F.octet_length(F.col("text")) <= F.col("at") + BESIDE)
    cut = df.select(_row(key, text).alias("row"), F.col(text).alias("text")).join(few, "row").select("id", "side", F.struct(beside.alias("bytes"), edge.alias("edge")).alias("w"))
    sides = cut.groupBy("id").agg(*(F.first(F.when(F.col("side") == s, F.col("w")), ignorenulls=True).alias(s) for s in ("la", "lb", "ra", "rb")))

    def run(batches):
        for batch in batches:
            out = [carry_on(*(w["bytes"] for w in four), tuple(w["edge"] for w in four)) for four in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], pa.int32()) for i in range(3))], ["id", "more_left", "more_right", "more_words"])

    more = sides.select("id", "la", "lb", "ra", "rb").mapInArrow(run, "id long, more_left int, more_right int, more_words int")
    return short.join(more, "id").withColumns(
        {"begin": F.col("begin") - F.col("more_left"), "end": F.col("end") + F.col("more_right"), "words": F.col("words") + F.col("more_words")}
    )


def drop_repeated_passages(df: DataFrame, text: str = "text", key: str = "doc_id", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``df`` with the passages taken out of its texts that are not ``kept``; every row stays, null texts stay null.

    Characters that a passage's ends would cut stay whole. Rows that share a key and differ in text are documents each. Other columns, whatever their names, stay as they are.
    """
    gone = _passages(df, text, key, passage_words).filter("not kept")
    spans = gone.groupBy(F.col("row").alias("_of")).agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    names = df.columns
    rows = df.select(boxed(df, text), _row(key, text).alias("_own"), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(t if t is None or not spans else without(t, [(s["begin"], s["end"]) for s in spans]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_row", "_own", "_text"])

    joined = rows.join(spans, F.col("_own") == F.col("_of"), "left").select("_row", "_own", "_text", "_spans")
    fields = joined.schema["_row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"_row {fields}, _own long, _text string")
    return done.select(*(F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some spans of its bytes; what lies beyond its end is passed over."""
    data, out, at = text.encode(), [], 0
    for begin, end in sorted(spans):
        begin, end = max(begin, at), min(end, len(data))
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append(data[at:begin])
            at = end
    return b"".join([*out, data[at:]]).decode()
