"""Toxicity by class-conditional Kneser-Ney models of characters.

Each class, toxic and ordinary, has a model of a character after the five before it in its word. Both back off to one
interpolated Kneser-Ney model of the two classes' texts (orders 6 to 1, continuation counts below the top), so that
what a class has not shown often weighs little. A word's evidence is the difference of its two log-likelihoods; a character
that neither class has shown after what is before it counts only against the toxic class, so that new words are not held against a document. A document's score comes
from the difference over the whole text, normalised by its length, and over its three most telling words, through
a logistic curve fitted on labelled documents that the models in question had not seen.

Counts are Spark tables of distinct words and n-grams, which grow with the labelled texts. A model is sent to the
executors while it is small; beyond that the distinct words of the documents are joined with it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, sliced, uniform
from .tokens import release

ORDER = 6
#: Discounts of the shared model and of a class: a class must show an n-gram over twice before it counts.
DISCOUNT, CLASS_DISCOUNT = 0.75, 2.0
THRESHOLD = 0.3
#: Words whose evidence is taken by itself: the most telling ones of a document.
TELLING = 3
#: Longer words, as in scripts without spaces, are cut in pieces of so many characters.
MOST_CHARS = 24
#: Where the curve meets the threshold at least this share of the labelled rows above it is toxic.
LEAST_PRECISION = 0.85
#: Labelled documents, about, chosen by a seeded hash of their ids, that the logistic curve is fitted on.
CURVE_ROWS = 20_000
#: Folds of the labelled documents; a curve row is scored by the models counted on the other folds.
FOLDS = 3
#: Labels up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000
#: n-grams and histories of a model up to this many rows are broadcast, 12 bytes each.
BROADCAST_GRAMS = 1 << 23
#: Words that a task counts, or a worker remembers, at once.
_HELD = 100_000
_LEARNT = 20_000
#: Odd numbers that spread the characters of an n-gram over 64 bits, the last character's first.
_SPREAD = np.random.default_rng(17).integers(1 << 62, 1 << 63, ORDER, dtype=np.uint64) | np.uint64(1)
_MIX, _HISTORY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> Counter:
    """How often each word, in lower case, stands in a text."""
    found = (text or "").lower().split()
    if max(map(len, found), default=0) > MOST_CHARS:
        found = [w[i : i + MOST_CHARS] for w in found for i in range(0, len(w), MOST_CHARS)]
    return Counter(found)


def grams(word: str, order: int = ORDER) -> list[str]:
    """The n-grams that end at each character of a word and at its end; shorter ones begin with the word, marked by a space."""
    s = f" {word} "
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return (x ^ x >> np.uint64(32)).view(np.int64)


def gram_keys(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, history keys, n-grams of each word): 64-bit numbers for the ``grams`` of words, one after the other, and what is before their last characters."""
    gap = "\0" * (ORDER - 1)  # in front of a word's first n-grams, where it adds nothing
    line = gap + "".join(f" {w} {gap}" for w in found)
    s = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in found], np.int64)
    starts = ORDER - 1 + np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
    counts = sizes + 1
    at = np.arange(counts.sum()) + np.repeat(starts + 1 - (np.cumsum(counts) - counts), counts)
    history = np.zeros(len(at), np.uint64)
    for j in range(1, ORDER):
        history += s[at - j] * _SPREAD[j]
    return _mixed(history + s[at] * _SPREAD[0]), _mixed(history + _HISTORY), counts


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a slight ridge on scaled features."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit from which calling a text toxic gives the best F1 on the curve's rows at a precision of LEAST_PRECISION or more."""
    order = np.argsort(-logit, kind="stable")
    hits, called = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = np.where(hits >= LEAST_PRECISION * called, 2 * hits / (called + y.sum()), 0) if len(y) else np.zeros(0)
    if not len(y) or not f1.max():
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    i = int(f1.argmax())
    after = logit[order[i + 1]] if i + 1 < len(y) else logit[order[i]] - 1
    return float((logit[order[i]] + after) / 2)


def count_words(labelled: DataFrame, text: str = "text", label: str = "_label", fold: str = "_fold") -> DataFrame:
    """(word, c): how often each word stands in the labelled texts, c an array of counts by label * FOLDS + fold."""

    def run(batches):
        release()
        held = [Counter() for _ in range(2 * FOLDS)]

        def flush():
            slots = [i for i, c in enumerate(held) for _ in c]
            out = pa.RecordBatch.from_arrays(
                [pa.array([w for c in held for w in c], pa.string()), pa.array(slots, pa.int32()), pa.array([n for c in held for n in c.values()], pa.int64())],
                ["word", "slot", "n"],
            )
            for c in held:
                c.clear()
            return out

        for batch in sliced(batches):
            for t, y, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[y * FOLDS + f].update(words(t))
                if sum(map(len, held)) > _HELD:
                    yield flush()
        yield flush()

    rows = labelled.select(text, F.col(label).cast("int"), F.col(fold).cast("int")).mapInArrow(run, "word string, slot int, n long")
    counts = [F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)) for i in range(2 * FOLDS)]
    return rows.groupBy("word").agg(F.array(*counts).alias("c"))


def count_grams(counted: DataFrame) -> DataFrame:
    """(gram, key, h_key, c): the counts of n-grams from those of distinct words, with their and their histories' keys."""

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            keys, before, counts = gram_keys(found)
            of = pa.array(np.repeat(np.arange(len(found)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for w in found for g in grams(w)], pa.string()), pa.array(keys), pa.array(before), batch.column(1).take(of)], ["gram", "key", "h_key", "c"]
            )

    rows = counted.mapInArrow(run, "gram string, key long, h_key long, c array<long>")
    return rows.groupBy("gram", "key", "h_key").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(2 * FOLDS))).alias("c"))


def _history(gram: str = "gram") -> Column:
    return F.expr(f"left({gram}, char_length({gram}) - 1)")


def shared_model(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, q): the shared model's probability of the last character of each n-gram of ``counted`` (gram, n).

    n-grams of full order, and those from a word's beginning, have their counts; all shorter ones count the
    different characters that stand before them.
    """
    top = counted.select("gram", "n")
    parts = top.select("gram", F.explode(F.sequence(F.lit(2), F.char_length("gram"))).alias("at"))
    parts = parts.select(F.expr("substring(gram, at)").alias("gram"), F.expr("substring(gram, at - 1, 1)").alias("before")).distinct()
    every = top.union(parts.groupBy("gram").agg(F.count("*").alias("n"))).withColumn("h", _history())
    known = every.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    every = every.join(known, "h").select(
        "gram", F.char_length("gram").alias("size"), (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("own"),
        (DISCOUNT * F.col("kinds") / F.col("total")).alias("rest"),
    )
    every = materialize(every, "orders")
    characters = every.filter("size = 1")
    unknown = 1 / (characters.count() + 1)  # characters that no text has are one more
    below = characters.select("gram", (F.col("own") + F.col("rest") * unknown).alias("q"))
    out = below.filter("false")
    for size in range(2, order + 1):
        above = every.filter(F.col("size") == size).withColumn("lower", F.expr("substring(gram, 2)"))
        lower = below.select(F.col("gram").alias("lower"), F.col("q").alias("q_lower"))
        below = materialize(above.join(lower, "lower").select("gram", (F.col("own") + F.col("rest") * F.col("q_lower")).alias("q")), f"order-{size}")
        out = out.union(below if size == order else below.filter("substring(gram, 1, 1) = ' '"))
    return out


def class_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, r): log p(toxic) - log p(ordinary) for n-grams, and for what is unseen after histories, 0 at most.

    r holds the ratio by the models of all folds, then by those without each fold. Keys are those of ``gram_keys``.
    """
    total = sum(F.col("c")[i] for i in range(2 * FOLDS))
    shared = shared_model(counted.select("gram", total.alias("n")), order)

    def count(model: int, label: int) -> Column:
        """Of all folds as model 0, without fold f as model f + 1."""
        return sum(F.col("c")[label * FOLDS + f] for f in range(FOLDS) if f != model - 1).cast("double")

    models, sides = range(FOLDS + 1), (0, 1)
    with_history = counted.withColumn("h", _history())
    kept = lambda c: F.least(c, F.lit(CLASS_DISCOUNT))
    known = materialize(with_history.groupBy("h").agg(
        F.min("h_key").alias("h_key"), *(F.sum(count(m, y)).alias(f"n{m}{y}") for m in models for y in sides), *(F.sum(kept(count(m, y))).alias(f"d{m}{y}") for m in models for y in sides)
    ), "histories")
    rows = with_history.join(shared, "gram").join(known.drop("h_key"), "h")

    def p(m: int, y: int) -> Column:
        n = F.col(f"n{m}{y}")
        return F.when(n > 0, (count(m, y) - kept(count(m, y)) + F.col(f"d{m}{y}") * F.col("q")) / n).otherwise(F.col("q"))

    def rest(m: int, y: int) -> Column:
        return F.when(F.col(f"n{m}{y}") > 0, F.col(f"d{m}{y}") / F.col(f"n{m}{y}")).otherwise(1.0)

    def unseen(m: int) -> Column:
        return F.least(F.log(rest(m, 1)) - F.log(rest(m, 0)), F.lit(0.0))

    def seen(m: int) -> Column:  # without a fold, what only that fold has shown is unseen
        return F.when(count(m, 0) + count(m, 1) > 0, F.log(p(m, 1)) - F.log(p(m, 0))).otherwise(unseen(m))

    ratios = lambda f: F.array(*(f(m).cast("float") for m in models)).alias("r")
    return rows.select("key", ratios(seen)).union(known.select(F.col("h_key").alias("key"), ratios(unseen)))


class _Evidence:
    """The evidence of words by a model sent to the executors: sorted keys and their ratios."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.keys, self.ratios, self.known = keys, ratios, {}

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return np.where(hit, self.ratios[at] if len(self.keys) else 0, 0).astype(float), hit

    def learn(self, new: list[str]) -> None:
        keys, before, counts = gram_keys(new)
        value, hit = self._look(keys)
        miss = np.flatnonzero(~hit)
        value[miss] = self._look(before[miss])[0]
        self.known.update(zip(new, np.add.reduceat(value, np.cumsum(counts) - counts).tolist()))

    def features(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        out: list[tuple[float, ...]] = []
        found: list[Counter] = []
        new: dict[str, None] = {}
        for t in texts:
            found.append(words(t))
            new.update(dict.fromkeys(w for w in found[-1] if w not in self.known))
            if len(new) > _LEARNT:
                out += self._finish(found, new)
                found, new = [], {}
        return out + self._finish(found, new)

    def _finish(self, found: list[Counter], new: dict[str, None]) -> list[tuple[float, ...]]:
        if len(self.known) + len(new) > _HELD:
            self.known, new = {}, dict.fromkeys(w for own in found for w in own)
        if new:
            self.learn(list(new))
        out = []
        for own in found:
            ratios, times = np.array([self.known[w] for w in own]), np.array(list(own.values()), float)
            sizes = np.array([len(w) + 1 for w in own], float)
            telling = np.sort(ratios)[::-1][:TELLING].tolist()
            out.append((1.0, float(ratios @ times / max(1.0, sizes @ times)) if own else 0.0, *telling, *[0.0] * (TELLING - len(telling))))
        return out


def joined_features(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(_id, x) for texts (_id, text, model): the features by joins, for models too large to send; ids are unique."""

    def split(batches):
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(2).take(of), pa.array([w for c in found for w in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())],
                ["_id", "model", "word", "n"],
            )

    def spell(batches):
        for batch in batches:
            keys, before, counts = gram_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(keys), pa.array(before)], ["word", "key", "h"])

    own = materialize(texts.select("_id", "text", "model").mapInArrow(split, "_id long, model int, word string, n long"), "words")
    spelt = own.select("word").distinct().mapInArrow(spell, "word string, key long, h long")
    spelt = spelt.join(ratios, "key", "left").join(ratios.select(F.col("key").alias("h"), F.col("r").alias("rest")), "h", "left")
    each = [F.sum(F.coalesce(F.col("r")[m], F.col("rest")[m], F.lit(0.0)).cast("double")) for m in range(FOLDS + 1)]
    valued = own.join(spelt.groupBy("word").agg(F.array(*each).alias("v")), "word").withColumn("v", F.get("v", F.col("model")))
    size = F.col("n") * (F.char_length("word") + 1)
    found = valued.groupBy("_id").agg((F.sum(F.col("v") * F.col("n")) / F.sum(size)).alias("mean"), F.slice(F.sort_array(F.collect_list("v"), False), 1, TELLING).alias("top"))
    x = F.array(F.lit(1.0), F.coalesce("mean", F.lit(0.0)), *(F.coalesce(F.get("top", F.lit(i)), F.lit(0.0)) for i in range(TELLING)))
    return texts.select("_id").join(found, "_id", "left").select("_id", x.alias("x"))


class Model:
    """A fitted scorer: the ratios, broadcast or as a table, and the weights of the curve."""

    def __init__(self, weights: np.ndarray, evidence=None, ratios: DataFrame | None = None):
        self.weights, self.evidence, self.ratios = [float(w) for w in weights], evidence, ratios

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add score (0 to 1, never null) and predicted (1 from ``THRESHOLD`` on) to every row; clashing columns are replaced.

        Null and empty texts have the score of a text without evidence; equal texts have equal scores; an empty table stays one.
        """
        df = df.drop("score", "predicted")
        if self.ratios is not None:
            return self._score_joined(df, text)
        names = df.columns
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        at, evidence, w = names.index(text), self.evidence, np.array(self.weights)

        def run(batches):
            release()
            for batch in sliced(batches):
                x = np.array(evidence.value[-1].features(batch.column(at).to_pylist())).reshape(-1, len(w))
                score = 1 / (1 + np.exp(-np.clip((x * w).sum(1), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

        return df.mapInArrow(run, f"{fields}, score double, predicted int")

    def _score_joined(self, df: DataFrame, text: str) -> DataFrame:
        rows = materialize(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.monotonically_increasing_id().alias("_id")), "scored-rows")
        x = joined_features(rows.select("_id", F.col(f"_row.`{text}`").alias("text"), F.lit(0).alias("model")), self.ratios)
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum(F.col("x")[i] * w for i, w in enumerate(self.weights))))
        scored = rows.join(x.select("_id", (1 / (1 + F.exp(-logit))).alias("score")), "_id")
        return scored.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _send(spark, ratios: DataFrame, models: range):
    """A broadcast list of the evidence by each of the models."""
    table = ratios.select("key", *(F.col("r")[m].alias(f"r{m}") for m in models)).toArrow()
    keys = table["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]  # the same array in all of them, sent and held once
    return spark.sparkContext.broadcast([_Evidence(keys, table[f"r{m}"].to_numpy()[order]) for m in models])


def _curve(sample: DataFrame, evidence) -> DataFrame:
    def run(batches):
        release()
        for batch in sliced(batches):
            label, fold, texts = (batch.column(i).to_pylist() for i in range(3))
            x: list = [None] * len(texts)
            for f in set(fold):
                at = [i for i, g in enumerate(fold) if g == f]
                for i, features in zip(at, evidence.value[f].features([texts[i] for i in at])):
                    x[i] = features
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["_label", "x"])

    return sample.select(F.col("_label").cast("int"), F.col("_fold").cast("int"), "text").mapInArrow(run, "_label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", seed: int = 7,
        broadcast_grams: int = BROADCAST_GRAMS) -> Model:
    """Count the models on all labelled rows that are not held out and fit the curve.

    Labels are 0 or 1, other and null ones are passed over, as are null keys and held-out ones. Keys with several labels or several
    documents count once for each. Without documents of both classes every score is the share of toxic ones (0 if there are none).
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key), F.col(label).alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out(key)).distinct()
    fold = F.crc32(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))) % FOLDS
    # two numbers a row: sent to every executor while that is little, else joined by a shuffle
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    labelled = docs.select(key, F.col(text).alias("text")).join(side, key).withColumn("_fold", fold)
    n = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        none = spark.sparkContext.broadcast([_Evidence(np.zeros(0, np.int64), np.zeros(0, np.float32))])
        return Model(np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), *[0.0] * (1 + TELLING)]), none)
    with scratch(spark) as keep:
        counted = materialize(count_grams(count_words(labelled)), "grams")
        ratios = materialize(class_ratios(counted), "ratios")
        small = ratios.count() <= broadcast_grams
        sample = labelled.filter(uniform(seed, F.col(key)) < CURVE_ROWS / sum(n.values()))
        if small:
            parts = _send(spark, ratios, range(1, FOLDS + 1))
            curve = _curve(sample, parts).collect()
            parts.destroy()
            whole = _send(spark, ratios, range(1))
        else:
            rows = materialize(sample.select("text", "_label", (F.col("_fold") + 1).cast("int").alias("model"), F.monotonically_increasing_id().alias("_id")), "curve-rows")
            curve = joined_features(rows, ratios).join(rows, "_id").select("_label", "x").collect()
            keep(ratios)
    x, y = np.array([r["x"] for r in curve]).reshape(-1, 2 + TELLING), np.array([r["_label"] for r in curve], float)
    weights = _logistic(x, y) if len(y) else np.array([0.0, 1.0, *[0.0] * TELLING])
    weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut((x * weights).sum(1), y)
    return Model(weights, whole) if small else Model(weights, None, ratios)
