"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from barloom.llm import importance, queries

from .helpers import awkward, documents, empty, with_clashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return found, [" ".join(found[i : i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]


def brute(docs, target, percent=25, least=20, longest=2, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    def totals(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, longest)[1])

    s, t = totals(x for _, x in docs), totals(target)
    whole = (sum(t.values()) + buckets, sum(s.values()) + buckets)
    rows = []
    for key, text in docs:
        found, fs = features(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * whole[1] / ((s[b] + 1) * whole[0]))) for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(found)))
    may = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = may[: percent * len(may) // 100]
    out = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    for r in drawn:
        rows.remove(r)
    return sorted(map(repr, [*out, *((*r[:4], None) for r in rows)]))


def found(docs, target, *args, **options):
    out = importance.resample(docs, target, *args, **options)
    return sorted(repr(tuple(r)) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect())


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_equals_plain_python(spark, monkeypatch, size):
    monkeypatch.setattr(importance, "TRIE_WORDS", size)
    monkeypatch.setattr(importance, "KNOWN_WORDS", size)
    rows = [(i, f"Ärger {words(i % 60, i % 7)} Über-all C3PO x{i % 5}" if i % 11 else words(30), f"s{i % 3}") for i in range(300)]
    target = [words(40, 3), "C3PO über all x4", None, ""]
    plain = [(i, t) for i, t, _ in rows]
    docs = documents(spark, rows).repartition(6)
    assert found(docs, table(spark, target)) == brute(plain, target)
    assert found(docs, table(spark, target), 100, least_words=0) == brute(plain, target, 100, 0)
    assert found(docs, table(spark, []), 7) == brute(plain, [], 7)


def test_awkward_tables(spark):
    target = [words(10), "one two"]
    plain = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()]
    for df in (awkward(spark), with_clashes(awkward(spark), "_key", "_text", "_row", "score", "rank", "weight", "_may")):
        assert found(df, table(spark, target), 50, least_words=1) == brute(plain, target, 50, 1)
    assert found(empty(spark), table(spark, target)) == []
    with pytest.raises(ValueError, match="percent"):
        importance.resample(empty(spark), table(spark, target), 101)


def test_longer_runs_and_scores_beside_other_columns(spark):
    model = importance.fit(awkward(spark), table(spark, [words(50)]), longest=3, buckets=97)
    scored = model.score(with_clashes(awkward(spark), "n_words")).collect()
    got = {r.doc_id: (r.n_words, r.n_features) for r in scored}
    assert got[5] == (20_000, 59_997) and got[4] == (3, 6) and got[1] == (0, 0) and "lang" in scored[0]


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = queries.QUERIES["op13_importance_resampling"](spark, sf).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(docs, target)
