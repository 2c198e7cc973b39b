import itertools
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing
from barloom.llm.common import word_count

from .helpers import awkward, documents, empty, with_clashes, words


def test_targets_stop_at_twice_the_source():
    got = mixing.source_targets({"a": 10, "b": 100, "c": 100, None: 40})
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(375) and list(got) == ["a", "b", "c", None]
    assert got["c"] * 2 == pytest.approx(got["b"]) or got["b"] == 200
    assert mixing.source_targets({"a": 0}) == {"a": 0.0}


def cost(flow, capacity):
    return sum(max(0, sum(f.values()) - capacity[p]) for p, f in flow.items())


def test_flow_is_largest_and_repeats_least():
    rng = random.Random(4)
    for _ in range(60):
        patterns = [p for k in (1, 2) for p in itertools.combinations("abc", k)]
        capacity = {p: rng.randint(0, 3) for p in rng.sample(patterns, rng.randint(1, 3))}
        quota = {s: rng.randint(0, 4) for s in sorted({s for p in capacity for s in p})}
        flow = mixing.route(capacity, quota)
        for p, f in flow.items():
            assert sum(f.values()) <= 2 * capacity[p] and min(f.values()) >= 0
        got = {s: sum(f.get(s, 0) for f in flow.values()) for s in quota}
        assert all(got[s] <= quota[s] for s in quota)
        options = [[c for c in itertools.product(range(2 * n + 1), repeat=len(p)) if sum(c) <= 2 * n] for p, n in capacity.items()]
        best = (0, 0)
        for choice in itertools.product(*options):
            f = {p: dict(zip(p, c)) for p, c in zip(capacity, choice)}
            if all(sum(g.get(s, 0) for g in f.values()) <= quota[s] for s in quota):
                best = max(best, (sum(map(sum, choice)), -cost(f, capacity)))
        assert best == (sum(got.values()), -cost(flow, capacity))


def mix(df):
    return mixing.mix(df, F.array("source"), word_count(F.col("text")))


def test_takes_come_near_the_targets_and_repeat(spark):
    rng = random.Random(5)
    df = documents(spark, [(i, words(rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)])
    rows = mix(df).collect()
    assert len(rows) == 3000 and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and sum(r.size for r in own) == own[0].source_size
    again = mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_overlapping_sources_share_their_documents(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)], "doc_id long, sources array<string>, n long")
    rows = mixing.mix(df, F.col("sources"), F.col("n")).collect()
    assert sum(r.taken for r in rows) == pytest.approx(2000, abs=20)


def test_awkward_rows(spark):
    rows = mix(with_clashes(awkward(spark), "size", "taken", "_key")).collect()
    assert len(rows) == 9 and {r.doc_id: r.size for r in rows}[6] == 3 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mix(empty(spark)).count() == 0
