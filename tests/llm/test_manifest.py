"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import manifest, queries

from .helpers import awkward, documents, empty, with_clashes

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def path(levels, i, fan):
    """[(siblings before, siblings after)] of each level below the last."""
    out = []
    for nodes in levels[:-1]:
        a = i // fan * fan
        out.append((nodes[a:i], nodes[i + 1 : a + fan]))
        i //= fan
    return out


def brute(rows, fan=2):
    """rows: dicts; (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each."""
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"], leaf([r[n] for n in NAMES]), r))
    for g in langs.values():
        g.sort(key=lambda x: (first(x[0]), x[1]))
    trees = {g: tree([x[1] for x in rs], fan) for g, rs in langs.items()}
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order], fan)
    out = []
    for g, rs in langs.items():
        for i, (key, own, r) in enumerate(rs):
            steps = path(trees[g], i, fan) + path(top, order.index(g), fan)
            claim = own
            if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 and r["n_chars"] is not None:
                claim = leaf([r[n] + 1 if n == "n_chars" else r[n] for n in NAMES])
            for before, after in steps:
                claim = h(*before, claim, *after)
            out.append((key, own, trees[g][-1][0], top[-1][0], h(*(x for b, a in steps for x in b + a)), claim, claim == top[-1][0]))
    return out


def found(df, fan=2):
    claimed = manifest.leaf(*(F.col(n) + 1 if n == "n_chars" else F.col(n) for n in NAMES))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.manifest(df, NAMES, "lang", "doc_id", fan, F.when(tampered, claimed))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), "folded_root", "verified").collect()]


def plain(rows):
    return sorted(map(repr, rows))


def rows_of(df):
    return [r.asDict() for r in df.select(*NAMES).collect()]


@pytest.mark.parametrize(("fan", "tier"), [(2, 4), (2, 256), (3, 9), (5, 3)])
def test_equals_plain_trees(spark, monkeypatch, fan, tier):
    monkeypatch.setattr(manifest, "TIER", tier)
    sizes = {None: 3, "": 1, "de": 37, "é": 2, "z": 16, "en": 70}
    rows = [(i * 10 + k, f"text {i} {lang}" if i % 9 else None, lang, f"s{i % 3}" if i % 4 else None, i if i % 5 else None) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = found(df, fan)
    assert len(got) == len(rows) and plain(got) == plain(brute(rows_of(df), fan))
    assert {r[6] for r in got} == {True, False}


def test_awkward_tables(spark):
    for df in (awkward(spark), with_clashes(awkward(spark), "_g", "_k", "_hash", "leaf", "root", "_place", "level")):
        assert plain(found(df)) == plain(brute(rows_of(df)))
    assert found(empty(spark)) == []
    lone = documents(spark, [(5, "alone", "a")])
    one = found(lone)[0]
    assert one[1] == one[2] == one[3] and one[4] == h("")
    with pytest.raises(ValueError, match="fan"):
        manifest.manifest(lone, NAMES, "lang", "doc_id", 1)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert plain(map(tuple, got.select(*names).collect())) == plain(want.fetchall())
