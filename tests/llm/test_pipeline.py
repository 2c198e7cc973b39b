"""Each stage against a plain version on its own input, and the whole run."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import mixing
from barloom.llm.common import materialize, word_count

from .helpers import awkward, documents, empty, with_clashes
from .test_dedup import expected_lines
from .test_models import corpus
from .test_resemblance import brute_groups
from .test_tokens import library_ids


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(16)
    rows, labels = corpus(400)
    rows = [(i, t, rng.choice(["a", "a", "b", None])) for i, t, _ in rows]
    for i in range(0, 60, 2):  # copies, near-copies and shared lines
        text = rows[i + 1][1].split()
        if i % 4:
            text[len(text) // 2] = "changed"
        rows.append((1000 + i, " ".join(text), "b"))
        rows.append((2000 + i, f"Shared line number {i // 20} of some documents\nown words {i} {rows[i + 7][1][:200]}", "a"))
    rows += [(3000, None, "a"), (3001, "", None), (3002, "alone", "c")]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage."""
    docs, out, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for n, (_, after) in stages.items() if n != "best_fit_packing")


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = map(texts, stages["toxicity"])
    marked = {i for i, t in before.items() if any(w in (t or "") for w in ("zorgak", "quivvex", "wyxxed"))}
    clean = set(before) - marked
    assert len(marked & set(after)) <= 0.1 * len(marked) and len(clean & set(after)) >= 0.97 * len(clean)


def test_lines_equal_brute_force(stages):
    before, after = map(texts, stages["line_dedup"])
    gone = expected_lines(list(before.items()))
    for i, t in before.items():
        want = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)
        assert after[i] == want
    assert all(r.n_chars == len(r.text or "") for r in stages["line_dedup"][1].collect())


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["simhash_near_dedup"])
    assert sorted(after) == sorted(set(brute_groups(before.items()).values()))


def test_the_mix_takes_effect(stages):
    before, after = stages["mix_sources"]
    taken = mixing.mix(before, F.array("source"), word_count(F.col("text"))).collect()
    want = {r.doc_id: r.taken // r.size for r in taken if r.taken}
    assert Counter(r.doc_id for r in after.collect()) == want and any(n == 2 for n in want.values())


def test_every_piece_is_packed(spark, stages, sf_dir):
    before, after = stages["best_fit_packing"]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before.collect())
    sizes = {r.doc_id: len(library_ids(r.text)) + 1 for r in before.collect()}
    assert all(r.length == min(4096, sizes[r.doc_id] - r.start) for r in rows)
    assert max(Counter({s: sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}}).values()) <= 4096
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows)


CLASHES = ("size", "taken", "target", "source_size", "score", "predicted", "_copy", "_row", "_id", "fp", "n_lines", "lines")


def test_stages_bear_awkward_rows_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = with_clashes(awkward(spark), *CLASHES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "clash" for r in rows for c in CLASHES), name
        assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_hand_texts_over_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda docs: materialize(docs.select("text").mapInArrow(sizes, "n long, bytes long"), "sizes"))
    before = {k: spark.conf.get(k) for k in corpus_pipeline.BATCHES}
    docs = documents(spark, [(0, "", "s")]).select("doc_id", F.repeat(F.lit("many words "), 2_000).alias("text")).crossJoin(spark.range(0, 1_000, numPartitions=1))
    found = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sum(r.n for r in found) == 1_000
    assert max(r.bytes for r in found) < 5_000_000
    assert {k: spark.conf.get(k) for k in corpus_pipeline.BATCHES} == before
