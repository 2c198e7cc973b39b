"""What operators leave behind: tables in the shared folder, settings, and what workers keep."""

import os
import time

import numpy as np

from barloom.llm import resemblance, tokens, toxicity
from barloom.llm.common import drop_stored, materialize, scratch, shared_dir

from .helpers import documents, words


def stored_tables(spark):
    folder = f"{shared_dir(spark)}/barloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_scratch_leaves_what_is_kept(spark):
    before = stored_tables(spark)
    with scratch(spark) as keep_outer:
        with scratch(spark) as keep:
            first, second, third = (materialize(spark.range(n), f"t{n}") for n in (1, 2, 3))
            drop_stored(first)
            assert {n.split("-")[0] for n in stored_tables(spark) - before} == {"t2", "t3"}
            keep(third)
        fourth = keep_outer(materialize(spark.range(4), "t4"))
        assert third.count() == 3
    assert {n.split("-")[0] for n in stored_tables(spark) - before} == {"t4"} and fourth.count() == 4
    outside = materialize(spark.range(5), "t5")
    drop_stored(outside)
    assert outside.count() == 5


def test_the_near_copy_stage_leaves_one_table(spark):
    before = stored_tables(spark)
    docs = [(i, words(200, 10_000 * (i // 2)) + f" end{i}", "s") for i in range(40)]
    kept = resemblance.keep_one(documents(spark, docs), reach=1)
    assert {n.split("-")[0] for n in stored_tables(spark) - before} == {"kept"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_shuffle_files_go_when_a_table_is_stored(spark):
    jvm, name = spark.sparkContext._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: str(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")).count("shuffle_")
    was, before = spark.conf.get(name, None), files()
    table = spark.range(1000).repartition(3, "id").groupBy("id").count()
    stored = materialize(table, "shuffled")
    end = time.monotonic() + 20
    while files() > before and time.monotonic() < end:  # executors delete them by and by
        time.sleep(0.1)
    assert files() <= before
    assert stored.count() == 1000
    assert table.count() == 1000 and spark.conf.get(name, None) == was


def test_models_share_their_keys_and_fitting_leaves_no_table(spark):
    ratios = spark.createDataFrame([(k, [0.1 * k] * 4) for k in (5, 3, 9)], "key long, r array<float>")
    sent = toxicity._send(spark, ratios, range(1, 4)).value
    assert all(e.keys is sent[0].keys for e in sent) and sent[0].keys.tolist() == [3, 5, 9]
    assert np.allclose(sent[2].ratios, [0.3, 0.5, 0.9])
    before = stored_tables(spark)
    docs = documents(spark, [(i, words(30, 7 * i) + (" vile" if i % 3 == 0 else ""), "s") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert stored_tables(spark) == before
    assert model.score(docs).count() == 60


def test_workers_release_their_encoders():
    tokens.encoder(tokens.default_vocabulary()).encode("some words")
    tokens.release()
    assert not tokens._encoders


def test_a_text_with_a_new_word_is_gone_through_once():
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    coder = tokens.WordEncoder(tokens.default_vocabulary())
    known = coder.encode(words(50))
    coder.words = Counting(coder.words)
    assert coder.encode(words(50) + " unmet") == known + coder.encode("unmet")
    assert Counting.asked < 60
