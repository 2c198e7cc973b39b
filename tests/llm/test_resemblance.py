"""The near-copy stage of the pipeline against Jaccard similarity by brute force."""

import random

import pytest

import corpus_pipeline
from barloom.llm import resemblance

from .helpers import awkward, documents, empty, with_clashes, words


def brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def near_texts(rng):
    """Copies with 1 to 20 changed words of 200, so of all similarities around 0.8; texts of one common passage; short texts."""
    docs = []
    for i in range(150):
        w = words(200, 1000 * (i % 40)).split()
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 20])):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, words(60) + " " + words(60 + i, 10**6 * (i + 1))) for i in range(30)]
    return docs + [(300, None), (301, ""), (302, "a b"), (303, "A\tB"), (304, "a b c"), (305, " \n")]


@pytest.mark.parametrize("reach", [1, 4])
def test_every_pair_of_similar_texts_is_linked(spark, reach):
    docs = near_texts(random.Random(21))
    got = resemblance.keep_one(documents(spark, [(i, t, "s") for i, t in docs]), reach=reach).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(brute_groups(docs).values()))


def test_the_stage_takes_similarity_as_its_measure(spark):
    docs = near_texts(random.Random(22))
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, [(i, t, "s") for i, t in docs]), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_groups(docs).values()))


def test_similarity_of_awkward_rows(spark):
    kept = resemblance.keep_one(with_clashes(awkward(spark), "fp", "_id", "id", "members"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((i is None, i) for i in (1, 4, 5, 6, 7, None))
    assert resemblance.keep_one(empty(spark)).count() == 0
