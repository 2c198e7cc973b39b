import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import packing, repair
from barloom.llm.tokens import WordEncoder, default_vocabulary, encoder

from .helpers import awkward, documents, empty, with_clashes, words

TEXTS = [
    "", "Hello, World! it's 3.14 -- ok", "ÀÉÎ naïve Straße ÑANDÚ", "a b c", "é ﬁ İ ΣΑΣ", "x'll don't 's", "<|endoftext|> end", "日本語 text 123", "\U0001f600!!", "a\tb\r\nc  d",
]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


@pytest.mark.parametrize("text", TEXTS)
def test_word_by_word_equals_the_library(text):
    assert list(array("I", encoder(default_vocabulary()).encode(text))) == library_ids(text)


def test_capitals_and_marks_make_no_new_words():
    coder = WordEncoder(default_vocabulary())
    texts = ["Tree, tree. TREE; tree", None, "(x) Übung! übung's", "Tree"]
    assert [list(array("I", x)) for x in coder.encode_all(texts)] == [library_ids(t) for t in texts]
    assert {b"tree", b",", b".", b";", "übung".encode()} <= set(coder.words)
    assert not {b"Tree", b"tree,", b"tree.", b"Tree,", b"TREE;"} & set(coder.words)
    # small h and t compose with these marks, H and T do not; tokens of the vocabulary's own stand in capitals nowhere
    texts = ["H\u0331, h\u0331, T\u0308. t\u0308.", "<|endoftext|> <|ENDOFTEXT|>", "a,\u0301 a\u0301, e\u0323\u0302;", "É, É. ×, ÷. x\u037e y, \u2014z\u2014, 1st, it's,'tis('s"] * 3
    assert [list(array("I", x)) for x in coder.encode_all(texts)] == [library_ids(t) for t in texts]


def test_texts_are_encoded_in_blocks():
    coder = WordEncoder(default_vocabulary())
    texts = [words(i % 50, i) + ("," * (i % 3)) for i in range(3000)] + [words(60_000), "", None]
    taken = []
    got = coder.encode_all(taken.append(t) or t for t in texts)
    first = next(got)
    assert 1 < len(taken) < len(texts) / 2
    assert [first, *got] == [coder.encode(t) for t in texts]


def test_pairs_are_ranked_in_a_full_bin(monkeypatch):
    monkeypatch.setattr(repair, "_BINS", 3)
    rng = np.random.default_rng(5)
    pairs = rng.permutation(np.arange(1000, dtype=np.uint64) * np.uint64(0x100000007))
    chosen, bins = pairs[:300], repair._bin((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    assert repair._ranks(pairs, bins, chosen).tolist() == [*range(300), *[300] * 700]


def test_grammar_round_trip():
    rng = random.Random(1)
    for _ in range(40):
        docs = [array("I", [rng.choice([1, 2, 3, 3, 3, 4, 5]) for _ in range(rng.randint(0, 60))]).tobytes() for _ in range(rng.randint(1, 30))]
        shard = repair.Shard(repair.write_shard(docs, 10))
        assert [x.tolist() for x in shard.documents()] == [[*array("I", d), 2] for d in docs]
        assert [shard.document(i).tolist() for i in range(len(docs))] == [[*array("I", d), 2] for d in docs]
    ids = np.array(([7, 8, 9, 7, 8] * 500 + [2]) * 3)
    symbols, rules = repair.build_grammar(ids, 100)
    assert len(symbols) < len(ids) / 4 and len(rules) and (symbols == 2).sum() == 3
    with pytest.raises(ValueError):
        repair.Shard(b"nope" + bytes(40))


def test_rounds_go_on_while_they_pay():
    rng = random.Random(2)
    page = [rng.randrange(3, 90) for _ in range(1000)]
    docs = [array("I", page).tobytes()] * 300 + [array("I", [rng.randrange(3, 90) for _ in range(50)]).tobytes()]
    image = repair.write_shard(docs, 100)
    shard = repair.Shard(image)
    assert max(shard.lengths) > 200  # far beyond the 16 ids of four rounds
    assert len(image) < 300 * 1000 * 4 / 20
    assert shard.document(7).tolist() == [*page, 2] and shard.document(300).tolist() == [*array("I", docs[-1]), 2]
    assert [repair.symbol_bytes(n) for n in (1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1)] == [2, 3, 3, 4]


def test_wide_symbols():
    rng = random.Random(3)
    docs = [array("I", [rng.choice([5, 6, 70_000, 90_000]) for _ in range(400)]).tobytes() for _ in range(20)]
    assert [x.tolist() for x in repair.Shard(repair.write_shard(docs, 100_000)).documents()] == [[*array("I", d), 2] for d in docs]


def test_documents_are_read_by_key(spark):
    df = documents(spark, [(i, words(20 + i % 7, i), "s") for i in range(300)])
    shards = repair.write_shards(df.repartition(3), shard_ids=400)
    assert shards.count() > 10
    got = {r.doc_id: r.ids for r in repair.read_documents(shards, [5, 250, 999, None]).collect()}
    assert got == {i: [*library_ids(words(20 + i % 7, i)), 2] for i in (5, 250)}
    plan = repair.read_documents(shards, [5])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(first,5)" in plan and "GreaterThanOrEqual(last,5)" in plan
    assert repair.read_documents(shards, []).count() == 0


def test_shards_give_every_document_back(spark):
    df = awkward(spark)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    shards = repair.write_shards(with_clashes(df, "part", "keys", "image"), shard_ids=500)
    got = sorted(repair.read_shards(shards).collect(), key=lambda r: r.start)
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*library_ids(r.text), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert repair.read_shards(repair.write_shards(empty(spark))).count() == 0


def best(items, capacity):
    items, least = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(items):
            least = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                place(i + 1, bins)
                bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return least


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([7, 10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce(Counter(items), capacity)
        left = [k for k, n in rest.items() for _ in range(n)]
        assert best(items, capacity) == sum(c for _, c in fixed) + (best(left, capacity) if left else 0)
        got = Counter()
        for pattern, count in packing.plan(Counter(items), capacity):
            assert sum(pattern) <= capacity
            got.update({k: n * count for k, n in Counter(pattern).items()})
        assert got == Counter(items)
    with pytest.raises(ValueError):
        packing.plan({5000: 1}, 4096)


def test_packing_places_every_piece_once(spark):
    rng = random.Random(3)
    df = awkward(spark).union(documents(spark, [(100 + i, words(rng.randint(0, 900)), "s") for i in range(150)]))
    rows = packing.pack_documents(with_clashes(df, "length", "piece", "sequence_id", "_u")).collect()
    ids = Counter((r.doc_id, crc([*library_ids(r.text), 1])) for r in df.collect() if len(library_ids(r.text)) < 4096)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows if r.piece == 0 and r.length < 4096) >= ids
    cut = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 5)
    assert [c[0] for c in cut] == list(range(len(cut))) and all(c[2] == 4096 for c in cut[:-1]) and all(c[1] == 4096 * c[0] for c in cut)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.1 * total / 4096
    assert packing.pack_documents(empty(spark)).count() == 0


def test_a_batch_of_texts_is_cut_in_slices(spark, monkeypatch):
    docs = documents(spark, [(i, words(i % 7), "s") for i in range(600)])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = packing.pieces(docs)
    out = list(run([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(600), pa.int64()), "text": [words(i % 7) for i in range(600)]})]))
    assert [b.num_rows for b in out] == [256, 256, 88]
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(600))
