import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import media, pages, quantise, toxicity

from .helpers import awkward, documents, empty, with_clashes, words


def test_container_round_trip_and_tables(spark):
    for n in (0, 1, 575, 576, 577, 576 * 700 + 5):
        data = random.Random(n).randbytes(n)
        stored = media.write_container(data)
        (track,) = media.tracks(stored)
        assert media.payload(stored, track) == media.pad(data) and track["sample_time"] == track["duration"] == len(media.pad(data)) // 576
        assert stored == media.write_container(data) and track["keyframes"] == list(zip(track["offsets"], track["sizes"]))
        assert media.merged(track["keyframes"]) == [(len(stored) - len(media.pad(data)), len(media.pad(data)))]


def test_sync_table_and_sample_sizes_are_read():
    stored = media.write_container(bytes(576 * 3))
    stts = stored.index(b"stts") - 4
    table = struct.pack(">I4sIIII", 24, b"stss", 0, 2, 1, 3)
    grown = bytearray(stored[:stts] + table + stored[stts:])
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        at = grown.index(kind) - 4
        grown[at : at + 4] = struct.pack(">I", struct.unpack_from(">I", grown, at)[0] + 24)
    at = grown.index(b"stco") + 12
    grown[at : at + 4] = struct.pack(">I", struct.unpack_from(">I", grown, at)[0] + 24)
    (track,) = media.tracks(bytes(grown))
    assert [o for o, _ in track["keyframes"]] == [track["offsets"][0], track["offsets"][2]]


def test_media_of_awkward_rows(spark):
    df = awkward(spark)
    rows = media.inspect(media.encode(with_clashes(df, "media", "n_bytes", "feature"))).collect()
    for r, d in zip(sorted(rows, key=str), sorted(rows, key=str)):
        assert r == d
    want = sorted((len((t or "").encode()), hashlib.sha256(media.pad((t or "").encode())).hexdigest(), zlib.crc32(media.pad((t or "").encode())[-32:])) for t in [r.text for r in df.collect()])
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert media.inspect(media.encode(empty(spark))).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"\0\0\0\x20moov")), (3, bytearray(b""))], "k long, media binary")
    got = {r.k: r for r in media.inspect(broken).collect()}
    assert got[1].media_bytes is None and got[2].feature.startswith("error=") and got[2].media_bytes == 8 and got[3].payload_bytes == 0


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids or range(len(x)), x)], "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(12).normal(size=(1500, 32)).astype(np.float32)
    x[700:760] = x[5]  # one common vector: ties go by id
    df = vectors(spark, x)
    got = quantise.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    x = x.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert [r.score for r in own] == pytest.approx([x[r.vec_id] @ x[q] for r in own], rel=1e-12)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -score))[:20]) & {r.vec_id for r in own})
    assert hits / (75 * 20) >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 700), key=lambda r: r.rank)] == [5, *range(701, 720)]


def test_recall_when_few_candidates_are_reranked(spark):
    # clusters around 150 centres; at most 5 % of the vectors are looked at exactly
    rng = np.random.default_rng(21)
    x = (rng.normal(size=(150, 32))[rng.integers(150, size=3000)] + 0.5 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = vectors(spark, x)
    found = {m: {} for m in ("inner_product", "euclidean")}
    for m, own in found.items():
        for r in quantise.nearest(df, df.filter("vec_id % 20 = 0"), rerank=150, measure=m).collect():
            own.setdefault(r.query_id, {})[r.vec_id] = r.score
    x, hits = x.astype(float), dict.fromkeys(found, 0)
    for q in range(0, 3000, 20):
        for m, score in (("inner_product", x @ x[q]), ("euclidean", -((x - x[q]) ** 2).sum(1))):
            got = found[m][q]
            assert all(got[i] == pytest.approx(score[i], abs=1e-9) for i in got)
            score[q] = -np.inf
            hits[m] += len(set(np.argsort(-score)[:20].tolist()) & set(got))
    assert all(h / (150 * 20) >= 0.9 for h in hits.values())


def test_beam_search_and_norms():
    rng = np.random.default_rng(22)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    books = quantise.train(x, 4, 16)
    codes, norms = quantise.encode(x, books, 4)
    total = books[np.arange(4), codes].sum(1)
    assert norms == pytest.approx((total.astype(float) ** 2).sum(1), rel=1e-5)
    rest = x.copy()
    for book in books:  # one codeword after the other, without a beam
        rest -= book[((rest[:, None] - book) ** 2).sum(2).argmin(1)]
    greedy, _ = quantise.encode(x, books, 1)
    assert x - books[np.arange(4), greedy].sum(1) == pytest.approx(rest, abs=1e-5)
    assert ((x - total) ** 2).sum() < (rest**2).sum()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0, 0], [nan, 1], [1, None], [inf, 1], [1, 2, 3]]
    df = vectors(spark, [[1, 0], [0, 1], [1, 1], *bad], [0, 20, 40, 60, 80, 100, 120, 140, 160])
    rows = quantise.nearest(with_clashes(df, "x", "codes", "rank")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 40), (0, 2, 20), (20, 1, 40), (20, 2, 0), (40, 1, 0), (40, 2, 20)]
    assert quantise.nearest(vectors(spark, [])).count() == 0
    assert quantise.nearest(vectors(spark, [[1, 2]])).count() == 0


def corpus(n=600, seed=13):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randint(30, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(3, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgak", "quivvex", "wyxxed"]))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = corpus()
    docs, marked = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.fit(docs, marked).score(docs).withColumn("held_out", toxicity.held_out()).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = [r for r in held if r.predicted == truth[r.doc_id]]
    assert len(right) / len(held) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = toxicity.fit(docs, flipped).score(docs).collect()
    scores = [{r.doc_id: r.score for r in x} for x in (again, out)]
    assert scores[0] == pytest.approx(scores[1])


def test_toxicity_of_awkward_rows(spark):
    rows, labels = corpus(120)
    marked = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows), marked)
    out = model.score(with_clashes(awkward(spark), "score", "predicted", "ratio")).collect()
    assert len(out) == 9 and all(r.score is not None for r in out) and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert model.score(empty(spark)).count() == 0
    none = toxicity.fit(documents(spark, rows), marked.filter("false")).score(documents(spark, rows[:3])).collect()
    assert [r.predicted for r in none] == [0, 0, 0]


def plain_model(pooled):
    """p(history, character) of the shared model, by the recursion as it is written, from counts of n-grams."""
    before = {}
    for g in pooled:
        for i in range(1, len(g)):
            before.setdefault(g[i:], set()).add(g[i - 1])
    count = {**{g: len(x) for g, x in before.items()}, **pooled}
    kinds, total = {}, {}
    for g, n in count.items():
        kinds[g[:-1]], total[g[:-1]] = kinds.get(g[:-1], 0) + 1, total.get(g[:-1], 0) + n
    n_characters = sum(len(g) == 1 for g in count)

    def p(history, c):
        below = p(history[1:], c) if history else 1 / (n_characters + 1)
        if history not in total:
            return below
        return max(count.get(history + c, 0) - toxicity.DISCOUNT, 0) / total[history] + toxicity.DISCOUNT * kinds[history] / total[history] * below

    return p, {g for g in count if len(g) == 1}


def labelled_counts(texts, labels):
    from collections import Counter

    counts = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        for w, n in Counter(t.lower().split()).items():
            for g in toxicity.grams(w):
                counts[y][g] += n
    return counts


def test_models_against_the_plain_recursion(spark):
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abc\u4e2d", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    labels = [int(i % 4 == 0) for i in range(60)]
    rows = spark.createDataFrame([(t, y, i % 3) for i, (t, y) in enumerate(zip(texts, labels))], "text string, _label int, _fold int")
    counted = toxicity.count_grams(toxicity.count_words(rows))
    counts = labelled_counts(texts, labels)
    got = {r.gram: list(r.c) for r in counted.collect()}
    assert {g: (sum(c[:3]), sum(c[3:])) for g, c in got.items()} == {g: (counts[0][g], counts[1][g]) for g in counts[0] + counts[1]}
    p, characters = plain_model(dict(counts[0] + counts[1]))
    unknown = "?"
    histories = {g[:-1] for g in got}
    for h in histories:
        assert sum(p(h, c) for c in characters) + p(h, unknown) == pytest.approx(1)
    shared = {r.gram: r.q for r in toxicity.shared_model(counted.select("gram", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))).collect()}
    assert shared == pytest.approx({g: p(g[:-1], g[-1]) for g in got})

    def class_p(y, h, c):
        own = {g[-1]: n for g, n in counts[y].items() if g[:-1] == h}
        n = sum(own.values())
        if not n:
            return p(h, c)
        kept = sum(min(x, toxicity.CLASS_DISCOUNT) for x in own.values())
        return (max(own.get(c, 0) - toxicity.CLASS_DISCOUNT, 0) + kept * p(h, c)) / n

    for h in sorted(histories)[::7]:
        assert all(sum(class_p(y, h, c) for c in characters) + class_p(y, h, unknown) == pytest.approx(1) for y in (0, 1))
    ratios = toxicity.class_ratios(counted)
    by_key = {r.key: r.r[0] for r in ratios.collect()}
    spelt = {r.gram: (r.key, r.h_key) for r in counted.collect()}
    assert len({k for k, _ in spelt.values()}) == len(spelt)
    for g in got:
        want = np.log(class_p(1, g[:-1], g[-1]) / class_p(0, g[:-1], g[-1]))
        assert by_key[spelt[g][0]] == pytest.approx(want, abs=1e-5)
    for h in histories:
        key, = {spelt[g][1] for g in got if g[:-1] == h}
        assert by_key[key] == pytest.approx(min(0, np.log(class_p(1, h, unknown) / class_p(0, h, unknown))), abs=1e-5)


def test_a_word_s_evidence_and_a_document_s_features(spark):
    rows, labels = corpus(90)
    docs, marked = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marked)
    train = [(t, labels[i][2]) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = labelled_counts(*zip(*train))
    table = model.evidence.value[0]
    known, histories = set(counts[0] + counts[1]), {g[:-1] for g in counts[0] + counts[1]}
    look = dict(zip(table.keys.tolist(), table.ratios.tolist()))

    def evidence(word):
        out = 0.0
        for g, key, before in zip(toxicity.grams(word), *(k.tolist() for k in toxicity.gram_keys([word])[:2])):
            out += look[key] if g in known else look[before] if g[:-1] in histories else 0.0
        return out

    for text in (rows[6][1], "zorgak zorgak other w\u00f6rds", "", None, "x" * 60):
        own = toxicity.words(text)
        value = sorted((evidence(w) for w in own), reverse=True)[:3]
        mean = sum(evidence(w) * n for w, n in own.items()) / max(1, sum((len(w) + 1) * n for w, n in own.items()))
        assert table.features([text])[0] == pytest.approx((1.0, mean, *value, *[0.0] * (3 - len(value))), abs=1e-6)
    # a model too large to send gives the same by joins
    joined = toxicity.fit(docs, marked, broadcast_grams=10)
    both = [{r.doc_id: (r.score, r.predicted) for r in m.score(with_clashes(docs, "score", "word")).collect()} for m in (model, joined)]
    assert {i: s for i, (s, _) in both[0].items()} == pytest.approx({i: s for i, (s, _) in both[1].items()}, abs=1e-5)
    few = joined.score(awkward(spark))
    assert few.count() == 9 and few.filter("score is null").count() == 0


def test_many_labels_for_few_documents(spark):
    rows, labels = corpus(12)
    many = labels + [(i, 0, i % 2) for i in range(1000, 60_000)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(many, "doc_id long, quality int, toxic int"))
    assert model.score(documents(spark, rows)).count() == 12


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(15)
    for _ in range(1000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        at = sorted(pages.common(a, b))
        rest = iter(b)
        assert len(at) == lcs(a, b) and all(a[i] in rest for i in at)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Home</ul></nav><script>var a="<p>x</p>";</script>{}
<div class="cookie-notice">We use cookies</div><form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_article_and_loose_pages(spark):
    article = PAGE.format('<article><h1>Title &amp; more</h1><p>First <b>bold</b><br>line<p>Second\n\tone<div class="comments"><p>nice!</div></article><aside>ad</aside>')
    loose = [PAGE.format(f"<div>Shop name</div><div>Own text {i}</div><div>All rights</div>") for i in range(3)]
    rows = [(1, "http://h.example/a/1", article)] + [(10 + i, f"http://h.example/b/{i}", p) for i, p in enumerate(loose)]
    rows += [(20, "http://solo.example/x", loose[0]), (21, None, None), (22, "", ""), (23, "http://h.example/b/9", "<p>cut <b"), (23, "http://h.example/b/9", "<p>cut <b")]
    out = pages.extract(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "host", "lines").coalesce(1))
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[1].text == "Title & more\n\nFirst bold line\n\nSecond one" and got[1].n_chars == len(got[1].text)
    assert got[10].text == "Own text 0" and got[20].text == "Shop name\n\nOwn text 0\n\nAll rights" and got[21].text == got[22].text == "" and got[23].text == "cut"
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_one_url_and_long_pages(spark):
    rows = [(i, "http://h.example/same", PAGE.format(f"<main><p>{words(3000, i)}</main>")) for i in range(30)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: words(3000, i) for i in range(30)}


def test_odd_tags_and_attributes():
    assert pages.lines("<p title=it's>one</p><p>two's</p>") == [("one", pages.LOOSE), ("two's", pages.LOOSE)]
    assert pages.lines('<a title="x > y">t</a><p class="menu>broken</p>')[-1][0] == "broken"
    kept = "<div style='overflow: hidden'><p>a</p></div><p data-id='search'>b</p><p hidden>c</p><p style='display: none'>d</p>"
    assert [k for _, k in pages.lines(kept)] == [pages.LOOSE, pages.LOOSE, pages.TEMPLATE, pages.TEMPLATE]
