import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from barloom.llm import lines, simhash, substrings
from barloom.llm.components import connected_components

from .helpers import awkward, documents, empty, with_clashes, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, most, letters="abé "):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        i = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.4:
            out.insert(i, rng.choice(letters))
        elif out and kind < 0.7:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def test_banded_distance_and_filing_lose_no_pair():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = edited(rng, a, 4)
        for most in range(4):
            assert lines.edit_distance_within(a, b, most) == (distance(a, b) <= most)
    for _ in range(3000):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 60)))
        b = edited(rng, a, 2)
        if 0 < distance(a, b) <= lines.edits_allowed(min(len(a), len(b))):
            assert set(lines.file_line(a)) & set(lines.file_line(b))
            assert (lines.signature(a) ^ lines.signature(b)).bit_count() <= 4 * lines.MAX_EDITS


def expected_lines(docs):
    first, seen = {}, []
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, k))
                seen.append((i, k, line))
    near = {b for b in first for a in first if first[a] < first[b] and abs(len(a) - len(b)) <= 2 and distance(a, b) <= lines.edits_allowed(min(len(a), len(b)))}
    return {(i, k) for i, k, line in seen if first[line] != (i, k) or line in near}


def test_finer_keys_lose_no_pair():
    rng = random.Random(13)
    for _ in range(2000):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 60)))
        b = edited(rng, a, 2)
        if 0 < distance(a, b) <= lines.edits_allowed(min(len(a), len(b))):
            both = set(lines.file_line(a)) & set(lines.file_line(b))
            assert any(set(lines.refile_line(k, a)) & set(lines.refile_line(k, b)) for k in both)


def test_streamed_groups_of_lines_hold_no_more_than_the_limit():
    keys = np.repeat(np.arange(6), [3, 40, 1, 25, 12, 2])
    columns = [keys, np.arange(len(keys)), np.arange(len(keys)) * 77]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in columns], ["key", "id", "sign"]) for i in range(0, len(keys), 7)]
    met = pa.Table.from_batches(list(lines._meet(iter(batches), 10))).to_pylist()
    assert [(r["key"], r["a"]) for r in met if r["kind"] == lines.LARGE] == [(k, i) for i, k in enumerate(keys.tolist()) if k in (1, 3, 4)]


@pytest.mark.parametrize(("crowd", "most"), [(5, 4096), (120, 4096), (120, 20), (60, 2)])
def test_lines_against_brute_force(spark, crowd, most):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 19, 25, 41, 70]))) for _ in range(12)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base[:2] if crowd > 50 else base), 2) for _ in range(3))) for i in range(crowd)]
    got = {(r.doc_id, r.line) for r in lines.repeated_lines(documents(spark, [(i, t, "s") for i, t in docs]), most=most).collect()}
    assert got == expected_lines(docs)


def test_lines_of_awkward_rows(spark):
    df = with_clashes(awkward(spark), "n_lines", "n_dropped", "_key", "line")
    out = lines.drop_repeated(df, counts=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == 9 and rows[1].text is None and rows[2].text == "" and rows[3].text == " \n\t " and rows[3].n_lines == 2
    assert rows[5].n_dropped == 0 and rows[4].n_lines == 1 and rows[None].text == "no key here at all"
    assert lines.drop_repeated(empty(spark)).count() == 0
    twice = documents(spark, [(1, "same line of text", "s"), (2, "other\nsame line of text", "s")])
    assert {r.doc_id: r.text for r in lines.drop_repeated(twice).collect()} == {1: "same line of text", 2: "other"}


def brute_prints(docs):
    from xxhash import xxh64_intdigest

    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxh64_intdigest(s, 42) for s in sh]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out


def brute_components(prints, most):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= most and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize(("distance_", "segments"), [(3, 2), (5, 3), (0, 1)])
def test_multi_index_hashing_finds_every_link(distance_, segments):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(40)})
    fps = np.array(prints, np.uint64)
    keys, rows = simhash.file_keys(fps, distance_, segments)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.links(keys[order], fps[rows][order], distance_)
    assert (np.bitwise_count(a ^ b) <= distance_).all()
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    want = brute_components({p: p for p in prints}, distance_)
    assert {p: find(p) for p in prints} == want


@pytest.mark.parametrize(("distance_", "segments", "most"), [(3, 2, 8), (5, 3, 8), (5, 3, 100), (2, 1, 4)])
def test_large_groups_are_split_without_losing_links(spark, distance_, segments, most):
    rng = random.Random(12)
    low = 64 // segments if segments > 1 else 0
    prints = set()
    for centre in [rng.getrandbits(64) for _ in range(3)]:  # each in one bucket of the lowest segment
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(low, 64), rng.randint(0, 6))) for _ in range(60)}
    rows = [(p - 2**64 if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(rows, "fp long").repartition(3)
    links = [(r.a, r.b) for r in simhash.link_table(table, distance_, segments, most).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= distance_ for a, b in links)
    got = {p: p for (p,) in rows}
    for _ in range(len(got)):
        before = dict(got)
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if got == before:
            break
    want = brute_components({p & (2**64 - 1): p & (2**64 - 1) for (p,) in rows}, distance_)
    groups = lambda label: {frozenset(k for k in label if label[k] == v) for v in set(label.values())}
    assert {frozenset(k & (2**64 - 1) for k in g) for g in groups(got)} == groups(want)


def test_streamed_groups_hold_no_more_than_the_limit():
    keys = np.repeat(np.arange(5), [3, 40, 1, 25, 2])
    fps = np.arange(len(keys)) * 1024
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(fps[i : i + 7])], ["key", "fp"]) for i in range(0, len(keys), 7)]
    late = pa.Table.from_batches(list(simhash._meet(iter(batches), 3, 10))).filter(pc.is_valid(pc.field("key")))
    assert late["key"].to_pylist() == [1] * 40 + [3] * 25 and late["a"].to_pylist() == fps[np.isin(keys, [1, 3])].tolist()


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(60):
        w = words(200, 1000 * (i % 20)).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "CHANGED"
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "a b"), (103, "A\tB")]
    prints = brute_prints(docs)
    rows = simhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in docs])).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == brute_components(prints, 3)


def test_near_duplicates_of_awkward_rows(spark):
    rows = simhash.near_duplicates(with_clashes(awkward(spark), "fp", "component_id", "_least")).collect()
    assert len(rows) == 9 and {r.doc_id: r.component_id for r in rows}[3] == 1 and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(with_clashes(awkward(spark), "fp", "_id"))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((i is None, i) for i in (1, 4, 5, 6, 7, None))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} and len(out) == 71


def test_gear_hash_and_cuts():
    data = bytes(random.Random(10).choices(range(97, 105), k=5000))
    h, want = 0, []
    for byte in data:
        h = (2 * h + int(substrings._GEAR[byte])) & 0xFFFF
        want.append(h)
    assert substrings.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want
    ends = substrings.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= substrings.MOST_BYTES and sizes[:-1].min() >= substrings.LEAST_BYTES
    moved = set(len(data) - e for e in ends) & set(len(data) + 9 - e for e in substrings.cuts(b"insertion" + data))
    assert len(moved) > 0.9 * len(ends)


def test_words_are_counted_by_their_beginnings():
    for text in ("", "one", "  two  words ", "tabs\t\tand\r\nlines\x0b\x0cend"):
        before = substrings.words_before(text.encode())
        assert len(before) == len(text) + 1 and before[-1] == len(text.split())


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))

    passage = text(60)
    rows = [(i, text(150) + (" " + passage + " " if i % 5 == 0 else " ") + text(150), "s") for i in range(40)]
    rows += [(100, passage + " " + passage + " " + text(20), "s"), (101, " ".join(["again and again"] * 100), "s")]
    got = substrings.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i in range(0, 40, 5)} | {100}
    texts = {i: t.encode() for i, t, _ in rows}
    assert all(passage[70:-70].encode() in texts[r.doc_id][r.begin : r.end] and r.end - r.begin < 2 * len(passage) + 20 for r in got)
    assert [r.doc_id for r in got if r.kept] == [0]
    assert substrings.repeated_passages(empty(spark)).count() == 0
    odd = substrings.repeated_passages(with_clashes(awkward(spark), "row", "digest", "begin")).collect()
    assert {r.doc_id for r in odd} <= {4}


def test_runs_are_carried_on_by_whole_words():
    grow = substrings.carry_on
    assert grow(b"x one two ", b"y one two ", b"e three four", b"e three five") == (8, 7, 3)
    assert grow(b"one ", b"one ", b"e three", b"e three") == (4, 6, 2)
    assert grow(b"", b"", b"e", b"e") == (0, 0, 0)
    assert grow(b"xone ", b"one ", b"e", b"e") == (0, 0, 0) and grow(b"xone", b"yone", b"ex", b"ey") == (0, 0, -1)
    assert grow(b" ab cd", b" ab cd", b"ef gh ij", b"ef gh kl", (False, True, True, True)) == (5, 5, 3)
    assert grow(b"a ", b"b ", b" two", b" two more") == (0, 3, 1)


def shared_words(a, b, least):
    """Words of ``a`` (as places) in the longest common spans with ``b`` of ``least`` words or more."""
    x, y, out = a.split(), b.split(), set()
    row = [0] * (len(y) + 1)
    for i in range(len(x)):
        new = [0] * (len(y) + 1)
        for j in range(len(y)):
            if x[i] == y[j]:
                new[j + 1] = row[j] + 1
                if new[j + 1] >= least:
                    out.update(range(i - new[j + 1] + 1, i + 1))
        row = new
    return out


def test_passages_against_spans_compared_word_by_word(spark):
    rng = random.Random(31)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)]
    spans = [fresh(n) for n in (30, 45, 49, 50, 51, 52, 55, 60, 70, 90, 120, 200) * 3]
    docs = [fresh(rng.randint(20, 60)) for _ in range(40)]
    for span in spans:  # into two documents each
        for i in rng.sample(range(40), 2):
            docs[i] += span + fresh(rng.randint(5, 30))
    docs.append(fresh(10) + fresh(30) * 6)  # repeats within itself only
    texts = [" ".join(d) for d in docs]
    got = substrings.repeated_passages(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    found = {i: set() for i in range(len(texts))}
    for r in got:
        first = len(texts[r.doc_id][: r.begin].split())
        inside = texts[r.doc_id][r.begin : r.end].split()
        found[r.doc_id].update(range(first, first + len(inside)))
    wanted = {i: set().union(*(shared_words(texts[i], texts[j], 50) for j in range(len(texts)) if j != i)) for i in range(len(texts))}
    hit = sum(len(found[i] & wanted[i]) for i in found)
    assert hit >= 0.95 * sum(map(len, wanted.values())) and sum(map(len, wanted.values())) > 2000
    assert sum(len(found[i] - wanted[i]) for i in found) <= 0.02 * hit and not found[40]


def test_texts_without_repeated_passages(spark):
    rng = random.Random(32)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghijé", k=rng.randint(2, 9))) for _ in range(n))
    passage = fresh(120)
    rows = [(1, f"{fresh(30)} {passage} {fresh(20)}", "s"), (2, f"{fresh(25)} {passage} {fresh(40)}", "s"), (3, fresh(60), "s"), (4, None, "s"), (3, rows_text := fresh(70), "s")]
    out = substrings.drop_repeated_passages(with_clashes(documents(spark, rows), "begin", "_key", "_row")).collect()
    kept = {}
    for r in out:
        kept.setdefault(r.doc_id, []).append(r.text)
    assert kept[1] == [rows[0][1]] and kept[4] == [None] and sorted(kept[3]) == sorted([rows[2][1], rows_text])
    assert len(kept[2][0].split()) < 25 + 40 + 10 and kept[2][0].startswith(rows[1][1][:60]) and kept[2][0].endswith(rows[1][1][-60:])
    assert substrings.without("aé b", [(0, 2)]) == "é b" and substrings.without("abcd", [(1, 3), (2, 9)]) == "a"
    assert substrings.drop_repeated_passages(empty(spark)).count() == 0


def test_rows_with_one_key_and_different_texts_keep_their_own(spark):
    passage = words(120, 5000)
    clean = words(150, 9000)
    rows = [(1, f"{words(20)} {passage} {words(20, 300)}", "a"), (2, f"{words(30, 600)} {passage} {words(9, 700)}", "a"), (2, clean, "a"), (None, words(90, 20_000), "a")]
    rows.append((None, f"{words(25, 800)} {passage} {words(25, 900)}", "a"))
    kept = sorted(r.text for r in substrings.drop_repeated_passages(documents(spark, rows)).collect())
    assert len(kept) == 5 and clean in kept and words(90, 20_000) in kept
    assert sum("word5060 word5061" in t for t in kept) == 1


def test_a_chunk_in_every_document_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 10)
    passage, rng = words(80, 5000), random.Random(33)
    rows = [(i, f"{words(30, 100 * i)} {passage} {words(30, 100 * i + 50)}", "s") for i in range(40)]
    got = substrings.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(40)) and [r.doc_id for r in got if r.kept] == [0] and all(1 < r.occurrences <= 40 for r in got)


def test_a_document_of_many_lines_takes_linear_time(spark):
    import time

    many = "\n".join(f"log row {i % 90_000}" for i in range(200_000))
    began = time.time()
    out = lines.drop_repeated(documents(spark, [(1, many, "s")]), counts=True).first()
    assert (out.n_lines, out.n_dropped) == (200_000, 110_000) and out.text.count("\n") == 89_999 and time.time() - began < 120
