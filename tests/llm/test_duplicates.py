"""Near duplicates, repeated passages and near vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from weftline.llm import graph, near_dup, suffix_dedup, vector_dedup


def components(n, links):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t ", "one two", "One TWO", "one  two\n", "x" * 500]
    for _ in range(6):
        base = [draw.choice(words) for _ in range(draw.randint(30, 150))]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    return texts + texts[7:12]


@pytest.mark.parametrize("block", [1000, 4])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "ROOM", block * 60)
    monkeypatch.setattr(near_dup, "CELLS", block // 4 + 1)
    texts = corpus()
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert all(got[k]["n_shingles"] == len(sets[k]) and got[k]["kept"] == (want[k] == k) for k in got)


def test_near_duplicates_odd_rows(spark, docs):
    rows = near_dup.near_duplicates(docs([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 7, True)]
    assert near_dup.near_duplicates(docs([])).count() == 0


def test_pairs_are_compared_with_each_text_of_a_node(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (1, [1, 2, 3, 4]), (1, [-9, -8]), (2, [1, 2, 3, 4]), (3, [-9, -8]), (4, []), (5, [1, 2, 3]), (6, [])], "node long, items array<long>")
    ordered = sets.selectExpr("node", "concat(filter(items, x -> x >= 0), filter(items, x -> x < 0)) AS items")  # unsigned order
    pairs = spark.createDataFrame([(1, b) for b in (2, 3, 4, 5)] + [(4, 6)], "a long, b long")
    assert {tuple(r) for r in near_dup._starred(pairs, ordered, 85).collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in near_dup._starred(pairs, ordered, 75).collect()} == {(1, 2), (1, 3), (1, 5)}


def test_estimate_rules_out_only_the_hopeless():
    draw = np.random.default_rng(6)
    for similarity, expected in ((0.95, True), (0.85, True), (0.3, False)):
        shared = round(400 * similarity / (1 + similarity) * 2)
        x = draw.integers(0, 2**63, 800 - shared).astype(np.uint64)
        a, b = (near_dup.registers(s)[None] for s in (x[:400], x[400 - shared :]))
        assert near_dup.may_reach(a, b, np.array([400.0]), np.array([400.0]), 0.85)[0] == expected


def brute(rows, length=100):
    seen, out = set(), {}
    for k, t in sorted((k, (t or "").encode()) for k, t in rows):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out[k] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "many"), [(64, 2000), (3, 5)])
def test_repeated_passages(spark, docs, crowd, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    draw = random.Random(7)
    some = lambda n: " ".join(f"w{draw.randrange(300)}" for _ in range(n))
    line, passage = some(12), some(60)
    rows = [(k, some(draw.randint(0, 60)) + (line if k % 3 == 0 else "") + (passage if k % 7 == 0 else "") + (passage[draw.randint(0, 80) : 210] if k % 5 == 0 else "") + some(9) + "é☃" * (k % 4)) for k in range(120)]
    rows += [(400, "a" * 1000), (401, "ab" * 400), (402, "a" * 150), (403, None), (404, ""), (405, "x" * 99), (406, rows[5][1]), (407, rows[5][1] * 3)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs(rows)).collect()}
    assert got == brute(rows)


def test_suffix_dedup_odd_rows(spark, docs):
    same = "some words that go on and on, " * 5
    rows = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.dedup(docs([(None, same), (3, "short"), (4, None)])).collect()}
    assert rows == {(None, 150): 0, (3, 5): 0, (4, 0): 0}
    assert suffix_dedup.dedup(docs([])).count() == 0


@pytest.mark.parametrize(("crowd", "many"), [(64, 2000), (3, 5)])
def test_suffix_dedup_of_repeated_rows(spark, docs, crowd, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    draw = random.Random(15)
    some = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    line, passage = some(16)[:90], some(50)
    rows = [(k, f"{some(30)} {line} {some(30)}" + (passage if k % 4 == 0 else "")) for k in range(12)]
    want = brute(rows)
    found = suffix_dedup.dedup(docs([r for r in rows for _ in range(1 + 2 * (r[0] % 3))])).collect()
    assert len(found) == 36 and sum(w[1] > 0 for w in want.values()) == 2
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in found)
    two = docs([(1, rows[1][1]), (1, rows[1][1]), (1, rows[1][1][:200] + some(9)), (2, rows[2][1])])
    lost = [r["n_removed"] for r in suffix_dedup.dedup(two).collect()]  # the text that differs is a document of its own, before or after the equal two
    assert sorted(lost) in ([0, 0, 0, 200], [0, 0, 0, 201], [0, 0, 200, 200], [0, 0, 201, 201])


def test_deep_shallow_sorts():
    draw = np.random.default_rng(8)
    rows = draw.integers(97, 99, (900, 60)).astype(np.uint8)
    rows[100:200], rows[200:300, :50], rows[:500, :40] = rows[3], rows[4, :50], 7
    order, common = suffix_dedup.deep_shallow(rows)
    held = [rows[k].tobytes() for k in order]
    assert held == sorted(held)
    assert all(common[k] == next((j for j in range(60) if held[k][j] != held[k - 1][j]), 60) for k in range(1, 900))


@pytest.mark.parametrize("block", [2000, 7])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    draw = np.random.default_rng(9)
    base = draw.normal(size=(12, 16))
    x = np.repeat(base, 9, 0) + draw.normal(size=(108, 16)) * 0.12
    x[50] = x[3]
    label = [k // 54 for k in range(108)]
    label[50] = 0
    rows = [(k, v.tolist(), a) for k, (v, a) in enumerate(zip(x, label, strict=True))]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, x[3].tolist(), None), (204, [1.0, None], 1), (205, [1.0, 2.0], 1)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for b in range(108) for a in range(b) if label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    want = components(108, links)
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows) and links
    assert [got[k]["component_id"] for k in range(108)] == want
    assert [got[k]["n_links"] for k in range(108)] == [sum(k in pair for pair in links) for k in range(108)]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(200, 206))


@pytest.mark.parametrize(("each", "count"), [(128, 100_000), (500, 100_000), (1581, 60_000)])  # codes of up to 65 thousand, 1 and 10 million rows
def test_filters_shared_at_cosine_98(each, count):
    draw = np.random.default_rng(16)
    turn, halves = vector_dedup.codes(64, each)
    missed = 0
    for _ in range(0, count, 2000):
        x, y = draw.normal(size=(2, 2000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.98 * x + (1 - 0.98**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        own = []
        for z in (x, y):
            found, n = vector_dedup.decode(z, turn, halves, 0.98)
            own.append(np.repeat(np.arange(2000), n) * each**2 + found)
        missed += 2000 - len(np.unique(np.intersect1d(*own) // each**2))
    assert missed <= count / 20_000


def test_decode_finds_all_filters_in_the_gap():
    draw = np.random.default_rng(17)
    for size in (1, 2, 3, 5, 64):
        x = draw.normal(size=(40, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn, (first, second) = vector_dedup.codes(size, 128)
        found, n = vector_dedup.decode(x, turn, [first, second], 0.98)
        cut = first.shape[1]
        sums = ((x @ turn)[:, :cut] @ first.T)[:, :, None] + ((x @ turn)[:, cut:] @ second.T)[:, None, :]
        sums = sums.reshape(40, -1)
        want = [np.flatnonzero(s >= s.max() - vector_dedup.GAP * 0.2 * (2 / size) ** 0.5 - 1e-9).tolist() for s in sums]
        assert [f.tolist() for f in np.split(found, np.cumsum(n)[:-1])] == want
        assert size < 64 or max(map(len, want)) > 16


def test_suffix_dedup_of_one_id_with_different_texts(spark, docs):
    draw = random.Random(21)
    some = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    passage = some(40)
    texts = [f"{some(20)} {passage} {some(20)}" for _ in range(4)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (3, texts[3]), (3, None), (None, texts[0])]
    got = suffix_dedup.dedup(docs(rows)).collect()
    removed = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    assert len(got) == 7 and all(n == 0 for k, _, n in removed if k in (0, 1))
    assert all(len(passage) <= n <= len(passage) + 9 for k, size, n in removed if k in (2, 3) and size)


def test_without_repeats_keeps_columns_of_any_name(spark):
    passage = "a passage that stands in both of the documents, word by word and from its first letter to the last one of them all"
    rows = [(1, f"first {passage} one", "s1", 1.5, [1], "k1", None), (2, f"second {passage} two", "s2", 2.5, [2], "k2", 7), (3, None, "s3", None, None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, spans string, wanted double, start array<int>, key string, `number` int")
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1] == rows[0] and got[2][2:] == rows[1][2:] and got[3] == rows[2] and len(got[2]["text"]) < 30
    assert suffix_dedup.without_repeats(docs).schema == docs.schema


def test_near_vectors_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, filter int"
    rows = [(1, [1.0, 0.0], 0, "x", 1), (1, [1.0, 0.0], 0, "y", 2), (None, [1.0, 0.0], 0, "z", 3), (4, [1.0, 0.001], 0, "z", 3)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["vec_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (4, 1, False)]
    assert vector_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
