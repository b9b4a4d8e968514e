"""N-gram join, decontamination and vector near-duplicates against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest

from folium.llm import decontaminate, ngram_join, vector_dedup

DOCS = "doc_id long, text string, node string, tile string, n string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def sets(t):
    w = words(t)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    ids = sorted(s)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {i: (len(s[i]), r) for i, r in roots(ids, pairs).items()}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 150, 400]))]
        rows.append(" ".join(text))
        for _ in range(rng.randint(0, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], "extra"]])
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy).upper() if base % 3 else " ".join(copy))
    return [(i, t) for i, t in enumerate(rows)]


def test_join_is_brute_force(spark):
    rows = corpus(1, 60) + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute(rows)


def test_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        copy[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute(rows)


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(empty).count() == 0
    text = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, "x" * 200_000)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.similar_groups(docs).collect())
    assert got == [(-1, 7), (3, 3), (7, 7), (7, 7)]


def test_segments_leave_one_alike():
    # Where it is said to be sure: more segments than may be hit.
    for k in range(60):
        m, hits, sure = ngram_join.segments(k)
        assert not sure or m > hits


def test_bitmaps_never_bound_below():
    rng = np.random.default_rng(0)
    for n in (10, 100, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(n * 0.92)], rng.integers(0, 2**63, n // 20 + 1, dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        a, _ = ngram_join.bounded_pairs(np.array([len(x), len(y)]), [ngram_join.bitmap(x), ngram_join.bitmap(y)], np.array([2, 2]))
        assert len(a) == 1 or not ngram_join.linked(shared, len(x), len(y))


def test_contained_items(spark):
    rng = random.Random(5)
    item = [f"b{k}" for k in range(40)]
    filler = [f"f{k}" for k in range(5000)]
    rng.shuffle(filler)
    near = list(item)
    near[20] = "changed"
    far = [w if k % 3 else "changed" for k, w in enumerate(item)]
    docs = [(1, " ".join(filler[:2000] + item + filler[2000:])), (2, " ".join(filler[:50] + near)), (3, " ".join(far)), (4, None), (5, ""), (6, "b0 b1"), (1, " ".join(item))]
    items = [(10, " ".join(item).upper()), (11, None), (12, " "), (13, "b0 B1"), (14, " ".join(item))]
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for d, t in docs:
        for i, q in items:
            a, b = sets(t), sets(q)
            if b and 5 * len(a & b) >= 4 * len(b):
                want.append((d, i, len(b), len(a & b)))
    assert got == sorted(want) and len(got) > 5


def test_contained_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    docs = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(30)))], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"a{j}" for j in range(k, k + 12))) for k in range(6)], "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.contained(docs, items).collect()) == [*range(6)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs, none).count() == 0
    assert decontaminate.clean(docs, none).collect() == docs.collect()


@pytest.mark.parametrize("block", [10, 10**6])
def test_clean_judges_rows_by_their_own_text(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    item, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"c{k}" for k in range(40))
    rows = [(None, f"x {item} y", 1), (None, other, 2), (5, item, 3), (5, other, 4), (6, None, 5), (6, "", 6), (7, item, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    items = spark.createDataFrame([(1, item), (2, " ".join(item.split()[3:])), (3, None)], "item_id long, text string")
    assert sorted(r.row for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.contained(docs, items).count() == 6


def test_keep_one_tells_rows_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (None, b + " more"), (None, "c d e f g h"), (3, "c d e f g h"), (4, None), (4, None), (9, "z z"), (9, "z z")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, root string, row_key long")
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    key = lambda r: (r[0] or -1, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, a), (1, b), (3, "c d e f g h"), (4, None), (4, None), (9, "z z")], key=key)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0
    ids = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.similar_groups(docs).collect()}
    assert ids[(2, 37)] == 1 and ids[(None, 37)] == 1


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            v = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((i, [float(x) for x in (v + rng.normal(scale=0.09 * np.linalg.norm(v) / 5, size=24)).astype(np.float32)], label))
                i += 1
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [0.0] * 24, 0), (904, [float("nan")] * 24, 0), (905, rows[0][1], None), (906, [1.0, None], 0), (907, [], 0), (908, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    ok = [(i, np.array(e, float), k) for i, e, k in rows if e and k is not None and None not in e and np.isfinite(e).all() and any(e)]
    links = [(a, b) for a, x, k in ok for b, y, m in ok if a < b and k == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    r = roots([i for i, _, _ in rows], links)
    want = {i: (sum(i in p for p in links), r[i], r[i] == i) for i, _, _ in rows}
    assert got == want
    assert len(links) > 30


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_duplicates(df).count() == 0


@pytest.mark.parametrize("n", [100, 10**6, 10**12])
def test_plan_keeps_its_promises(n):
    k, tables = vector_dedup.plan(n)
    near, far = vector_dedup.same_cell((2 - 2 * 0.98) ** 0.5), vector_dedup.same_cell(2**0.5)
    assert (1 - near**k) ** tables <= vector_dedup.MISS * 1.0001
    assert n * tables * far**k <= vector_dedup.MEETINGS * 1.0001


def test_components_of_chains(spark):
    from folium.llm.graph import components

    edges = [(k, k + 1) for k in range(0, 300)] + [(1000 + k, 1000) for k in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{1000 + k: 1000 for k in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
