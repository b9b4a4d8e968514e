"""Substring deduplication, the Merkle manifest and the prefix trie against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import manifest, substrings, trie


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def brute_removal(rows, length=20):
    """(id, text) rows with different ids: words and removed places of each."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ws = (t or "").encode().split()
        gone = set()
        for k in range(len(ws) - length + 1):
            w = tuple(ws[k : k + length])
            if w in seen:
                gone.update(range(k, k + length))
            seen.add(w)
        out[i] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode())
    return out


def passages(seed, n):
    rng = random.Random(seed)
    shared = [[f"p{rng.randrange(300)}" for _ in range(rng.randint(15, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                s = rng.choice(shared)
                a = rng.randrange(len(s))
                ws += s[a : a + rng.randint(10, 100)]
            else:
                ws += [rng.choice("abcdefgh") if rng.random() < 0.7 else f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(ws)))
    rows += [(n, "z " * 70), (n + 1, "x y " * 40), (n + 2, "z " * 19), (n + 3, "É ü " * 30)]
    return rows


@pytest.mark.parametrize("shard", [2000, 2])
def test_substrings_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)  # 2: most anchors are settled window by window
    rows = passages(5, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove(docs).collect()}
    assert got == brute_removal(rows)
    for r in substrings.remove(docs).where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


def test_substrings_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(None, long, "a"), (3, None, "b"), (4, "", "c"), (5, long, "d"), (5, long, "d"), (6, " \n ", None), (7, "one two", "e"), (8, "head " + " ".join(long.split()[100:160]), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    out = substrings.remove(docs)
    assert out.columns == ["doc_id", "text", "kept_text", "n_words", "n_removed", "kept_text_", "removed_spans"]
    got = sorted((r.doc_id or 99, r.kept_text, r.n_words, r.n_removed) for r in out.collect())
    # The two rows of one id and text are one document, so neither removes the other; the one without an id comes last.
    assert got == [(3, "b", 0, 0), (4, "c", 0, 0), (5, "d", 30_000, 0), (5, "d", 30_000, 0), (6, None, 0, 0), (7, "e", 2, 0), (8, "f", 61, 60), (99, "a", 30_000, 30_000)]
    twins = spark.createDataFrame([(1, long), (1, long + " more")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.remove(twins).collect()) in ([0, 30_000], [0, 30_001])
    assert substrings.remove(docs.where("doc_id = 77")).count() == 0
    assert {r.n_removed for r in substrings.remove(docs.where("doc_id < 5")).collect()} == {0}


def test_automaton_finds_what_was_entered():
    rng = random.Random(2)
    for _ in range(200):
        held, texts = substrings.Automaton(), []
        for _ in range(rng.randint(1, 4)):
            t = [rng.randrange(3) for _ in range(rng.randint(0, 30))]
            texts.append(t)
            held.enter(t)
        probe = [rng.randrange(3) for _ in range(40)]
        grams = {tuple(t[k : k + 6]) for t in texts for k in range(len(t) - 5)}
        assert held.match(probe, 6) == [k for k in range(5, 40) if tuple(probe[k - 5 : k + 1]) in grams]


def brute_manifest(rows):
    def h(xs):
        return sha("".join(xs))

    def leaf(r):
        return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r)

    def tree(nodes):
        """Root and each node's path of (place, run)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
            for k, p in enumerate(paths):
                p.append((at[k] % 16, runs[at[k] // 16]))
                at[k] //= 16
            nodes = [h(r) for r in runs]
        return nodes[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, p in zip(own, paths, strict=True):
            path = p + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r)
            for pos, run in path:
                at = h([*run[:pos], at, *run[pos + 1 :]])
            out.append((r[0], leaf(r), subroot, root, h(x for pos, run in path for k, x in enumerate(run) if k != pos), at, at == root))
    return sorted(out, key=str)


def read_manifest(docs):
    told = manifest.manifest(docs)
    told = told.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("p"), manifest.folded(F.col("tampered"), F.col("path")).alias("f"))
    return sorted((tuple(r) + (r.f == r.root,) for r in told.collect()), key=str)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, "big", rng.choice(["en", None, ""]), k if k % 3 else None, rng.choice(["É Abc", "", None, "x" * 50, f"Text {k}"])) for k in range(4500)]
    rows += [(None, None, None, None, None), (None, None, None, None, "T"), (7, "", "en", 1, "A"), (7, "", "en", 1, "A"), (7, "", "en", 1, "B"), (9, "one", "en", 1, "Q" * 100_000)]
    rows += [(k, f"s{k}", "en", 2, "Z") for k in range(40)] + [(k, "mid", "en", 2, "Z") for k in range(257)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, r string").repartition(5)
    assert read_manifest(docs) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", 1, f"T{k}") for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert read_manifest(docs) == (brute_manifest(rows) if n else [])


@pytest.mark.parametrize("shape", ["chain", "star", "random", "deep"])
def test_rollup_sums_subtrees(shape):
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 700):
        parent = [-1] + [{"chain": k - 1, "star": 0, "random": rng.randrange(k), "deep": rng.randrange(max(0, k - 4), k)}[shape] for k in range(1, n)]
        values = [np.array([rng.randint(0, 9) for _ in range(n)]) for _ in range(2)]
        want = [v.copy() for v in values]
        for k in range(n - 1, 0, -1):
            for w in want:
                w[parent[k]] += w[k]
        assert all((a == b).all() for a, b in zip(trie.rollup(parent, values), want, strict=True))


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        seq = turns.get(c - c % 20, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    out = []
    for node, own in members.items():
        kids = [x for x in members if len(x) == len(node) + 1 and x[: len(node)] == node]
        under = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in under if x)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), sum(x not in parents for x in under), saved, sha(",".join(map(str, sorted(ends.get(node, [])))))))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("fan_out", [4096, 3])
def test_trie_matches_brute_force(spark, monkeypatch, fan_out):
    monkeypatch.setattr(trie, "FAN_OUT", fan_out)  # 3: several tiers of components
    rng = random.Random(8)
    rows = []
    for c in [*range(60), 75, 76, 95, *range(1000, 1012)]:
        for k in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "c\td e", "", None, "long " * 300])))
    rows += [(17, k, "user", f"turn {k}") for k in range(300)] + [(None, 1, "user", "lost"), (17, 5, "user", "turn 5"), (-1, 0, "user", "x")]
    convs = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, node string, k string").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.trie(convs).collect()), key=str)
    assert got == brute_trie([r for r in rows])


def test_texts_are_not_shuffled_for_the_trie(spark, monkeypatch):
    """What is dealt out holds digests; texts go along only for conversations in which turns of one number and role differ."""
    plans, settle = [], trie.settle
    monkeypatch.setattr(trie, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    rows = [(c, k, "user", f"turn {c % 7} {k}") for c in range(45) for k in range(3)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie.walked(convs).where("ends").count() == 45
    assert len(plans) == 1 and plans[0].count("Repartition") == 1 and "text" not in plans[0][: plans[0].index("MapInArrow", plans[0].index("Repartition"))]
    tied = convs.unionByName(spark.createDataFrame([(20, 1, "user", "other"), (41, 0, "user", "a"), (3, 2, "user", "turn 3 2")], convs.schema))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.trie(tied).collect()), key=str)
    assert got == brute_trie([tuple(r) for r in tied.collect()])
    assert "LeftSemi" in plans[2] and "LeftAnti" in plans[2]


def test_nodes_of_one_member_are_not_rolled_up(spark, monkeypatch):
    """They are most nodes; each is the rest of one conversation."""
    seen, runs = [], trie.runs
    monkeypatch.setattr(trie, "runs", lambda df, *a: seen.append(df.count()) or runs(df, *a))
    rows = [(c, k, "user", f"turn {c % 2 if k < 2 else c} {k}") for c in range(1, 19) for k in range(30)]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == brute_trie(rows)
    assert 0 < sum(seen) < 40 < len(got)


def test_words_of_a_batch():
    texts = ["", "a b", " \tä\n", "", "x", "\x0b\x0c y\u00a0z ", "one  two\rthree", ""]
    want = [len(t.encode().split()) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        assert trie._words(whole).tolist() == want
        assert all(trie._words(whole.slice(i, n)).tolist() == want[i : i + n] for i in range(8) for n in range(1, 9 - i))


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.trie(spark.createDataFrame([], schema)).count() == 0
    lone = [(c, 0, "user", "hi") for c in range(1, 20)]  # their group has no opening conversation
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.trie(spark.createDataFrame(lone, schema)).collect()), key=str)
    assert got == brute_trie(lone)
