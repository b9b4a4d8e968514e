"""Ranked search, substring search and the matching of documents against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folium.functions.text import MATCH_STOP
from folium.operators import grams, matching
from folium.operators import search as S


def bm25(rows, query, limit):
    words = S.terms_of(query)
    split = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in rows}
    n, mean = len(rows), sum(map(len, split.values())) / len(rows)
    df = {w: sum(w in ws for ws in split.values()) for w in words}
    out = []
    for k, ws in split.items():
        if words and all(w in ws for w in words):
            score = None
            for w in words:
                tf = ws.count(w)
                part = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)))
                score = part if score is None else score + part
            out.append((-round(score, 6), k))
    return [(k, -s) for s, k in sorted(out)[:limit]]


QUERIES = ["of THE the", "c++ the", "the", "a the of", "rare1 the", "rare1 Rare2", "the nothing", "?!"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(4000):
        p = rng.random() ** 2
        ws = [rng.choice(["the", "of", "a"]) if rng.random() < 0.05 + 0.4 * p else f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 20, 60, 200]))]
        if k % 97 == 0:
            ws += ["mid", "C++"]
        if k in (17, 2500, 3999):
            ws += ["rare1"] + (["Rare2"] if k == 2500 else [])
        rows.append((k, " ".join(ws)))
    rows[5] = (5, "")
    return rows


def test_search_equals_the_full_scan(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, "doc_id long, body string").repartition(3)
    S.write_index(docs, ["doc_id"], f"{tmp_path}/ix")
    for q in QUERIES:
        found, read = S.search_read(spark, f"{tmp_path}/ix", q, ["doc_id"], 10)
        assert [(r.doc_id, round(r.score, 6)) for r in found.collect()] == bm25(corpus, q, 10), q
        if q in ("the", "of THE the"):
            assert read.blocks + read.looked_up < read.total / 10
    for q in QUERIES[:2]:
        assert [(r.doc_id, round(r.score, 6)) for r in S.search_once(docs, q, ["doc_id"], 10, marked=False).collect()] == bm25(corpus, q, 10)


def test_appended_rows_are_found_before_and_after_a_merge(spark, corpus, tmp_path):
    path = f"{tmp_path}/ix"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, body string")
    long = [(9000 + k, "the " * (k + 1) + "fresh of " + "pad " * 700) for k in range(6)]  # so long that the mean length grows
    S.write_index(frame(corpus[:3000]), ["doc_id"], path)
    S.append_index(frame(corpus[3000:]), ["doc_id"], path)
    S.append_index(frame(long), ["doc_id"], path)
    told = lambda q: [(r.doc_id, round(r.score, 6)) for r in S.search(spark, path, q, ["doc_id"], 10).collect()]
    for _ in range(2):
        for q in ("of the", "fresh the"):
            assert told(q) == bm25(corpus + long, q, 10), q
        S.merge_index(spark, ["doc_id"], path)
    assert len(S.segments(spark, path)) == 1


def test_searching_nothing(spark, tmp_path):
    S.write_index(spark.createDataFrame([(1, "")], "doc_id long, body string"), ["doc_id"], f"{tmp_path}/ix")
    assert S.search(spark, f"{tmp_path}/ix", "the", ["doc_id"]).count() == 0
    S.append_index(spark.createDataFrame([(2, "The cat")], "doc_id long, body string"), ["doc_id"], f"{tmp_path}/ix")
    assert [r.doc_id for r in S.search(spark, f"{tmp_path}/ix", "the", ["doc_id"]).collect()] == [2]


def test_substrings_of_any_kind(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a", "b", "A", " ", "é", "😀", "ß", "\n"]) for _ in range(rng.choice([0, 1, 2, 3, 9, 60])))) for k in range(300)] + [(300, None), (301, "aaaaaaa")]
    df = spark.createDataFrame(rows, "id long, body string")
    grams.write_grams(df, ["id"], f"{tmp_path}/g")
    for needle in ["AB", "aab", "aaaaaaa", "é😀", "b é", "a", "zzz", "ababa", "😀😀😀"]:
        got = {r.id: r.place for r in grams.find(spark, f"{tmp_path}/g", needle, ["id"]).collect()}
        low = needle.lower()
        want = {k: (t.lower().find(low) if len(low) > 2 else None) for k, t in rows if t and len(low) > 1 and low in t.lower()}
        assert got == want, needle


def match(head, name, works):
    """The rule as it is stated, one document at a time."""
    probe = f"{name}\n{head}".strip()
    bag = lambda x: {w for w in re.findall("[a-z0-9]+", (x or "").lower()) if len(w) > 2 and w not in MATCH_STOP}
    for work, _, _, _, doi in works:
        if doi and doi.lower() in probe.lower():
            return (work, 1.0)
    best, top = None, 0.0
    for work, title, names, year, _ in works:
        score, words = 0.0, bag(title)
        if words:
            score += 0.6 * len(words & bag(probe)) / len(words)
        if any(s.lower() in bag(probe) for s in names):
            score += 0.25
        if year and str(year) in re.findall(r"\b(1[89]\d{2}|20\d{2})\b", probe):
            score += 0.15
        if score > top:
            best, top = work, score
    return None if top < 0.45 else (best, round(min(top, 1.0), 3))


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"word{k}" for k in range(12)] + ["the", "of"]
    people = ["Smith", "Jones", "O'Neil", "Li"]
    works = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))), rng.sample(people, rng.randint(0, 2)), rng.choice([1999, 2001, None]), rng.choice([None, f"10.1234/a{k}"])) for k in range(60)]
    heads = []
    for k in range(300):
        head = " ".join(rng.sample(vocabulary, rng.randint(0, 6)) + rng.sample(["Smith", "jones", "1999", "2001", "1850"], rng.randint(0, 3)))
        if k % 12 == 0:
            head += f" (DOI:10.1234/A{rng.randrange(90)})xyz"
        heads.append((k, head, rng.choice(["scan.pdf", f"word3_word4-{k}.PDF"])))
    docs = spark.createDataFrame(heads, "doc_id long, head string, file string")
    table = spark.createDataFrame(works, "work_id long, title string, surnames array<string>, year int, doi string")
    got = {r.doc_id: (r.work_id, r.score) for r in matching.match_documents(docs, table, filename="file").collect()}
    clean = lambda f: re.sub(r"[_\-()]+", " ", re.sub(r"(?i)\.pdf$", "", f))
    # A work without a title is found by its DOI alone; here all have one.
    want = {k: m for k, head, f in heads if (m := match(head, clean(f), works))}
    assert got == want
    assert matching.match_documents(docs.where("doc_id < 0"), table).count() == 0
    assert matching.match_documents(docs, table.where("work_id < 0")).count() == 0


def test_doi_inside_of_other_signs(spark):
    docs = spark.createDataFrame([(1, "see 10.1234/abc)xyz"), (2, "no 10. here"), (3, "x10.1234/ABCD")], "doc_id long, head string")
    works = spark.createDataFrame([(7, None, None, None, "10.1234/abcd"), (8, None, None, None, "10.1234/abc")], "work_id long, title string, surnames array<string>, year int, doi string")
    assert {r.doc_id: r.work_id for r in matching.match_documents(docs, works).collect()} == {1: 8, 3: 7}
