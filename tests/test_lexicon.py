"""The word list of a corpus and the repairs that ask it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folium.functions.text import SHORT_WORDS
from folium.operators import lexicon

WORDS = "the international relations of states in world politics a an co-operation well-known well information".split()


@pytest.fixture(scope="module")
def words(spark):
    return lexicon.word_costs(spark.createDataFrame([(" ".join(WORDS),), (" ".join(WORDS) + " once http://internationalnews.org",), (None,), ("",)], "text string"), least=2)


def test_words_and_compounds_are_counted_by_texts(words):
    held = {r.word: r.n for r in words.collect()}
    assert held == dict.fromkeys([*WORDS, "co", "operation", "known"], 2)


def test_empty_corpus_has_no_words(spark):
    none = lexicon.word_costs(spark.createDataFrame([], "text string"))
    assert none.count() == 0
    docs = spark.createDataFrame([("internationalrelations and infor-\nmation",), (None,)], "text string")
    assert [r.r.text if r.text else r.r.text for r in lexicon.spaced(docs, none, out="r").collect() if r.text] == ["internationalrelations and infor-\nmation"]
    assert {r.r.text for r in lexicon.dehyphenated(docs, none, out="r").collect()} == {"internationalrelations and information", None}


def test_lost_spaces(spark, words):
    given = {
        "internationalrelations of": "international relations of",
        "worldpoliticsinstates": "world politics in states",
        "unknownlongword here": "unknownlongword here",
        "see https://x.org/internationalrelations": "see https://x.org/internationalrelations",
        "Internationalrelations": "International relations",
        "(worldpoliticsofstates), internationalrelationsof": "(world politics of states), international relations of",
        "inworldofthe": "in world of the",
        "coworldpolitics": "coworldpolitics",
        "": "",
        None: None,
    }
    rows = [(t,) for t in given] * 2
    got = lexicon.spaced(spark.createDataFrame(rows, "text string").withColumn("hit", F.lit(1)), words, out="r").collect()
    assert len(got) == len(rows) and all(r.hit == 1 for r in got)
    assert {r.text: r.r.text for r in got} == given
    assert all(e.rule == "word_split" and e.after == given[e.before] for r in got for e in r.r.edits if e.before in given)


def test_cut_words(spark, words):
    given = {
        "the infor-\nmation": ("the information", ["hyphen_rejoin"]),
        "co-  \n operation": ("co-operation", ["hyphen_compound_kept"]),
        "Anglo-\nSaxon": ("Anglo-Saxon", ["hyphen_compound_kept"]),
        "zyg-\nomatic and Infor-\nmation": ("zygomatic and Information", ["hyphen_rejoin_unverified", "hyphen_rejoin"]),
        "a - \n b": ("a - \n b", []),
        "no hyphen": ("no hyphen", []),
        None: (None, []),
    }
    got = lexicon.dehyphenated(spark.createDataFrame([(t,) for t in given], "text string"), words, out="r").collect()
    assert {r.text: (r.r.text, [e.rule for e in r.r.edits]) for r in got} == given


def test_parting_is_the_cheapest_of_all(spark):
    """Every way to part random runs over a small alphabet, against the fold."""
    rnd = random.Random(5)
    held = {"".join(rnd.choices("ab", k=rnd.randint(3, 5))): rnd.randint(1, 9) for _ in range(14)} | {"a": 4, "ba": 1}
    table = spark.createDataFrame([(w, 1, c) for w, c in held.items()], "word string, n long, cost long")
    runs = sorted({"".join(rnd.choices("ab", k=rnd.randint(12, 16))) for _ in range(40)})

    def ways(run):
        if not run:
            yield 0, ()
        for end in range(1, len(run) + 1):
            piece = run[:end]
            if piece in held and (end > 2 or piece in SHORT_WORDS):
                for cost, rest in ways(run[end:]):
                    yield cost + held[piece], (piece, *rest)

    got = {r.hit: r.put for r in lexicon.parted(spark.createDataFrame([(r,) for r in runs], "hit string"), table).collect()}
    for run in runs:
        costs = list(itertools.islice(ways(run), 200_000))
        assert (run in got) == bool(costs)
        if costs:
            parts = got[run].split(" ")
            assert "".join(parts) == run and sum(held[p] for p in parts) == min(c for c, _ in costs)


def test_a_very_long_run(spark, words):
    run = "internationalrelations" * 4000
    got = lexicon.spaced(spark.createDataFrame([(run,)], "text string"), words, out="r").first()
    assert got.r.text == " ".join(["international relations"] * 4000)
