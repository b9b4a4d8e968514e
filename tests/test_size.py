"""What keeps a query's work even and bounded where its tables grow."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from folium import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chunk_folds", "rendered"])
def test_a_small_table_is_the_work_of_several_tasks(spark, name):
    assert registry.QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_hints_are_read_after_they_are_dealt(spark):
    """A filter on what is read from a hint would go below the step that deals the rows, to one task."""
    plan = registry.QUERIES["hinted_work"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "regexp" not in below and "RLIKE" not in below


def test_a_heading_is_read_once_for_all_words_of_its_classes(spark):
    from folium.operators import segment

    rows = segment.lines(spark.createDataFrame([(1, "Grading\nx")], "doc_id long, text string"))
    plan = rows.select(segment.classify_heading(F.col("line")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_lists_of_grams_are_written_where_they_are_made(spark, tmp_path):
    """Neither shuffled nor sorted by Spark: a file a task that read texts, with stretches in order of their grams."""
    from folium.operators import grams

    df = spark.createDataFrame([(k, "ab" * 30 + f" text {k}") for k in range(60)], "id long, body string").repartition(3)
    grams.write_grams(df, ["id"], f"{tmp_path}/g")
    files = list((tmp_path / "g" / "lists").rglob("*.parquet"))
    assert len(files) == 3
    rows = spark.read.parquet(str(files[0])).where("wide = 3").collect()
    assert [r.gram for r in rows] == sorted(r.gram for r in rows)


def test_texts_of_several_stretches(spark, tmp_path, monkeypatch):
    from folium.operators import grams

    keys, texts = list(range(7)), ["abcab", None, "", "xabc", "b", "cabcabc", "zab"]
    monkeypatch.setattr(grams, "STRETCH", 6)
    monkeypatch.setattr(grams, "BATCH", 2)
    kind = spark.createDataFrame([], "key long, wide int, gram long, places array<int>").schema
    listed = grams._listed(grams.to_arrow_schema(kind))
    batch = grams.pa.RecordBatch.from_arrays([grams.pa.array(keys), grams.pa.array(texts)], ["key", "body"])
    rows = [r for b in listed(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    code = lambda s: int(grams.grams_of(s, len(s))[0])
    assert {r["key"]: r["places"] for r in rows if r["gram"] == code("abc")} == {0: [0], 3: [1], 5: [1, 4]}
    assert sorted(r["key"] for r in rows if r["wide"] == 2 and r["gram"] == code("ab")) == [0, 3, 5, 6]


def test_a_piece_of_a_run_is_shuffled_as_numbers(spark):
    """Pieces are most of what the repair of lost spaces shuffles: neither a hash of the run nor the word goes along."""
    from folium.operators import lexicon

    words = spark.createDataFrame([("abc", 2, 5), ("def", 2, 6)], "word string, n long, cost long")
    plan = lexicon.parted(spark.createDataFrame([("abcdefabcdef",)], "hit string"), words)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :].splitlines()[1]
    assert "Project" in dealt and "word" not in dealt


@pytest.mark.parametrize("name", ["nfc_text", "repair_text"])
def test_whole_texts_go_to_python_in_small_batches(spark, name):
    registry.QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_what_stays_out_of_python_is_in_nfc(spark):
    import unicodedata

    from folium.functions import text

    sure = [chr(c) for c in (*range(1, 0x300), *range(0x2010, 0x2028))]
    assert all(unicodedata.is_normalized("NFC", f"e{c}a") and not unicodedata.combining(c) for c in sure)
    rows = [(s,) for s in (*sure, "é", "Ω", "Å", "각", "\U0001d15e", "", None, "´e x", "c¸", "no sign")]
    got = spark.createDataFrame(rows, "t string").select("t", text.nfc(F.col("t")).alias("n"), text.compose_diacritics(F.col("t")).alias("c")).collect()
    assert all(r.n == (r.t and unicodedata.normalize("NFC", r.t)) for r in got)
    assert {r.t: r.c for r in got}["´e x"] == "é x" and {r.t: r.c for r in got}["c¸"] == "ç"


def test_rules_are_labelled_in_a_stream_of_pages(spark):
    """Pages that batches cut: the same tables as of whole pages, and no call for each page."""
    import pyarrow as pa

    from folium.operators import grids

    rows = [(d, 1, flat, at, 0.0, 20.0, r) for d in range(5) for r, (flat, at) in enumerate([(True, 0.0), (True, 20.0), (False, 0.0), (False, 20.0), (False, 90.0)])]
    batch = pa.RecordBatch.from_pylist([dict(zip(["doc_id", "page", "flat", "at", "low", "high", "rule"], r, strict=True)) for r in rows])
    schema = batch.schema.append(pa.field("grid", pa.int32()))
    for wide in (1, 3, 7, 25):
        got = [r for b in grids._labelled(schema)(iter([batch.slice(k, wide) for k in range(0, len(rows), wide)])) for r in b.to_pylist()]
        assert [r["grid"] for r in got] == [0, 0, 0, 0, 4] * 5 and [(r["doc_id"], r["rule"]) for r in got] == [(r[0], r[6]) for r in rows]


def test_postings_are_written_where_they_are_made(spark, tmp_path):
    """A file a task that read texts, in order of its blocks, before and after a merge: nothing is shuffled."""
    from folium.operators import search

    frame = lambda low: spark.createDataFrame([(k, f"the cat {k} the") for k in range(low, low + 30)], "id long, body string").repartition(3)
    search.write_index(frame(0), ["id"], f"{tmp_path}/ix")
    first = search.segments(spark, f"{tmp_path}/ix")[0].name
    files = list((tmp_path / "ix" / first / "postings").rglob("*.parquet"))
    assert len(files) == 3
    places = [r.place for r in spark.read.parquet(str(files[0])).collect()]
    assert places == sorted(places)
    search.append_index(frame(30), ["id"], f"{tmp_path}/ix")
    search.merge_index(spark, ["id"], f"{tmp_path}/ix")
    assert [r.id for r in search.search(spark, f"{tmp_path}/ix", "the CAT", ["id"], 60).collect()] == list(range(60))


def test_words_and_blocks_that_pieces_cut(monkeypatch):
    import pyarrow as pa

    from folium.operators import search

    text = "ab été k9  k9 a" * 9 + "\n" + "x" * 40
    want = ("ab t k9  k9 a" * 9).replace("t", " t ").split() + ["x" * 40]
    for piece in (1, 3, 7, 1000):
        monkeypatch.setattr(search, "PIECE", piece)
        assert [w.decode() for ws in search._words_in(text.encode()) for w in ws] == want
    terms = ["a"] * 5 + ["b", "c", "b"] + ["d"] * 4
    places = [-256, -256, -255, -250, -1, 0, 0, 0, 256, 257, 257, 511]
    batch = pa.RecordBatch.from_pydict({"place": places, "term": terms, "best": [float(k) for k in range(12)]})
    for stretch in (1, 4, 100):
        monkeypatch.setattr(search, "STRETCH", stretch)
        got = {}
        for b in search._stretches(iter([batch.slice(k, 2) for k in range(0, 12, 2)])):
            for r in b.to_pylist():
                for x in r["blocks"]:
                    n, best = got.get((r["term"], r["code"] + x["level"]), (0, 0.0))
                    got[r["term"], r["code"] + x["level"]] = (n + x["n"], max(best, x["best"]))
        want = {}
        for t, p, k in zip(terms, places, range(12), strict=True):
            n, best = want.get((t, p), (0, 0.0))
            want[t, p] = (n + 1, max(best, float(k)))
        assert got == want


def test_texts_of_distinct_keys_are_not_shuffled_into_the_store(spark, tmp_path):
    from folium.sources import store

    docs = spark.createDataFrame([(k, f"h{k}", f"text {k}") for k in range(40)], "doc_id long, file_hash string, text string").repartition(3)
    assert store._once_each(docs, "doc_id") is docs
    parse = lambda todo: {"texts": todo.select("doc_id", "text")}
    assert store.reparse(docs, f"{tmp_path}/s", parse, "v1") == 40
    # A bucket's rows lie where the tasks that had them wrote them.
    files = list(tmp_path.rglob("texts-*/bucket=*/*.parquet"))
    assert len(files) > len({f.parent for f in files})
    again = [(1, "h1", "text 1"), (1, "x1", "other 1"), (None, "a", "a"), (None, "b", "b"), (50, "h50", "text 50")]
    once = store._once_each(spark.createDataFrame(again, docs.schema), "doc_id")
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "50", "None"]


def test_hits_of_a_text_are_looked_for_once(spark):
    """What keeps texts with hits asks the told hits, not the expression a second time, below the step that makes the text."""
    from folium.operators import lexicon

    seen = []
    held, lexicon.settled = lexicon.settled, lambda df: seen.append(df) or held(df)
    try:
        docs = spark.createDataFrame([(1, "a cut-\nword"), (2, "none")], "doc_id long, text string")
        done = lexicon.rewritten(docs, "text", lexicon.CUT, lambda hits: hits.selectExpr("hit", "'cutword' AS put", "'r' AS rule"), "out").collect()
    finally:
        lexicon.settled = held
    assert {r.doc_id: r.out.text for r in done} == {1: "a cutword", 2: "none"}
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_graded_work_reads_its_lines_twice_and_its_paragraphs_once(spark):
    """Once as lines and once as paragraphs; a paragraph's list of shares is made once, and none of it is joined or sent back to the documents."""
    from folium.operators import graded
    from folium.plans import document_queries

    rows = document_queries._zoned(document_queries.written(spark, SF, document_queries.GRADED), "requirements")
    plan = graded.candidates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("ArrowEvalPython [in_prose") == 1 and "Join" not in plan


def test_only_documents_with_something_twice_are_merged(spark, monkeypatch):
    """Merging is row by row in Python, so it is for documents whose rows could be the same work."""
    from folium.operators import graded

    seen, merge = [], graded.merge_same

    def watched(items, also=None):
        seen.append({r.doc_id for r in items.select("doc_id").distinct().collect()})
        return merge(items, also)

    monkeypatch.setattr(graded, "merge_same", watched)
    texts = [
        (1, "Quizzes            40%\nEssay One            60%"), (2, "Policy Memo 50%\n\nThe Policy Memo (50%): due 9/12."), (3, "Midterm Exam 30%\nFinal Exam 30%\nTests 40%"), (4, "x"),
        (5, "Lab Work (40% total): Part One (25%): x. Part Two (15%): y. Final Exam (60%): z."),
    ]
    rows = graded.G.lines(spark.createDataFrame(texts, "doc_id long, text string")).withColumns({"zone": F.lit("requirements"), "zone_id": F.lit(0), "term": F.struct(F.lit("fall").alias("name"), F.lit(2030).alias("year"))})
    got = sorted((r.doc_id, r.ordinal, r.title, r.weight, r.merged) for r in graded.extract(rows).collect())
    assert seen == [{2, 3}, {2, 3}]
    assert [g[:1] + g[2:4] for g in got] == [
        (1, "Quizzes", 40.0), (1, "Essay One", 60.0), (2, "The Policy Memo", 50.0), (3, "Midterm Exam", 30.0), (3, "Final Exam", 30.0), (3, "Tests", 40.0), (5, "Lab Work", 40.0), (5, "Final Exam", 60.0),
    ]


def test_stems_stand_in_what_their_expressions_fit(spark):
    from folium.operators import graded

    texts = ["MID-TERM Midterm", "a quiz", "Weekly Assessment", "assessment 3", "Checklist", "Pre Registration", "prospectus", "To present", "Case studies", "sign up", "Signup", "Memo", "REPORTS", "none", "contest", "Assignment"]
    fits = F.coalesce(graded.G.first_pattern(F.col("x"), graded.KINDS), F.lit("other"))
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", graded.classify_kind(F.col("x"), F.lit(None).cast("string")).alias("k"), fits.alias("f")).collect()
    assert all(r.k == r.f for r in rows) and len({r.k for r in rows}) == len(graded.KINDS) + 1


def test_places_of_markers_in_paragraphs(spark):
    from folium.operators import segment

    text = "  \n\n• One\nTwo\n• Three\n\n \nFour\n- Five"
    rows = segment.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.idx for r in rows.where("starts_block").collect()] == [2]
    got = segment.paragraphs(rows.withColumns({"zone": F.lit("z"), "zone_id": F.lit(0)})).orderBy("idx").collect()
    assert [(r.idx, r.text, [tuple(m) for m in r.markers]) for r in got] == [(2, "One Two Three", [(0, "•"), (8, "•")]), (7, "Four Five", [(5, "-")])]


def test_a_text_of_many_entries_is_read_once(spark, monkeypatch):
    """Layouts give the same texts, and documents share some; what is no reading in one place may be none in another."""
    from folium.operators import schedule

    seen, read = [], schedule.read_texts

    def watched(texts):
        seen.extend(r.raw for r in texts.collect())
        assert texts.select(F.spark_partition_id()).rdd.getNumPartitions() > 1
        return read(texts)

    monkeypatch.setattr(schedule, "read_texts", watched)
    book, two = "Doe, Jane. 2005. The long book. Boston: Big Press.", "• NRC Ch 3 & 4 • Roe, R. 2006. The other book. Boston: Big Press."
    given = [(d, 1, e, t, v, a) for d in range(6) for e, (t, v, a) in enumerate([(book, None, False), (two, "optional", False), ("Human Security", None, False), ("Human Security", None, True), (book, "goals", False), ("TBD", None, False)])]
    got = schedule.readings(spark.createDataFrame(given, "doc_id long, session int, entry int, raw string, level string, appended boolean")).collect()
    assert sorted(seen) == sorted({book, two, "Human Security", "TBD"})
    want = [(0, book, "required"), (1, "NRC Ch 3 & 4", "recommended"), (2, "Roe, R. 2006. The other book. Boston: Big Press.", "recommended"), (3, "Human Security", "required")]
    assert sorted((r.doc_id, r.ordinal, r.raw, r.requirement_level) for r in got) == [(d, *w) for d in range(6) for w in want]


def test_lines_of_a_zone_search_are_read_once(spark):
    """The zone that a line names is asked once, and week numbers are counted with the rest: the starts join nothing."""
    from folium.operators import segment

    rows = segment.lines(spark.createDataFrame([(1, "Grading\nWeek 1 a\nWeek 2 b")], "doc_id long, text string"))
    assert "Join" not in segment.schedule_starts(rows)._jdf.queryExecution().optimizedPlan().toString()
    plan = segment.zones(segment.named(rows).localCheckpoint())._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan


def test_runs_of_weeks_and_dated_lines_ahead(spark):
    import random

    from folium.operators import segment

    rng, docs, want = random.Random(5), [], {}
    for d in range(60):
        weeks = [rng.choice([None, None, 1, 2, 3]) for _ in range(rng.randint(0, 9))]
        docs.append((d, "\n".join("words" if v is None else f"Week {v} x" for v in weeks)))
        runs, last = [], None
        for i, v in enumerate(weeks):
            if v is not None:
                if last is None or v < last:
                    runs.append([i])
                else:
                    runs[-1].append(i)
                last = v
        best = max(runs, key=len, default=[])
        want[d] = (best if len(best) >= 2 else runs[0])[0] if runs else None
    # A heading counts with two dated lines among the sixty after it.
    for d, gap in ((100, 57), (101, 58), (102, 59)):
        docs.append((d, "Course Schedule\n" + "words\n" * gap + "on Jan 5 x\non Jan 6 y"))
        want[d] = 0 if gap <= 58 else None
    rows = segment.lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.start for r in segment.schedule_starts(rows).collect()} == want


def test_a_documents_head_is_gathered_once(spark):
    """Labels, code and title are read from one row a document; only its term is joined."""
    from folium.operators import frontmatter, segment

    text = "POLS 4101: Theory of Rule\nInstructor:\n Dr. Ida   Berg \n\nInstructor: Prof. Second\nRoom: B 12 Office hours: never\nE-mail: a@b.org\nMeets:\n\nMon 9\nWebsite: see https://x.org/a."
    lines = segment.lines(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"))
    terms = spark.createDataFrame([(1, ("fall", 2030))], "doc_id long, term struct<name:string,year:int>")
    meta = frontmatter.course_meta(lines, terms)
    plan = meta._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1 and "Window" not in plan
    a, b = meta.orderBy("doc_id").collect()
    assert (a.code, a.title, a.instructor, a.meeting_time, a.location, a.site_url, a.email) == ("POLS 4101", "Theory of Rule", "Dr. Ida Berg", "Mon 9", "B 12", "https://x.org/a", "a@b.org")
    assert (b.code, b.title, b.instructor, b.site_url, b.confidence) == (None, None, None, None, 0.0)
    told = {r.label: r.value for r in frontmatter.labelled_values(lines).collect()}
    assert told == {"instructor": "Dr. Ida Berg", "location": "B 12", "email": "a@b.org", "time": "Mon 9", "site": "see https://x.org/a."}
