"""Streams with keyed state, and the store of parses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folium.operators import serving
from folium.sources import store
from folium.streaming import flows


def drain(df, out, checkpoint):
    """One batch: with timers of the clock, batches without rows would follow for ever."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
    if not query.awaitTermination(120):
        query.stop()
        raise TimeoutError


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_inbox_takes_each_content_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    put = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(src)
    put("a", "a", "b")
    for texts in (("b", "c"), ("a", "d", "a")):
        # Each round is a restart of the query from its checkpoint; files are replayed under other names, and duplicates come late.
        flows.append_new(flows.inbox(spark, src, "text string"), out, cp).awaitTermination(120)
        put(*texts)
    flows.append_new(flows.inbox(spark, src, "text string"), out, cp).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("order", ["dwx", "xwd"])
def test_waiting_documents_match_in_every_order(spark, tmp_path, order):
    """Documents 1-3 of keys p and q, works 7 and 5 of p (in two batches), work 9 of q, in three batches of every order."""
    d, w, out, cp = (str(tmp_path / x) for x in ("d", "w", "out", "cp"))
    rows = {"d": [("p", 1), ("p", 2), ("q", 3), ("r", 4)], "w": [("p", 7), ("q", 9)], "x": [("p", 5)]}
    frame = lambda part, name: spark.createDataFrame(rows[part], f"key string, {name} long").coalesce(1)
    spark.createDataFrame([], "key string, doc_id long").write.parquet(d)
    spark.createDataFrame([], "key string, work_id long").write.parquet(w)
    for part in order:
        frame(part, "doc_id" if part == "d" else "work_id").write.mode("append").parquet(d if part == "d" else w)
        docs, works = spark.readStream.schema("key string, doc_id long").parquet(d), spark.readStream.schema("key string, work_id long").parquet(w)
        drain(flows.waiting_matches(docs, works), out, cp)
    last = spark.read.parquet(out).groupBy("doc_id").agg(F.min("work_id").alias("work_id"))
    assert {r.doc_id: r.work_id for r in last.collect()} == {1: 5, 2: 5, 3: 9}


def test_a_document_that_nothing_comes_for_is_given_up(spark, tmp_path):
    d, w, out, cp = (str(tmp_path / x) for x in ("d", "w", "out", "cp"))
    spark.createDataFrame([("p", 1)], "key string, doc_id long").write.parquet(d)
    spark.createDataFrame([], "key string, work_id long").write.parquet(w)
    for key in ("other",):
        docs, works = spark.readStream.schema("key string, doc_id long").parquet(d), spark.readStream.schema("key string, work_id long").parquet(w)
        drain(flows.waiting_matches(docs, works, patience_ms=1), out, cp)
        spark.createDataFrame([(key, 2)], "key string, work_id long").write.mode("append").parquet(w)
    docs, works = spark.readStream.schema("key string, doc_id long").parquet(d), spark.readStream.schema("key string, work_id long").parquet(w)
    drain(flows.waiting_matches(docs, works, patience_ms=1), out, cp)
    assert [(r.doc_id, r.work_id) for r in spark.read.parquet(out).collect()] == [(1, None)]


def test_deadlines_change_their_band_once(spark, tmp_path):
    """Orders as deadlines, entered on their day, moved or handed in later, in three runs of the stream, against the batch's band of each day."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id long, at timestamp, due_date date, done boolean"
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderdate < '1995-06-01'")
    due = F.when(key % 11 != 0, F.date_add(day, (key % 30).cast("int")))
    entered = orders.select(key.alias("id"), day.cast("timestamp").alias("at"), due.alias("due_date"), F.lit(False).alias("done"))
    moved = orders.where(key % 4 == 1).select(key, F.date_add(day, 5).cast("timestamp"), F.date_add(due, 9), F.lit(False))
    done = orders.where(key % 3 == 0).select(key, F.date_add(day, (key % 40).cast("int")).cast("timestamp"), due, F.lit(True))
    rows = entered.union(moved).union(done).toDF("id", "at", "due_date", "done").orderBy("at", "id", "done").collect()
    last = dt.datetime(1996, 1, 1)
    early, late = dt.datetime(1995, 2, 20), dt.datetime(1995, 4, 1)
    for part in ([r for r in rows if r.at < early], [r for r in rows if early <= r.at < late], [*(r for r in rows if r.at >= late), (-1, last, None, False), (None, last, None, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        query = flows.band_changes(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    got = {}
    for r in spark.read.parquet(out).where("id >= 0").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append((r.at.date(), r.band))
    days = spark.sql("select explode(sequence(date'1995-01-01', date'1995-12-30')) as on")
    state = spark.createDataFrame(rows, schema).withColumn("on", F.to_date("at")).groupBy("id", "on").agg(F.max_by(F.struct("due_date", "done"), F.struct("at", "done")).alias("s"))
    held = state.select("id", "on", "s.*").join(state.groupBy("id").agg(F.min("on").alias("first")), "id")
    upto = held.alias("h").join(days.alias("d"), F.expr("d.on >= h.on")).groupBy("h.id", "d.on").agg(F.max_by(F.struct("h.due_date", "h.done"), "h.on").alias("s"))
    bands = upto.select("id", "on", serving.band(F.col("s.due_date"), F.col("s.done"), F.col("on")).alias("band")).orderBy("id", "on").collect()
    want = {}
    for r in bands:
        told = want.setdefault(r.id, [])
        if not told or told[-1][1] != r.band:
            told.append((r.on, r.band))
    assert len(want) > 50 and {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]} == {}


def words(docs):
    return {"words": docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "word"))}


def test_only_what_changed_is_parsed(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("file_hash", F.sha2("text", 256))
    held = lambda name: sorted(tuple(r) for r in store.load(spark, path, name).select("doc_id", *(("word",) if name == "words" else ("parser_version",))).collect())
    rows = [(k, f"a{k} b{k}") for k in range(100)]
    assert store.load(spark, path, "words") is None
    assert store.reparse(docs(rows), path, words, "v1") == 100
    assert held("words") == sorted((k, w) for k, t in rows for w in t.split())
    before = spark.read.parquet(f"{path}/manifest").count()
    assert store.reparse(docs(rows), path, words, "v1") == 0
    assert spark.read.parquet(f"{path}/manifest").count() == before  # a second run writes nothing
    rows[3], rows[7] = (3, "c3"), (7, "c7 d7 e7")
    changed = docs([*rows, (200, "new")])

    def fails(todo):
        return {"words": todo.select("doc_id", F.raise_error(F.lit("broken")).cast("int").alias("place"), F.lit("x").alias("word"))}

    old = held("words"), held("documents")
    with pytest.raises(Exception, match="broken"):
        store.reparse(changed, path, fails, "v1")
    assert (held("words"), held("documents")) == old
    assert store.reparse(changed, path, words, "v1") == 3
    want = sorted([(k, w) for k, t in [*rows, (200, "new")] for w in t.split()])
    assert held("words") == want
    assert store.reparse(changed, path, words, "v2") == 101
    assert held("words") == want and {v for _, v in held("documents")} == {"v2"}
