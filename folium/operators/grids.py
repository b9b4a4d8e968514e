"""Grids of a page: from the rules it draws, else from where its text stands. A page's rules, lines and runs bound every group.

Runs are (doc_id, page, run_id, text, x, y, w, h, size), rules (doc_id, page, x0, y0, x1, y1), lines those of ``layout.visual_lines``.
A grid is (doc_id, page, grid, rows array<array<string>>).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folium.operators.layout import PAGE, group_runs, line_text, run_struct
from folium.sources.io import settled

# Tolerances in points and shares of a mesh.
SKEW, SHORTEST, SAME, TOUCH, REACH, OUTER = 0.7, 6, 2.5, 12, 4, 4
SPANS, MESH, LEAST_RULES = 0.6, 0.45, 3
TABLE = ["doc_id", "page", "grid"]


def merged_rules(rules: DataFrame) -> DataFrame:
    """TBL1: rules along an axis, those at one coordinate that touch merged: doc_id, page, flat (is horizontal), at, low, high, rule."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat, tall = (F.abs(dy) <= SKEW) & (dx >= SHORTEST), (F.abs(dx) <= SKEW) & (dy >= SHORTEST)
    r = rules.where(flat | tall).select(
        *PAGE, flat.alias("flat"), F.when(flat, (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2).alias("at"),
        F.when(flat, F.col("x0")).otherwise(F.col("y0")).alias("low"), F.when(flat, F.col("x1")).otherwise(F.col("y1")).alias("high"),
    )
    axis = [*PAGE, "flat"]
    w = Window.partitionBy(*axis).orderBy("at", "low", "high")
    r = r.withColumn("_line", F.sum(F.coalesce(F.col("at") - F.lag("at").over(w) > SAME, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*axis, "_line").orderBy("low", "high", "at")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_part", F.sum(F.coalesce(F.col("low") > reach + TOUCH, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    one = r.groupBy(*axis, "_line", "_part").agg(F.min("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high"))
    return one.select(*axis, "at", "low", "high", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("flat"), "at", "low")).alias("rule"))


def _tables(flat: list[bool], at: list[float], low: list[float], high: list[float]) -> list[int]:
    """Of rules of one page the number of the table that each belongs to: what crosses, or comes near it, belongs together."""
    root = list(range(len(flat)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    upright = np.array([i for i, f in enumerate(flat) if not f], np.int64)
    x, top, bottom = (np.array(c, float)[upright] for c in (at, low, high))
    for i, lies in enumerate(flat):
        if lies:
            met = (low[i] - REACH <= x) & (x <= high[i] + REACH) & (top - REACH <= at[i]) & (at[i] <= bottom + REACH)
            for j in upright[met].tolist():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(flat))]


def _labelled(schema: pa.Schema):
    """Rules in order of their pages, with their tables; a task holds the rules of a batch and of the page that goes on after it."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        page = list(zip(*(rows[c].to_pylist() for c in PAGE), strict=True))
        cells = [rows[c].to_pylist() for c in ("flat", "at", "low", "high")]
        edges = [i for i in range(len(page)) if not i or page[i] != page[i - 1]] + [len(page)]
        grid = [g for a, b in zip(edges, edges[1:], strict=False) for g in _tables(*(c[a:b] for c in cells))]
        yield from rows.append_column("grid", pa.array(grid, pa.int32())).cast(schema).to_batches()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (b for b in batches if b.num_rows):
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ends = [rows[c].to_pylist() for c in PAGE]
            cut = rows.num_rows
            while cut and all(c[cut - 1] == c[-1] for c in ends):
                cut -= 1
            if cut:
                yield from told(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from told(held)

    return go


def meshes(rules: DataFrame) -> DataFrame:
    """TBL1: merged rules of real meshes: three rules at least each way, of which horizontals run across most of the table, and almost half of all crossings drawn.

    Adds grid and, of horizontals, spans. A page's few hundred rules are labelled together.
    """
    m = merged_rules(rules)
    kind = T.StructType([*m.schema.fields, T.StructField("grid", T.IntegerType())])
    g = m.repartition(*PAGE).sortWithinPartitions(*PAGE, "rule").mapInArrow(_labelled(to_arrow_schema(kind)), kind)
    g = settled(g)
    t = Window.partitionBy(*TABLE)
    wide = F.max(F.when(F.col("flat"), F.col("high"))).over(t) - F.min(F.when(F.col("flat"), F.col("low"))).over(t)
    g = g.withColumn("spans", F.col("flat") & ((wide <= 0) | (F.col("high") - F.col("low") >= wide * SPANS)))
    h = g.where("flat").select(*TABLE, F.col("at").alias("y"), F.col("low").alias("l"), F.col("high").alias("r"))
    v = g.where("not flat").select(*TABLE, F.col("at").alias("x"), F.col("low").alias("t"), F.col("high").alias("b"))
    crossed = h.join(v, TABLE).where("l - 3 <= x and x <= r + 3 and t - 3 <= y and y <= b + 3").groupBy(*TABLE).agg(F.count("*").alias("n"))
    sums = g.groupBy(*TABLE).agg(F.count_if("flat").alias("h"), F.count_if(~F.col("flat")).alias("v"), F.count_if("spans").alias("s")).join(crossed, TABLE)
    good = sums.where((F.col("s") >= LEAST_RULES) & (F.col("v") >= LEAST_RULES) & (F.col("n") >= MESH * F.col("h") * F.col("v"))).select(*TABLE)
    return g.join(good, TABLE, "left_semi")


def boundaries(mesh: DataFrame) -> DataFrame:
    """TBL1: doc_id, page, grid, ys, xs: a table's boundaries, outer ones that were not drawn taken from how far the others reach."""
    b = mesh.groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.when(F.col("spans"), F.col("at")))).alias("ys"), F.array_sort(F.collect_list(F.when(~F.col("flat"), F.col("at")))).alias("xs"),
        F.min(F.when(F.col("spans"), F.col("low"))).alias("l"), F.max(F.when(F.col("spans"), F.col("high"))).alias("r"), F.min(F.when(~F.col("flat"), F.col("low"))).alias("t"), F.max(F.when(~F.col("flat"), F.col("high"))).alias("b"),
    )
    none = F.array().cast("array<double>")
    add = lambda low, at, high: F.concat(F.when(F.array_min(at) - low > OUTER, F.array(low)).otherwise(none), at, F.when(high - F.array_max(at) > OUTER, F.array(high)).otherwise(none))
    return b.select(*TABLE, add(F.col("t"), F.col("ys"), F.col("b")).alias("ys"), add(F.col("l"), F.col("xs"), F.col("r")).alias("xs"))


def band(value: Column, edges: Column) -> Column:
    """JOIN15: the number of the band between sorted edges that a value lies in, half a point of slack outside; null beyond."""
    below = F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e: e < value))
    return F.when(value.between(F.array_min(edges) - 0.5, F.array_max(edges) + 0.5), F.least(below, F.size(edges) - 2))


def looks_like_a_table(cells: Column) -> Column:
    """TBL3: of an array of filled cells: four at least, short ones (the upper median 90 characters), none a whole page."""
    n = F.array_sort(F.transform(cells, F.length))
    return (F.size(cells) >= 4) & (F.get(n, F.floor(F.size(n) / 2).cast("int")) <= 90) & (F.array_max(n) <= 700)


def _assembled(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells (key, row, col, wide, text) as grids."""
    rows = cells.groupBy(*key, "row").agg(F.collect_list(F.struct("col", "text")).alias("c"), F.first("wide").alias("wide"))
    at = lambda i: F.coalesce(F.get(F.filter("c", lambda v: v["col"] == i), 0)["text"], F.lit(""))
    rows = rows.select(*key, "row", F.transform(F.sequence(F.lit(0), F.col("wide") - 1), at).alias("r"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda v: v["r"]).alias("rows"))


def filled(grid: Column) -> Column:
    return F.filter(F.flatten(grid), lambda c: F.trim(c) != "")


def ruled_grids(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """TBL1-TBL3: the grids that rules draw, filled with the runs whose centre lies in a cell.

    Columns without text go (a border drawn twice), and so do leading rows of one cell that runs across its border or of none (a title bar).
    """
    b = boundaries(meshes(rules))
    r = runs.where(F.trim("text") != "").join(b, PAGE)
    r = r.withColumn("row", band(F.col("y") + F.col("h") / 2, F.col("ys"))).withColumn("col", band(F.col("x") + F.least("w", F.lit(4.0)) / 2, F.col("xs"))).where("row is not null and col is not null")
    r = r.withColumn("over", F.col("x") + F.col("w") > F.get("xs", F.col("col") + 1) + OUTER)
    cells = r.groupBy(*TABLE, "row", "col").agg(F.collect_list(run_struct()).alias("runs"), F.max("over").alias("over"))
    t = Window.partitionBy(*TABLE)
    cells = cells.withColumn("place", F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("col")) - 1).withColumn("wide", F.size(F.collect_set("col").over(t)))
    n = F.count("*").over(Window.partitionBy(*TABLE, "row"))
    bar = (n == 1) & (F.col("over") | (F.col("wide") >= 3))
    cells = cells.withColumn("first", F.min(F.when(~bar, F.col("row"))).over(t)).where("wide >= 2 and row >= first")
    text = F.array_join(F.transform(F.array_sort(F.transform(group_runs(F.col("runs")), lambda v: F.struct(v["y0"].alias("y"), F.array_min(F.transform(v["runs"], lambda x: x["x"])).alias("x"), F.trim(line_text(v["runs"])).alias("t")))), lambda v: v["t"]), "\n")
    # Rows without text between others stay; only the last ones go.
    last = cells.groupBy(*TABLE).agg(F.min("row").alias("a"), F.max("row").alias("z"), F.first("wide").alias("wide"))
    every = last.select(*TABLE, "wide", F.explode(F.sequence("a", "z")).alias("row"))
    told = cells.select(*TABLE, "row", F.col("place").alias("col"), F.trim(text).alias("text"))
    grids = _assembled(every.join(told, [*TABLE, "row"], "left"), TABLE)
    return grids.where((F.size("rows") >= 2) & looks_like_a_table(filled(F.col("rows"))))


# Words of a header that name a time and a content column; a week's mark in a table's first column.
TIME_HEADER = r"(?i)^(?:week|wk|date|dates|day|days|meetings?|class(?:es)?|session)\b"
CONTENT_HEADER = r"(?i)^(?:topic|theme|subject|unit|readings?|assignments?|homework|materials?|due|deliverables?|notes?|other\s*due|material\s*due)\b"
WEEK_MARK = r"(?i)^\s*(?:week|session|module|unit)\s*#?\s*\d{1,2}\b"
GAP, MEMBERS, SPAN, MOST_EDGES = 14, 3, 120, 6
GATE_RUNS, GATE_SPAN, GATE_LINES, GATE_EDGES = 12, 160, 20, (3, 7)
SLACK, APART, TIGHT = 3.0, 3.5, 1.7


def clusters(points: DataFrame, x: str, gap: float = GAP, least: int = MEMBERS) -> DataFrame:
    """One-dimensional clusters by page: doc_id, page, edges (the sorted medians of clusters with enough members)."""
    w = Window.partitionBy(*PAGE).orderBy(x)
    c = points.withColumn("_c", F.sum(F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = c.groupBy(*PAGE, "_c").agg(F.percentile(x, 0.5).alias("edge"), F.count("*").alias("n")).where(F.col("n") >= least)
    return e.groupBy(*PAGE).agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def column_edges(lines: DataFrame) -> DataFrame:
    """TBL4: doc_id, page, edges: two to six columns that lines start in, spread over the page."""
    e = clusters(lines, "x0")
    return e.where((F.size("edges") >= 2) & (F.array_max("edges") - F.array_min("edges") >= SPAN)).select(*PAGE, F.slice("edges", 1, MOST_EDGES).alias("edges"))


def column_of(x: Column, edges: Column) -> Column:
    """The column whose band, bounded midway between edges, holds a start."""
    mids = F.transform(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e, i: (e + F.get(edges, i)) / 2)
    return F.size(F.filter(mids, lambda m: m <= x))


def fragments(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """What each line has in each column: doc_id, page, line, y0, high, col, text, edges."""
    r = lines.join(edges, PAGE).select(*PAGE, "line", "y0", (F.col("y1") - F.col("y0")).alias("high"), "edges", F.explode("runs").alias("r"))
    r = r.withColumn("col", column_of(F.col("r.x"), F.col("edges")))
    f = r.groupBy(*PAGE, "line", "col").agg(F.trim(line_text(F.collect_list("r"))).alias("text"), F.first("y0").alias("y0"), F.first("high").alias("high"), F.first("edges").alias("edges"))
    return settled(f.where("text <> ''"))


def _filled(frags: DataFrame, tops: DataFrame, least_rows: int, least_cells: int) -> DataFrame:
    """JOIN16: fragments in the last row that begins at or above them, give or take; what stands above the first row is none of it."""
    both = frags.select(*PAGE, F.col("y0").alias("t"), F.lit(1).alias("side"), F.struct("y0", "col", "text").alias("f"), F.size("edges").alias("wide"), F.lit(None).cast("double").alias("top"))
    both = both.unionByName(tops.select(*PAGE, (F.col("top") - SLACK).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("struct<y0:double,col:int,text:string>").alias("f"), F.lit(None).cast("int").alias("wide"), "top"))
    w = Window.partitionBy(*PAGE).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("row", F.last("top", ignorenulls=True).over(w)).where("side = 1 and row is not null").select(*PAGE, "row", "wide", "f.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda v: v["text"]), "\n")
    cells = placed.groupBy(*PAGE, "row", "col").agg(text.alias("text"), F.first("wide").alias("wide"))
    g = _assembled(cells, PAGE)
    return g.where((F.size("rows") >= least_rows) & (F.size(filled(F.col("rows"))) >= least_cells)).select(*PAGE, F.lit(0).alias("grid"), "rows")


def header_gate(lines: DataFrame) -> DataFrame:
    """TBL6: doc_id, page, edges, header_y, time_col: pages whose runs start in three to seven columns and one of whose first twenty lines names a time and a
    content column; of several time columns the one with most lines below."""
    starts = lines.select(*PAGE, F.explode("runs").alias("r")).select(*PAGE, F.col("r.x").alias("x"))
    many = starts.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") >= GATE_RUNS).select(*PAGE)
    e = clusters(starts.join(many, PAGE, "left_semi"), "x").where(F.size("edges").between(*GATE_EDGES) & (F.array_max("edges") - F.array_min("edges") >= GATE_SPAN))
    f = fragments(lines, e)
    probe = F.regexp_replace("text", "(?<=[a-z])(?=[A-Z])", " ")
    short = F.length("text") <= 40
    told = f.where(F.col("line") <= GATE_LINES).groupBy(*PAGE, "line").agg(
        F.count("*").alias("cols"), F.first("y0").alias("header_y"), F.collect_list(F.when(short & probe.rlike(TIME_HEADER), F.col("col"))).alias("times"),
        F.count_if(short & ~probe.rlike(TIME_HEADER) & probe.rlike(CONTENT_HEADER)).alias("contents"),
    )
    head = told.where((F.col("cols") >= 2) & (F.size("times") > 0) & (F.col("contents") > 0)).groupBy(*PAGE).agg(F.min_by(F.struct("header_y", "times"), "line").alias("h")).select(*PAGE, "h.*")
    below = f.join(head, PAGE).where((F.col("y0") > F.col("header_y") + SLACK) & F.array_contains("times", F.col("col"))).groupBy(*PAGE, "col").agg(F.countDistinct("line").alias("n"))
    best = below.groupBy(*PAGE).agg(F.max_by("col", F.struct(F.col("n"), -F.col("col"))).alias("dense"))
    return head.join(best, PAGE, "left").join(e, PAGE).select(*PAGE, "edges", "header_y", F.coalesce("dense", F.array_min("times")).alias("time_col"))


def gated_grids(lines: DataFrame) -> DataFrame:
    """TBL7: a row for each entry of the time column below the header; what has none belongs to the row above."""
    gate = settled(header_gate(lines))
    f = fragments(lines, gate.select(*PAGE, "edges"))
    tops = f.join(gate.select(*PAGE, "header_y", "time_col"), PAGE).where((F.col("col") == F.col("time_col")) & (F.col("y0") > F.col("header_y") + SLACK)).select(*PAGE, F.col("y0").alias("top"))
    return _filled(f, tops.unionByName(gate.select(*PAGE, F.col("header_y").alias("top"))).distinct(), 3, 6)


def unruled_grids(lines: DataFrame) -> DataFrame:
    """TBL5: grids by where lines start. Rows begin at week marks where there are two (and far below the last line), at every line of an evenly
    set first column, else after a wide gap in it."""
    enough = lines.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 8").select(*PAGE)
    f = fragments(lines, column_edges(lines.join(enough, PAGE, "left_semi")))
    high = f.groupBy(*PAGE).agg(F.coalesce(F.percentile(F.when(F.col("high") > 0, F.col("high")), 0.5), F.lit(12.0)).alias("lh"))
    a = f.where("col = 0").select(*PAGE, "y0", F.col("text").rlike(WEEK_MARK).alias("mark")).join(high, PAGE)
    w = Window.partitionBy(*PAGE).orderBy("y0")
    a = a.withColumn("gap", F.col("y0") - F.lag("y0").over(w)).withColumn("seen", F.coalesce(F.max("mark").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    p = Window.partitionBy(*PAGE)
    a = a.withColumn("marks", F.count_if("mark").over(p)).withColumn("even", F.percentile("gap", 0.5).over(p) <= F.col("lh") * TIGHT).withColumn("n", F.count("*").over(p))
    far = F.coalesce(F.col("gap") > F.col("lh") * APART, F.lit(False))
    opens = F.when(F.col("marks") >= 2, F.col("mark") | (F.col("seen") & far)).when(F.coalesce("even", F.lit(False)), True).otherwise(F.col("gap").isNull() | far)
    tops = a.where((F.col("n") >= 2) & opens).select(*PAGE, F.col("y0").alias("top"))
    several = tops.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n >= 2").select(*PAGE)
    return _filled(f, tops.join(several, PAGE, "left_semi"), 2, 4)


def grids(runs: DataFrame, rules: DataFrame, lines: DataFrame) -> DataFrame:
    """TBL8: what rules draw comes first; pages without it are read by their lines' starts, and those without such columns by their header."""
    ruled, lines = settled(ruled_grids(runs, rules)), settled(lines)
    rest = lines.join(ruled.select(*PAGE).distinct(), PAGE, "left_anti")
    by_lines = unruled_grids(rest)
    starts = settled(column_edges(rest).select(*PAGE))
    gated = gated_grids(rest.join(starts, PAGE, "left_anti"))
    return ruled.unionByName(by_lines).unionByName(gated)
