"""Layout from positioned runs: lines, blocks, furniture, columns, reading order, footnotes; shapes of grids. A page bounds what meets in a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


RUN = "struct<x:double,y:double,w:double,h:double,size:double,run_id:int,text:string>"
BACK, NEAR, LEAST = 8, 0.55, 6.0  # lines looked back at, share of a height, and a run's least height


def line_text(runs: Column) -> Column:
    """LAY2: runs (array<RUN>) of one line as text, the spaces that kerning removed put back: one for a word's gap, several for a column's."""
    em = lambda r: F.greatest(r["size"], F.lit(4.0))
    many = lambda width, e: F.when(width <= e * 0.6, F.lit(" ")).otherwise(F.repeat(F.lit(" "), F.greatest(F.lit(2), F.least(F.lit(12), (width / (e * 0.35)).cast("int")))))

    def step(s: Column, r: Column) -> Column:
        x1 = r["x"] + r["w"]
        end = F.greatest(s["end"], x1)
        empty = (r["text"] != "") & (F.trim(r["text"]) == "")
        gap = r["x"] - s["end"]
        apart = s["end"].isNotNull() & (gap > em(r) * 0.25) & (s["out"] != "") & ~s["out"].endswith(" ") & ~r["text"].startswith(" ")
        piece = F.when(empty, many(F.greatest(r["w"], x1 - F.coalesce(s["end"], r["x"])), em(r))).otherwise(F.concat(F.when(apart, many(gap, em(r))).otherwise(""), r["text"]))
        return F.struct(end.alias("end"), F.concat(s["out"], piece).alias("out"))

    return F.aggregate(F.array_sort(runs), F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("out")), step, lambda s: s["out"])


def group_runs(runs: Column) -> Column:
    """LAY1: runs (array<RUN>) as lines, array<struct<y0,y1,runs>>: a run joins the newest of the last eight lines whose centre lies within 0.55 of its height."""
    LINE = f"struct<y0:double,y1:double,runs:array<{RUN}>>"

    def step(lines: Column, r: Column) -> Column:
        centre, reach = r["y"] + r["h"] / 2, F.greatest(r["h"], r["size"], F.lit(LEAST)) * NEAR
        n = F.size(lines)
        fits = F.filter(F.sequence(F.greatest(n - BACK, F.lit(0)), F.greatest(n - 1, F.lit(0))), lambda i: F.abs(centre - (F.get(lines, i)["y0"] + F.get(lines, i)["y1"]) / 2) <= reach)
        at = F.when(n > 0, F.array_max(fits))
        grown = F.transform(lines, lambda v, i: F.when(i == at, F.struct(F.least(v["y0"], r["y"]).alias("y0"), F.greatest(v["y1"], r["y"] + r["h"]).alias("y1"), F.concat(v["runs"], F.array(r)).alias("runs"))).otherwise(v))
        new = F.struct(r["y"].alias("y0"), (r["y"] + r["h"]).alias("y1"), F.array(r).alias("runs"))
        return F.when(at.isNotNull(), grown).otherwise(F.concat(lines, F.array(new)))

    shown = F.filter(runs, lambda r: F.trim(r["text"]) != "")
    ordered = F.transform(F.array_sort(F.transform(shown, lambda r: F.struct(r["y"].alias("ky"), r["x"].alias("kx"), r.alias("r")))), lambda k: k["r"])
    return F.aggregate(ordered, F.array().cast(f"array<{LINE}>"), step)


def run_struct() -> Column:
    return F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "size")], F.col("run_id").cast("int").alias("run_id"), F.col("text").alias("text"))


def visual_lines(runs: DataFrame) -> DataFrame:
    """LAY1/LAY2: runs (doc_id, page, run_id, text, x, y, w, h, size) as lines in order: doc_id, page, line, text, x0, x1, y0, y1, size, runs. A page is one row."""
    pages = runs.groupBy(*PAGE).agg(F.collect_list(run_struct()).alias("r"))
    told = pages.select(*PAGE, F.explode(group_runs(F.col("r"))).alias("v"))
    x0, x1 = F.array_min(F.transform("v.runs", lambda r: r["x"])), F.array_max(F.transform("v.runs", lambda r: r["x"] + r["w"]))
    sizes = F.array_sort(F.filter(F.transform("v.runs", lambda r: r["size"]), lambda s: s > 0))
    n = F.size(sizes)
    median = F.when(n > 0, (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2).otherwise(0.0)
    out = told.select(*PAGE, line_text(F.col("v.runs")).alias("text"), x0.alias("x0"), x1.alias("x1"), F.col("v.y0").alias("y0"), F.col("v.y1").alias("y1"), median.alias("size"), F.col("v.runs").alias("runs"))
    return out.withColumn("line", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "text")))


def blocks(lines: DataFrame) -> DataFrame:
    """LAY3: a gap of more than 0.85 of a line's height parts blocks, and so does a step up into another column."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line")
    was = F.lag(F.struct("x0", "x1", "y0", "y1")).over(w)
    b = lines.withColumn("_was", was)
    height = F.greatest(F.col("_was.y1") - F.col("_was.y0"), F.col("size"), F.lit(8.0))
    gap = F.col("y0") - F.col("_was.y1")
    same = (F.col("x0") < F.col("_was.x1")) & (F.col("_was.x0") < F.col("x1"))
    opens = F.coalesce((gap > 0.85 * height) | (~same & (gap < -height)), F.lit(True))
    b = b.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s["text"]), "\n")
    return b.groupBy(*PAGE, "block").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.coalesce(F.percentile(F.when(F.col("size") > 0, F.col("size")), 0.5), F.lit(0.0)).alias("size"))


def shape(x: Column) -> Column:
    """What a line looks like without its numbers."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "[0-9]+", "#"))


EDGE = 2


def running_shapes(lines: DataFrame, doc: str, page: str, text: str, order: str = "idx", share: float = 0.6, pages: int = 3) -> DataFrame:
    """LAY4: shapes that stand among the first and last two lines of at least max(2, 60 %) of a document's pages, of documents with three pages or more."""
    n = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    w = Window.partitionBy(doc, page)
    some = lines.where(F.trim(text) != "")
    some = some.withColumn("_up", F.row_number().over(w.orderBy(order))).withColumn("_down", F.row_number().over(w.orderBy(F.desc(order)))).where(f"_up <= {EDGE} or _down <= {EDGE}")
    s = some.groupBy(doc, shape(F.col(text)).alias("shape")).agg(F.countDistinct(page).alias("on"))
    return s.join(n, doc).where((F.col("pages") >= pages) & (F.col("on") >= F.greatest(F.lit(2), (share * F.col("pages")).cast("int"))) & (F.col("shape") != "")).select(doc, "shape")


def strip_running(lines: DataFrame, running: DataFrame, doc: str, text: str) -> DataFrame:
    """LAY5: without running shapes and bare page numbers."""
    kept = lines.withColumn("shape", shape(F.col(text))).join(running, [doc, "shape"], "left_anti").drop("shape")
    return kept.where(~F.trim(text).rlike("^[0-9]{1,4}$"))


def columns(blocks_: DataFrame) -> DataFrame:
    """LAY6: one or two columns a page."""
    ends = blocks_.groupBy(*PAGE).agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.count("*").alias("n"))
    mid, band = (F.col("l") + F.col("r")) / 2, 0.04 * (F.col("r") - F.col("l"))
    b = blocks_.join(ends, PAGE)
    told = b.groupBy(*PAGE).agg(
        F.first("n").alias("n"), F.sum(((F.col("x0") < mid - band) & (F.col("x1") > mid + band)).cast("int")).alias("across"),
        F.sum((F.col("x1") <= mid + band).cast("int")).alias("left"), F.sum((F.col("x0") >= mid - band).cast("int")).alias("right"),
    )
    two = (F.col("n") >= 6) & (F.col("across") / F.col("n") <= 0.15) & (F.col("left") >= 2) & (F.col("right") >= 2)
    return told.select(*PAGE, F.when(two, 2).otherwise(1).alias("columns"))


def reading_order(blocks_: DataFrame) -> DataFrame:
    """LAY7."""
    ends = blocks_.groupBy(*PAGE).agg(((F.min("x0") + F.max("x1")) / 2).alias("mid"))
    b = blocks_.join(columns(blocks_), PAGE).join(ends, PAGE)
    col = F.when((F.col("columns") == 2) & ((F.col("x0") + F.col("x1")) / 2 >= F.col("mid")), 1).otherwise(0)
    down = F.when(F.col("columns") == 2, F.col("y0")).otherwise(F.round("y0", 1))
    return b.withColumn("ordinal", F.row_number().over(Window.partitionBy(*PAGE).orderBy(col, down, "x0")) - 1).drop("mid")


NOTE = r"^\s*(?:[0-9]{1,3}[.)\s]|[*†‡§]\s*)"


def footnotes(blocks_: DataFrame, height: Column | None = None) -> DataFrame:
    """LAY8: adds is_note: smaller than the page's median, low on the page (of ``height``, else of its lowest block), and begun like a note."""
    m = blocks_.groupBy(*PAGE).agg(F.percentile(F.when(F.col("size") > 0, F.col("size")), 0.5).alias("median"), F.max("y1").alias("bottom"))
    b = blocks_.join(m, PAGE)
    tall = F.col("bottom") if height is None else height
    return b.withColumn("is_note", (F.col("size") > 0) & (F.col("size") < F.col("median") - 0.4) & (F.col("y0") >= 0.6 * tall) & F.col("text").rlike(NOTE)).drop("median", "bottom")


def tidy_grid(g: Column) -> Column:
    """SRC8: ragged rows padded, then empty columns and empty rows dropped. ARRAY<ARRAY<STRING>>."""
    wide = F.array_max(F.transform(g, F.size))
    padded = F.transform(g, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(wide - F.size(r), F.lit(0)))))
    held = F.filter(F.sequence(F.lit(0), wide - 1), lambda k: F.exists(padded, lambda r: F.trim(F.coalesce(F.get(r, k), F.lit(""))) != ""))
    cut = F.transform(padded, lambda r: F.transform(held, lambda k: F.coalesce(F.get(r, k), F.lit(""))))
    return F.filter(cut, lambda r: F.exists(r, lambda c: F.trim(c) != ""))


def is_real_table(g: Column) -> Column:
    """SRC9."""
    filled = F.size(F.filter(F.flatten(g), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(g) >= 2) & (F.array_max(F.transform(g, F.size)) >= 2) & (filled >= 4)
