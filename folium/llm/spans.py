"""Places of pattern matches in a text, with DataFrame functions alone.

A span is ``struct<start:int,end:int,hit:string>``: code points, end exclusive. Matches are those of a
left-to-right scan without overlaps. Where ``split`` cuts and what ``regexp_extract_all`` returns come from the
same scan, so the lengths of the pieces and of the matches give the places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All spans of ``pattern`` in ``text``; texts that fail the cheap ``guard`` are not scanned."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    found = F.aggregate(both, start, step, lambda s: s["out"])
    return found if guard is None else F.when(guard, found).otherwise(none())


def labelled(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))


def digest(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank of the kind, comma-joined. Spans have kind, rank, start, end."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clear_of(spans: Column, taken: Column) -> Column:
    """Those spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def disjoint(spans: Column) -> Column:
    """Spans (start, end, kind, rank) by start, without those that begin within the one kept before."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    none = F.filter(ordered, lambda s: F.lit(False))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = x["start"] >= s["at"]
        return F.struct(F.when(fits, x["end"]).otherwise(s["at"]).alias("at"), F.when(fits, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: s["out"])


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space in the place of each character of a span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        lead = F.when(x["start"] > s["at"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).otherwise(F.lit(""))
        gap = F.repeat(F.lit(" "), F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["at"])))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], lead, gap).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans give the first's mark once."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        lead = F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], lead).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))
