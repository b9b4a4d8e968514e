"""Weights, standing, GPA and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.dates import half_up

# Grade points and the cutoffs of the two common scales.
POINTS = {"A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D": 1.0, "F": 0.0}
SCALES = {
    "plusminus": {"A": 93.0, "A-": 90.0, "B+": 87.0, "B": 83.0, "B-": 80.0, "C+": 77.0, "C": 73.0, "C-": 70.0, "D": 60.0, "F": 0.0},
    "straight": {"A": 90.0, "B": 80.0, "C": 70.0, "D": 60.0, "F": 0.0},
}
CUTOFFS = SCALES["plusminus"]
BONUS = r"(?i)\b(?:extra\s+credit|bonus)\b"


def is_bonus(title: Column) -> Column:
    return F.coalesce(title.rlike(BONUS), F.lit(False))


def weight_verdict(total: Column) -> Column:
    """AGG2."""
    return F.when(total.isNull() | (total == 0), "none").when(total.between(99, 100.5), "ok").when(total < 99, "under").when(total <= 110, "over").otherwise("far over")


def standing(items: DataFrame, key: str, weight: str, percent: str, bonus: str) -> DataFrame:
    """AGG10: by key the total and graded weight, what is left, earned, average, bonus, banked and ceiling.

    Rows without a positive weight don't count. A bonus lies on top of the hundred: all of its weight lifts the ceiling, what it
    earned is banked, and it enters no average.
    """
    w, p = F.col(weight).cast("double"), F.col(percent).cast("double")
    counts, marked, extra = ~F.isnan(w) & (w > 0), p.isNotNull() & ~F.isnan(p), F.coalesce(F.col(bonus), F.lit(False))
    # Sums in another order differ in their last digits: nine places are kept, so that a half is a half in every order.
    total = lambda when, value: F.round(F.coalesce(F.sum(F.when(counts & when, value)), F.lit(0.0)), 9)
    sums = items.groupBy(key).agg(
        total(~extra, w).alias("t"), total(~extra & marked, w).alias("g"), total(~extra & marked, w * p / 100).alias("e"), total(extra, w).alias("b"), total(extra & marked, w * p / 100).alias("be")
    )
    left = F.greatest(F.lit(0.0), F.col("t") - F.col("g"))
    return sums.select(
        key, half_up(F.col("t"), 2).alias("total_weight"), half_up(F.col("g"), 2).alias("graded_weight"), half_up(left, 2).alias("remaining"), half_up(F.col("e"), 2).alias("earned"),
        half_up(F.when(F.col("g") > 0, F.col("e") / F.col("g") * 100)).alias("average"), half_up(F.col("b"), 2).alias("bonus"), half_up(F.col("e") + F.col("be")).alias("banked"),
        half_up(F.col("e") + left + F.col("b")).alias("ceiling"),
    )


def needed_for(target: Column, earned: Column, remaining: Column) -> Column:
    """AGG12: the percentage that the rest must bring on average; null where nothing is left."""
    return F.when(remaining > 0, half_up((target - earned) / remaining * 100))


def target_line(needed: Column) -> Column:
    return F.when(needed.isNull(), "graded").when(needed <= 0, "secured").when(needed > 100, "out of reach").otherwise("needed")


def resolve_scale(kind: Column, custom: Column | None = None) -> Column:
    """AGG12: the cutoffs of a course, best first, as array<struct<letter,floor>>: of a preset's name, or own ones (array<struct<letter,floor>>).

    Own cutoffs keep known letters with a floor above zero and end in F at zero; where none is left, and for unknown names, plus and
    minus holds.
    """
    preset = lambda name: F.array(*[F.struct(F.lit(k).alias("letter"), F.lit(v).alias("floor")) for k, v in SCALES[name].items()])
    out = F.when(kind == "straight", preset("straight")).otherwise(preset("plusminus"))
    if custom is None:
        return out
    place = F.create_map(*[F.lit(v) for k, letter in enumerate(POINTS) for v in (letter, k)])
    fit = F.filter(custom, lambda c: c["letter"].isin(*POINTS) & (c["floor"] > 0))
    ordered = F.array_sort(F.transform(fit, lambda c: F.struct((-c["floor"]).alias("less"), F.try_element_at(place, c["letter"]).alias("at"), c["letter"].alias("letter"), c["floor"].cast("double").alias("floor"))))
    own = F.concat(F.transform(ordered, lambda c: F.struct(c["letter"].alias("letter"), c["floor"].alias("floor"))), F.array(F.struct(F.lit("F").alias("letter"), F.lit(0.0).alias("floor"))))
    return F.when((kind == "custom") & (F.size(fit) > 0), own).otherwise(out)


def letter_on(percent: Column, scale: Column) -> Column:
    """The first letter of a resolved scale whose floor is reached; F below all; null without a percentage."""
    hit = F.get(F.filter(scale, lambda c: percent >= c["floor"]), 0)["letter"]
    return F.when(percent.isNotNull() & ~F.isnan(percent.cast("double")), F.coalesce(hit, F.lit("F")))


def letter_for(percent: Column, cutoffs: dict[str, float] = CUTOFFS) -> Column:
    out = F.lit("F")
    for letter, least in sorted(cutoffs.items(), key=lambda kv: kv[1]):
        out = F.when(percent >= least, letter).otherwise(out)
    return F.when(percent.isNotNull(), out)


def points_for(letter: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in POINTS.items() for v in kv]), letter)


def gpa(rows: DataFrame, key: list[str], letter: str, credits: str) -> DataFrame:
    """AGG11: credit-weighted; rows without a known letter or credits do not count."""
    p = points_for(F.col(letter))
    ok = p.isNotNull() & (F.col(credits) > 0)
    return rows.groupBy(*key).agg(F.sum(F.when(ok, p * F.col(credits))).alias("points"), F.sum(F.when(ok, F.col(credits))).alias("credits")).select(*key, (F.col("points") / F.col("credits")).alias("gpa"), "credits")


def select_level(items: DataFrame, key: str, level: str, weight: str, order: str) -> DataFrame:
    """AGG5: where the items of one marker level sum to a whole (99 to 100.5) with more than one member, only they stay."""
    sums = items.groupBy(key, level).agg(F.sum(weight).alias("s"), F.count("*").alias("n"), F.min(order).alias("first"))
    best = sums.where("s between 99 and 100.5 and n > 1").groupBy(key).agg(F.min_by(level, F.struct("first", level)).alias("_level"))
    return items.join(best, key, "left").where(F.col("_level").isNull() | (F.col(level) == F.col("_level"))).drop("_level")
