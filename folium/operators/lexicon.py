"""A word list counted from a corpus, and the two repairs that ask it: words cut at line ends, and words run together.

The list stays a table. Distinct hits of a pattern meet it in joins, and each distinct text is put together again from its hits' answers, so that no word list goes
through the driver or into a closure. Null texts stay null; repeated texts are worked once; a text without a hit is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import EDITS, SHORT_WORDS, URL, once, with_told
from folium.sources.io import settled

LETTER = "A-Za-zÀ-ɏ"
#: A word of the list has this many letters at most, so that a run has a bounded number of pieces at each letter.
LONGEST = 30
#: Runs shorter than this are never parted.
LEAST_RUN = 12
RUN = rf"(?<![{LETTER}])[{LETTER}][a-zà-ɏ]{{{LEAST_RUN - 1},}}(?![{LETTER}])"
CUT = r"([\p{L}\p{N}_]+)-[ \t]*\n[ \t]*([\p{L}\p{N}_]+)"


def word_costs(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """TXT13: lower-case words of a corpus, and hyphenated compounds as a whole, that stand in ``least`` texts: word, n (texts), cost (the rarer, the dearer; thousandths of a nat)."""
    body = F.regexp_replace(F.lower(text), URL, " ")
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(f"[{LETTER}]+(?:-[{LETTER}]+)*"), F.lit(0)))
    with_parts = once(found, lambda x: F.array_distinct(F.concat(x, F.flatten(F.transform(F.filter(x, lambda w: F.contains(w, F.lit("-"))), lambda w: F.split(w, "-"))))))
    words = docs.select(F.explode(with_parts).alias("word"))
    counts = settled(words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("cost", F.round(1000 * (F.ln(F.lit(float(total)) / F.col("n")) + 1)).cast("long"))


def rewritten(docs: DataFrame, text: str, pattern: str, answers: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Adds struct<text, edits>: each hit of ``pattern`` replaced by its answer. ``answers`` takes the distinct hits (hit) and gives (hit, put, rule) for those that it changes."""
    key, gaps = F.unhex(F.sha2(F.col(text), 256)), F.split(F.col(text), pattern, -1)
    # A distinct text is one row with its hits in order until it has a short number; only that goes along with each hit.
    # Told once: a filter on plain columns would go below them and look for the hits, and make the text itself, a second time.
    held = with_told(docs.select(text), _rewritten_key=key, hits=F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).where(F.size("hits") > 0).select("_rewritten_key", "hits")
    held = settled(held.dropDuplicates(["_rewritten_key"]).withColumn("_id", F.monotonically_increasing_id()))
    hits = held.select("_id", F.posexplode("hits").alias("_at", "hit"))
    told = hits.join(answers(hits.select("hit").distinct()), "hit", "left")
    found = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("put", "hit").alias("put"), "rule", "hit")))
    texts = told.groupBy("_id").agg(found.alias("_rewritten_hits"), F.count("rule").alias("_n")).where("_n > 0").drop("_n").join(held.select("_id", "_rewritten_key"), "_id").drop("_id")
    whole = F.array_join(F.zip_with(gaps, "_rewritten_hits", lambda g, h: F.concat(g, F.coalesce(h["put"], F.lit("")))), "")
    edits = F.transform(F.filter("_rewritten_hits", lambda h: h["rule"].isNotNull()), lambda h: F.struct(h["rule"].alias("rule"), h["hit"].alias("before"), h["put"].alias("after")))
    done = F.struct(F.when(F.col("_rewritten_hits").isNull(), F.col(text)).otherwise(whole).alias("text"), F.coalesce(edits, F.array().cast(EDITS)).alias("edits"))
    return docs.withColumn("_rewritten_key", key).join(texts, "_rewritten_key", "left").withColumn(out, done).select(*[c for c in docs.columns if c != out], out)


def dehyphenated(docs: DataFrame, words: DataFrame, text: str = "text", out: str = "repaired") -> DataFrame:
    """TXT9: a word cut at a line end is whole again. The hyphen stays before a capital and in a compound that the list holds; what the list holds in
    neither form is joined too, as cut words are far more common, and told as unverified."""

    def answers(hits: DataFrame) -> DataFrame:
        head, tail = F.regexp_extract("hit", CUT, 1), F.regexp_extract("hit", CUT, 2)
        parts = hits.select("hit", F.concat(head, tail).alias("whole"), F.concat(head, F.lit("-"), tail).alias("kept"), tail.rlike(r"^\p{Lu}").alias("capital"))
        known = lambda name: words.select(F.col("word").alias(f"_{name}"))
        met = parts.join(known("whole"), F.lower("whole") == F.col("_whole"), "left").join(known("kept"), F.lower("kept") == F.col("_kept"), "left")
        keeps = F.col("capital") | (F.col("_whole").isNull() & F.col("_kept").isNotNull())
        rule = F.when(keeps, "hyphen_compound_kept").when(F.col("_whole").isNotNull(), "hyphen_rejoin").otherwise("hyphen_rejoin_unverified")
        return met.select("hit", F.when(keeps, F.col("kept")).otherwise(F.col("whole")).alias("put"), rule.alias("rule"))

    return rewritten(docs, text, CUT, answers, out)


#: A piece's number tells its end and, below that, its letters, longer ones (that start first) before shorter ones.
PLACE = 32


def _cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs (run, at, cost), a run's pieces together and by their number: where the words of least cost end that reach furthest from the run's start.

    Of equal costs the one whose last piece starts first holds. A task keeps one run's best pieces, one for each letter.
    """
    held, best = None, {}

    def ends() -> Iterator[tuple[int, list[int]]]:
        if held is not None:
            at, path = max(best), []
            while at:
                path.append(at)
                at = best[at][1]
            yield held, path[::-1]

    def told(out: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([e for _, e in out], pa.list_(pa.int32()))], ["run", "ends"])

    for batch in batches:
        out = []
        for run, at, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run != held:
                out += ends()
                held, best = run, {0: (0, 0)}
            end = at // PLACE
            start = end - (PLACE - 1 - at % PLACE)
            if start in best:
                reached = best[start][0] + cost
                if end not in best or reached < best[end][0]:
                    best[end] = (reached, start)
        yield told(out)
    yield told(list(ends()))


@F.pandas_udf(T.StringType())
def _parts(x: pd.Series, ends: pd.Series) -> pd.Series:
    """A run's words, by where they end."""
    return pd.Series([" ".join(v[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)) for v, e in zip(x, (list(e) for e in ends), strict=True)], dtype=object)


def parted(hits: DataFrame, words: DataFrame) -> DataFrame:
    """TXT12: runs (hit) that the list does not hold but that are made of its words, parted at least cost: hit, put, rule. Pieces of one or two letters have to be of the
    closed list; a run with no such parting is not in the result. Each letter of a distinct unknown run meets the list with ``LONGEST`` pieces."""
    runs = hits.where(F.col("hit").rlike(f"^{RUN}$")).withColumn("low", F.lower("hit")).where(F.length("low") == F.length("hit"))
    # A run has a short number, and a piece two beside it: of all that the repair shuffles, pieces are by far the most.
    runs = settled(runs.join(words, F.col("low") == F.col("word"), "left_anti").withColumn("run", F.monotonically_increasing_id()))
    windows = F.regexp_extract_all("low", F.lit(rf"(?=(.{{1,{LONGEST}}}))"), F.lit(1))
    starts = runs.select("run", F.posexplode(windows).alias("start", "window"))
    ends = starts.select("run", "start", "window", F.explode(F.sequence(F.lit(1), F.length("window"))).alias("n"))
    pieces = ends.select("run", ((F.col("start") + F.col("n")).cast("long") * PLACE + (PLACE - 1 - F.col("n"))).alias("at"), F.expr("substring(window, 1, n)").alias("word")).where((F.length("word") > 2) | F.col("word").isin(*sorted(SHORT_WORDS)))
    met = pieces.join(words.select("word", "cost"), "word").select("run", "at", "cost")
    done = met.repartition("run").sortWithinPartitions("run", "at").mapInArrow(_cheapest, "run long, ends array<int>")
    whole = runs.join(done, "run").where(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) == F.length("low"))
    put = F.concat(F.substring("hit", 1, 1), F.expr("substring(_words, 2)"))
    return whole.withColumn("_words", _parts("low", "ends")).select("hit", put.alias("put"), F.lit("word_split").alias("rule"))


def spaced(docs: DataFrame, words: DataFrame, text: str = "text", out: str = "repaired") -> DataFrame:
    """TXT12, its statistical half: lost spaces between lower-case words are restored, outside URLs. Comes after the camel split (``functions.text.restore_spaces``)."""
    return rewritten(docs, text, rf"{URL}|{RUN}", lambda hits: parted(hits, words), out)
