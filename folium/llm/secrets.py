"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of at least ``MIN_RUN`` letters, digits and ``+/_=-``; of a run that a pattern match covers in part, what is
left outside the match counts. Its character class (``CLASSES``, the narrowest that holds all its characters) sets the
threshold. A window of ``WINDOW`` characters slides over the run: each step adds one character's count, takes one away and so
keeps the sum of n*log2(n), from which the entropy follows. The counts stand five bits each in a few longs, so that a step
changes one number, however many characters the class has. The highest window decides. Runs on the allow list (UUIDs, long plain numbers, words of one case or capitalised that
separators join, camel-cased words, dates, placeholders) are suppressed.

Defined results: a null or empty text has no spans; repeated rows each get a result; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import table, text_of
from folium.llm.spans import blanked, digest, find, labelled

KINDS = ("assign", "access", "hex")
NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = NAME + r"([A-Za-z0-9+/_.=-]+)"
# Runs end where their characters end, so a possessive run from its first character gives the same matches in linear time.
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
MIN_RUN, WINDOW = 20, 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+"
#: Character classes from the narrowest on: their pattern, and the bits a character that the best window needs. A class of
#: letters alone holds words too, so it asks for more of the 4.32 bits that ``WINDOW`` characters can have.
CLASSES = (
    ("digits", r"^[0-9]+$", 2.9),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.8),
    ("lower", r"^[a-z]+$", 3.75),
    ("upper", r"^[A-Z]+$", 3.6),
    ("lower and digits", r"^[a-z0-9]+$", 3.4),
    ("upper and digits", r"^[A-Z0-9]+$", 3.4),
    ("letters", r"^[A-Za-z]+$", 3.7),
    ("all", "", 3.4),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of five bits that a long holds.
PACKED = 12
#: A word in a joined run: of one case or capitalised, with a vowel, and with a short number after it.
WORD = r"(?=[A-Za-z]*?[aeiouyAEIOUY])(?:[A-Z]?[a-z]{2,}+|[A-Z]{3,}+)[0-9]{0,2}+"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    rf"^[-_/+=]*+(?=[A-Za-z0-9]++[-_/+=]++[A-Za-z0-9])(?:(?:{WORD}|[0-9]{{1,4}}+|[A-Za-z]{{1,2}}+)(?:[-_/+=]++|$))++$",
    r"^[a-z]*+(?:[A-Z][a-z]{2,}+)++$",
    r"(?i)example|placeholder|changeme|x{6}|0123456789|abcdefgh",
    r"^(?:[0-9]{1,4}+[-/_])++[0-9]{0,4}+(?:T[0-9]{0,6}+Z?+)?+$",
)


def window_entropy(run: Column, window: int = WINDOW, alphabet: str = ALPHABET) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` (31 at most) successive characters of ``run``."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    longs = -(-len(alphabet) // PACKED)

    def placed(c: Column) -> Column:
        at = F.greatest(F.position(c, F.lit(alphabet)), F.lit(1)) - 1
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((at % PACKED) * 5).cast("int"))
        return F.struct(F.floor(at / PACKED).cast("int").alias("long"), ((at % PACKED) * 5).cast("int").alias("shift"), bit.alias("one"))

    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), placed)
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0.0).alias("held"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        gone = F.when(s["i"] >= window, F.get(places, s["i"] - window))
        held_of = lambda x: F.call_function("shiftright", F.get(s["n"], x["long"]), x["shift"]).bitwiseAND(31).cast("int")
        add, drop = held_of(c), held_of(gone)
        change = F.get(weight, add + 1) - F.get(weight, add)
        # The character that leaves may be the one that comes: then nothing changes.
        less = F.when(gone.isNull(), F.lit(0.0)).otherwise(F.get(weight, drop - 1) - F.get(weight, drop))
        same = F.coalesce((gone["long"] == c["long"]) & (gone["shift"] == c["shift"]), F.lit(False))
        held = F.when(same, s["held"]).otherwise(s["held"] + change + less)
        none = F.lit(0).cast("long")
        n = F.transform(s["n"], lambda v, k: v + F.when(k == c["long"], c["one"]).otherwise(none) - F.when(k == gone["long"], gone["one"]).otherwise(none))
        best = F.when(s["i"] + 1 >= window, F.greatest(s["best"], F.lit(math.log2(window)) - held / window)).otherwise(s["best"])
        return F.struct(n.alias("n"), held.alias("held"), best.alias("best"), (s["i"] + 1).alias("i"))

    return F.aggregate(places, start, step, lambda s: s["best"])


def base_spans(text: Column) -> Column:
    assign = F.filter(find(text, ASSIGN, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 8)
    access = F.filter(find(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["hit"]) >= 16)
    kinds = [assign, access, find(text, HEX)]
    return F.concat(*[labelled(k, n, i) for i, (n, k) in enumerate(zip(KINDS, kinds, strict=True))])


def entropy_spans(text: Column, taken: Column) -> Column:
    """Candidates of high entropy in what ``taken`` leaves."""
    allowed = lambda h: F.lit(False) if not ALLOWED else _any([h.rlike(p) for p in ALLOWED])
    runs = F.filter(find(blanked(text, taken), RUN), lambda s: ~allowed(s["hit"]))

    def high(s: Column) -> Column:
        needed = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            needed = F.when(s["hit"].rlike(pattern), bits).otherwise(needed)
        # A window holds no more kinds of characters than the run does: most words fail by that.
        most = F.log2(F.least(F.size(F.array_distinct(F.split(s["hit"], ""))), F.lit(WINDOW)).cast("double"))
        return (most >= needed) & (window_entropy(s["hit"]) >= needed)

    return labelled(F.filter(runs, high), "entropy", len(KINDS))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds two array columns: ``<out>_base`` and ``<out>_added``, each of struct<start,end,kind,rank>."""
    with_base = docs.withColumn(f"{out}_base", base_spans(text_of(text_col)))
    return with_base.withColumn(f"{out}_added", entropy_spans(text_of(text_col), F.col(f"{out}_base")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("secrets_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(digest(F.col("secrets_base")), 256).alias("base_sha256"), digest(F.concat("secrets_base", "secrets_added")).alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL: dict[str, str] = {}
