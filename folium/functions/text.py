"""Text repair as column expressions; NFC alone needs an Arrow UDF, as Spark has no such function.

The functions return the text; ``logged`` adds each step that changed it, as array<struct<rule,before,after>>.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Glyphs and what they stand for, name particles, short words, digits of the expressions below.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
CONTROL_GLYPHS = {"\x0b": "ff", "\x0c": "fi", "\x0e": "ffi", "\x0f": "ffl", "\x1b": "ff", "\x10": "“", "\x11": "”", "\x12": "‘", "\x13": "’"}
CONTROL_MARKERS = "\x14\x15\x16\x17\x18\x19\x1a\x1c\x1d\x1e\x1f\x80\x88\x95\xa7"
INVISIBLE = "​‌‍﻿­"
EXOTIC_SPACES = "       "
DASHES = "‐-—−"
PARTICLES = ("mc", "mac", "de", "di", "da", "del", "della", "van", "von", "der", "le", "la", "du", "des", "st", "o")
SHORT_WORDS = frozenset("a i an as at be by do go he if in is it my no of on or so to up us we".split())
LEADING_ACCENTS = {
    "´": "́", "ˊ": "́", "`": "̀", "ˋ": "̀", "¨": "̈", "ˆ": "̂", "^": "̂", "˜": "̃", "~": "̃", "ˇ": "̌",
    "˘": "̆", "˙": "̇", "˝": "̋", "°": "̊", "˚": "̊", "¯": "̄", "ˉ": "̄",
}
TRAILING_ACCENTS = {"¸": "̧", "˛": "̨"}
ORDINARY_SIGNS = "`~^"  # accents that are ordinary signs too: only within a word


def strip_cid_glyphs(x: Column) -> Column:
    """TXT1: "(cid:12)" goes; a space stays between two characters that are not spaces."""
    x = F.regexp_replace(x, r"(?<=\S)(?:\(cid:\d+\))+(?=\S)", " ")
    return F.regexp_replace(x, r"\(cid:\d+\)", "")


def decode_control_glyphs(x: Column) -> Column:
    """TXT2: control characters that stand for ligatures, quotes and dashes; other markers are spaces."""
    x = F.regexp_replace(x, r"(?<=\d)[\x14\x15](?=\d)", "-")
    for k, v in CONTROL_GLYPHS.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.translate(x, CONTROL_MARKERS, " " * len(CONTROL_MARKERS))


@F.pandas_udf(T.StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


#: Characters that NFC may change: none below U+0300, and no typographic dash, quote or dot.
NOT_NFC = r"[\x{300}-\x{200F}\x{2028}-\x{10FFFF}]"


def nfc(x: Column) -> Column:
    """TXT5's NFC; only texts that it may change go to Python."""
    return F.coalesce(_nfc(F.when(x.rlike(NOT_NFC), x)), x)


def _accented() -> tuple[dict[str, str], dict[str, str]]:
    """Every accent and ASCII letter that NFC makes one code point, as written: accent first, and letter first."""
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    one = lambda c, sign: unicodedata.normalize("NFC", c + sign)
    first = {a + c: one(c, sign) for a, sign in LEADING_ACCENTS.items() for c in letters if len(one(c, sign)) == 1}
    last = {c + a: one(c, sign) for a, sign in TRAILING_ACCENTS.items() for c in letters if len(one(c, sign)) == 1}
    return first, last


@F.pandas_udf(T.StringType())
def _composed(x: pd.Series) -> pd.Series:
    first, last = _accented()
    signs = re.escape(ORDINARY_SIGNS)
    sure = re.compile("[" + "".join(a for a in LEADING_ACCENTS if a not in ORDINARY_SIGNS) + "][A-Za-z]")
    within, after = re.compile(rf"(?<=\w)[{signs}][A-Za-z]"), re.compile("[A-Za-z][" + "".join(TRAILING_ACCENTS) + "]")

    def one(v: str | None) -> str | None:
        if v is None:
            return v
        for pattern, table in ((sure, first), (within, first), (after, last)):
            v = pattern.sub(lambda m, table=table: table.get(m[0], m[0]), v)
        return v

    return x.map(one)


def compose_diacritics(x: Column) -> Column:
    """TXT3: a spacing accent beside a letter becomes one letter where NFC has one code point for the two; only texts with such a sign go to Python."""
    signs = re.escape("".join([*LEADING_ACCENTS, *TRAILING_ACCENTS]))
    return F.coalesce(_composed(F.when(x.rlike(f"[{signs}]"), x)), x)


def expand_ligatures(x: Column) -> Column:
    """TXT4."""
    for k, v in LIGATURES.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def normalize_unicode(x: Column) -> Column:
    """TXT5: invisible characters go, exotic spaces are spaces, then NFC."""
    return nfc(normalize_spaces(x))


def fold_dashes(x: Column) -> Column:
    """TXT6: a typographic dash is a hyphen between digits (spaces around it go) and between letters."""
    x = F.regexp_replace(x, rf"(?<=[0-9]) *[{DASHES}] *(?=[0-9])", "-")
    return F.regexp_replace(x, rf"(?<=[A-Za-z])[{DASHES}](?=[A-Za-z])", "-")


URL = r"(?i:https?://|www\.)[^\s<>\"'\]}]+"
_LINK = r"(?i:https?://|www\.)"
_IN = r"[^\s<>\"']"
PASSES = 6


def rejoin_wrapped_urls(x: Column) -> Column:
    """TXT7: a URL that a line end cuts goes on, six times at most; not into a capitalised word, a short label or the next entry."""
    goes_on = rf"{_IN}*[-/=&_?](?=[ \t]*\n)"
    plain = rf"{_IN}*+(?=[ \t]*\n[ \t]*(?![A-Z][a-z]{{2,}}\b))"
    step = rf"({_LINK}(?:{goes_on}|{plain}))[ \t]*\n[ \t]*(?={_IN})(?![A-Za-z]{{1,6}}:)"
    for _ in range(PASSES):
        x = F.regexp_replace(x, step, "$1")
    return x


def close_url_spaces(x: Column) -> Column:
    """TXT8: a space in a URL stands for a lost hyphen where a path goes on after it."""
    step = rf"({_LINK}{_IN}*[A-Za-z0-9])[ \t]+(?=[A-Za-z0-9][A-Za-z0-9._~%/-]*+(?!{_IN}))(?=[A-Za-z0-9~%]*[-/._])"
    for _ in range(PASSES):
        x = F.regexp_replace(x, step, "$1-")
    return x


def dehyphenate(x: Column, keep: tuple[str, ...] = ()) -> Column:
    """TXT9: a hyphen at a line end goes, but stays before a capital and in the compounds to keep."""
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])-[ \t]*\n[ \t]*(?=\p{Lu})", "-")
    for word in keep:
        head, tail = word.split("-", 1)
        x = F.regexp_replace(x, rf"(?i)\b({head})-[ \t]*\n[ \t]*({tail})\b", "$1-$2")
    return F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])-[ \t]*\n[ \t]*(?=[\p{L}\p{N}_])", "")


def outside_urls(x: Column, step) -> Column:
    """The text with ``step`` applied to what stands between its URLs."""
    parts, urls = F.split(x, URL, -1), F.regexp_extract_all(x, F.lit(URL), F.lit(0))
    return F.array_join(F.zip_with(F.transform(parts, step), urls, lambda p, u: F.concat(p, F.coalesce(u, F.lit("")))), "")


def space_after_punctuation(x: Column) -> Column:
    """TXT10: a space after commas, and after periods before a new sentence, outside URLs."""
    low = "a-zà-ɏ"
    return outside_urls(x, lambda p: F.regexp_replace(F.regexp_replace(p, rf"([{low}.]),(?=[A-Za-z])", "$1, "), rf"([{low}]{{3,}})\.(?=[A-Z][{low}])", "$1. "))


def split_camel(x: Column) -> Column:
    """TXT11: a space between a lower and an upper letter, but not in names like McDonald and in PhD."""
    pieces = F.split(x, r"(?<=[a-zà-ɏ])(?=[A-Z])")
    first = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1)))
    lies = F.transform(first, lambda p, i: F.lower(p).isin(*PARTICLES) | ((F.length(p) < 3) & (F.length(F.get(pieces, i + 1)) == 1)))
    guarded = F.exists(lies, lambda v: F.coalesce(v, F.lit(False))) | (F.length(F.get(pieces, F.lit(0))) < 2)
    return F.when((F.size(pieces) < 2) | guarded, x).otherwise(F.array_join(pieces, " "))


def restore_spaces(x: Column) -> Column:
    """TXT12 without a word list (``operators.lexicon`` has the other half): only the camel split fires, run of letters by run of letters, outside URLs."""
    runs = lambda p: F.regexp_extract_all(p, F.lit(r"[A-Za-zÀ-ɏ]+|[^A-Za-zÀ-ɏ]+"), F.lit(0))
    split = lambda w: F.when(F.length(w) < 4, w).otherwise(split_camel(w))
    return outside_urls(x, lambda p: F.when(p.rlike("[a-zà-ɏ][A-Z]"), F.array_join(F.transform(runs(p), split), "")).otherwise(p))


MARKER = r"^[ \t]*(\(cid:\d+\)|[•▪●◦‣⁃⧫◆◇∗*?–—−-]|[a-zA-Z](?=\s))\s+"


def strip_leading_marker(x: Column) -> Column:
    """TXT14: struct<line, marker>."""
    return F.struct(F.regexp_replace(x, MARKER, "").alias("line"), F.nullif(F.regexp_extract(x, MARKER, 1), F.lit("")).alias("marker"))


def collapse_whitespace(x: Column) -> Column:
    """TXT15."""
    return F.trim(F.regexp_replace(x, r"[\s\u0085  -     　]+", " "))


def normalize_spaces(x: Column) -> Column:
    return F.translate(x, EXOTIC_SPACES + INVISIBLE, " " * len(EXOTIC_SPACES))


#: TXT16: the repairs of a page in their order.
PAGE_STEPS = {
    "cid": strip_cid_glyphs, "control": decode_control_glyphs, "diacritic": compose_diacritics, "ligature": expand_ligatures, "unicode": normalize_unicode, "url": rejoin_wrapped_urls,
    "url_space": close_url_spaces, "hyphen": dehyphenate, "punctuation": space_after_punctuation, "space": restore_spaces,
}
#: Steps that call Python; the others are wrapped so that what they read is evaluated once.
IN_PYTHON = frozenset({"diacritic", "unicode"})


def once(x: Column, step) -> Column:
    """``step`` of ``x``, with ``x`` evaluated once however often the step uses it."""
    return F.get(F.transform(F.array(x), lambda v: step(v)), 0)


def with_told(rows: DataFrame, **cells: Column) -> DataFrame:
    """Adds columns that are evaluated once a row: later steps and filters read their values, where those of plain columns would repeat what made them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cells.items()]))))


def clean_page_text(x: Column) -> Column:
    """TXT16."""
    for rule, step in PAGE_STEPS.items():
        x = step(x) if rule in IN_PYTHON else once(x, step)
    return x


EDITS = "array<struct<rule:string,before:string,after:string>>"


def _stepped(step):
    return lambda s: F.struct(s["text"].alias("before"), step(s["text"]).alias("after"), s["edits"].alias("edits"))


def _noted(rule: str):
    def note(s: Column) -> Column:
        edit = F.array(F.struct(F.lit(rule).alias("rule"), s["before"].alias("before"), s["after"].alias("after")))
        return F.struct(s["after"].alias("text"), F.concat(s["edits"], F.when(s["before"] != s["after"], edit).otherwise(F.array().cast(EDITS))).alias("edits"))

    return note


def logged(rows: DataFrame, column: str, steps: dict, out: str = "repaired") -> DataFrame:
    """Adds struct<text, edits>: the text after all steps, and each step that changed it. A step's text is made once."""
    now, log = f"_{out}_text", f"_{out}_edits"
    rows = rows.withColumn(now, F.col(column)).withColumn(log, F.array().cast(EDITS))
    held: list[tuple[str, object]] = []

    def fold(rows: DataFrame) -> DataFrame:
        state = F.struct(F.col(now).alias("text"), F.col(log).alias("edits"))
        for rule, step in held:
            state = once(once(state, _stepped(step)), _noted(rule))
        return rows.withColumn(f"_{out}", state).withColumn(now, F.col(f"_{out}.text")).withColumn(log, F.col(f"_{out}.edits")).drop(f"_{out}")

    for rule, step in steps.items():
        if rule not in IN_PYTHON:
            held.append((rule, step))
            continue
        rows, held = fold(rows), []
        rows = rows.withColumn(f"_{out}_then", step(F.col(now)))
        edit = F.struct(F.lit(rule).alias("rule"), F.col(now).alias("before"), F.col(f"_{out}_then").alias("after"))
        rows = rows.withColumn(log, F.when(F.col(now) != F.col(f"_{out}_then"), F.concat(log, F.array(edit))).otherwise(F.col(log))).withColumn(now, F.col(f"_{out}_then")).drop(f"_{out}_then")
    return fold(rows).withColumn(out, F.struct(F.col(now).alias("text"), F.col(log).alias("edits"))).drop(now, log)


DOI = r"10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+"


def first_url(x: Column) -> Column:
    """TXT17: the first URL, without closing punctuation."""
    return F.nullif(F.regexp_replace(F.regexp_extract(x, URL, 0), r"[.,;:]+$", ""), F.lit(""))


def first_doi(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(x, DOI, 0), r"[.,;:)]+$", ""), F.lit(""))


def slug(x: Column) -> Column:
    """TXT18."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def escape_html(x: Column) -> Column:
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def filename_words(x: Column) -> Column:
    """TXT19: the words of a file's name, without its ending."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)\.pdf$", ""), r"[_\-()\[\]]+", " "), r"\s+", " "))


# Words that carry no meaning for a match, and for a look-up.
MATCH_STOP = ("the", "a", "an", "of", "and", "in", "on", "for", "to", "is", "as")
LOOKUP_STOP = ("the", "a", "an", "of", "and", "in", "on", "for", "to", "from", "with", "at", "by", "as", "or", "its", "their", "this", "that", "how", "why")


def tokens(x: Column, stop: tuple[str, ...] = MATCH_STOP) -> Column:
    """TXT20: distinct lower-case words of more than two characters, without stop words."""
    found = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in stop]))
