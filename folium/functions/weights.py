"""Stated weights: each percentage of a text is found, and what stands left and right of it tells whether it weighs a piece of work, and which.

A line's percentage may close a table's row, close a line that is only a title, open a line, or stand alone. In running text it stands in brackets after its title,
and may say that it is the total of what follows. Nulls and texts without a percentage give nothing; each text is gone through once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Words of a grading scale that no title begins with, words for one of several, signs that a title may hold, and its length.
SCALE_WORDS = frozenset("and or to above below under over up down greater less lesser lower higher through plus minus but of is are was will would earns equals".split())
EACH = ("each", "apiece")
TITLE_SIGNS, WORD_SIGNS = frozenset("_&'’/,. ()-"), frozenset("_&'’/,.()+-")
BULLETS, RULES = "-•*–—", "-–—:,"
LEAST, MOST, MOST_WORDS = 3, 71, 4
SPACES = " \t\n\r\x0b\x0c"
FOUND = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("title", "string").add("weight", "double").add("declares", "boolean"))
STATED = T.StructType().add("shape", "string").add("title", "string").add("weight", "double").add("tail", "string")


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _fits(text: str, signs: frozenset) -> bool:
    return all(_plain(c) or c in signs for c in text)


def _back(text: str, at: int) -> int:
    """Where the spaces before a place begin."""
    while at and text[at - 1] in SPACES:
        at -= 1
    return at


def _on(text: str, at: int) -> int:
    """Where the spaces from a place on end."""
    while at < len(text) and text[at] in SPACES:
        at += 1
    return at


def percentages(text: str) -> Iterator[tuple[int, int, float]]:
    """Each number of at most three digits, with or without a fraction, and its sign: start, end, value."""
    sign = text.find("%")
    while sign >= 0:
        end = _back(text, sign)
        digits = end
        while digits and text[digits - 1].isascii() and text[digits - 1].isdigit():
            digits -= 1
        start = digits
        if digits < end and digits and text[digits - 1] == ".":
            whole = digits - 1
            while whole and text[whole - 1].isascii() and text[whole - 1].isdigit():
                whole -= 1
            start = whole if whole < digits - 1 else digits
        start = max(start, (text.find(".", start, end) if "." in text[start:end] else end) - 3)
        if start < end:
            yield start, sign + 1, float(text[start:end])
        sign = text.find("%", sign + 1)


def stated_in_line(line: str) -> tuple[str, str, float, str] | None:
    """What a single line states: (shape, title, weight, what follows). Of a lone percentage the title is empty, as it stands in a line above."""
    first = next(percentages(line), None)
    if first is None:
        return None
    start, end, weight = first
    left, right = line[:start], line[end:]
    title, gap = left.rstrip(SPACES), len(left) - len(left.rstrip(SPACES))
    if gap >= 2 and LEAST <= len(title) <= MOST and _letter(title[0]) and _fits(title, TITLE_SIGNS):
        return "row", title, weight, right
    if not right.strip(SPACES):
        words = title.strip(SPACES).split(" ")
        if gap and len(words) <= MOST_WORDS and _letter(words[0][:1] or " ") and all(w and _fits(w, WORD_SIGNS) for w in words):
            return "line", " ".join(words), weight, ""
        if title.strip(SPACES) in ("", "="):
            return "alone", "", weight, ""
    if left.strip(SPACES) == "" or (left.strip(SPACES) in BULLETS and len(left.strip(SPACES)) == 1):
        after = right.lstrip(SPACES)
        ruled = after[:1] != "" and after[0] in RULES
        name = after[1:].lstrip(SPACES) if ruled else after
        spaced = len(name) < len(after) - 1 if ruled else len(after) < len(right)
        size = next((k for k, c in enumerate(name) if not (_plain(c) or c in TITLE_SIGNS)), len(name))
        head = re.match("[A-Za-z0-9_]*", name)[0].lower()
        if spaced and size >= LEAST and _letter(name[0]) and head not in SCALE_WORDS:
            return "share", name[: min(size, MOST)], weight, ""
    return None


def _titled(text: str, bracket: int, floor: int, capital: bool) -> int | None:
    """Where the title before a bracket starts: the first letter (or capital) from which only a title's signs lead to it."""
    close = _back(text, bracket)
    low = max(floor, close - MOST)
    at = close
    while at > low and (_plain(text[at - 1]) or text[at - 1] in TITLE_SIGNS):
        at -= 1
    return next((k for k in range(at, close - LEAST + 1) if _letter(text[k]) and (text[k].isupper() or not capital)), None)


def _opened(text: str, start: int) -> int | None:
    """The bracket that opens right before a number."""
    at = _back(text, start) - 1
    return at if at >= 0 and text[at] == "(" else None


def stated_in_prose(text: str) -> list[tuple[int, int, str, float, bool]]:
    """Titles with a share in brackets, and those that state the total of what follows; a share within a total's stretch does not count, in order: (start, end, title, weight, declares)."""
    every = list(percentages(text))
    totals: list[tuple] = []
    for i, (start, end, weight) in enumerate(every):
        said = _on(text, end)
        if text[said : said + 5].lower() != "total":
            continue
        bracket = _opened(text, start)
        if bracket is None and i:
            before, stop, _ = every[i - 1]
            between = text[stop:start].strip(SPACES).rstrip(";,").rstrip(SPACES).lower().split()
            if between in ([w] for w in EACH) or (len(between) == 2 and between[0] == "per" and _fits(between[1], frozenset("_"))):
                bracket = _opened(text, before)
        floor = totals[-1][1] if totals else 0
        begun = None if bracket is None else _titled(text, bracket, floor, False)
        if begun is not None:
            totals.append((begun, said + 5, text[begun:bracket].rstrip(SPACES), weight, True))
    shares: list[tuple] = []
    for start, end, weight in every:
        close = _on(text, end)
        bracket = _opened(text, start) if text[close : close + 1] == ")" else None
        begun = None if bracket is None else _titled(text, bracket, shares[-1][1] if shares else 0, True)
        if begun is not None:
            shares.append((begun, close + 1, text[begun:bracket].rstrip(SPACES), weight, False))
    # Both lists are in order and neither overlaps itself, so one walk meets all that overlap.
    free, k = [], 0
    for s in shares:
        while k < len(totals) and totals[k][1] <= s[0]:
            k += 1
        if k == len(totals) or totals[k][0] >= s[1]:
            free.append(s)
    return sorted(totals + free)


@F.arrow_udf(STATED)
def in_line(x: pa.Array) -> pa.Array:
    told = [stated_in_line(v) if v and "%" in v else None for v in x.to_pylist()]
    columns = zip(*[t or (None, None, None, None) for t in told], strict=True) if told else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)], STATED.fieldNames())


@F.arrow_udf(FOUND)
def in_prose(x: pa.Array) -> pa.Array:
    return pa.array([stated_in_prose(v) if v and "%" in v else [] for v in x.to_pylist()], to_arrow_type(FOUND))


def _words(*cues: str) -> str:
    return "|".join(re.escape(c).replace(r"\ ", r"\s+") for c in sorted(cues, key=len, reverse=True))


# What says that a number of pages or words is a limit.
PAGE_CUES = ("maximum", "maximum of", "max", "max.", "no more than", "no longer than", "at most", "up to", "limit to", "limited to", "not exceed", "not to exceed")
WORD_CUES = ("maximum", "max", "max.", "no more than", "up to", "about", "approximately")


def limit(x: Column, unit: str, cues: tuple[str, ...], number: str, most_words: int) -> Column:
    """The first number of ``unit`` (as text) that a cue stands before, with at most so many words between number and unit; null if none."""
    said = rf"(?i)\b(?:{_words(*cues)})\s+({number})\s*(?:\(\s*[0-9]+\s*\)\s*)?(?:[a-z][a-z-]*\s+){{0,{most_words}}}{unit}s?\b"
    return F.nullif(F.regexp_extract(x, said, 1), F.lit(""))
