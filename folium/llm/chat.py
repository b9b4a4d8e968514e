"""Chat formatting by a grammar that round-trips.

    conversation := turn*
    turn         := "[INST]" body "[/INST]" | "<s>" body "</s>" | "<<SYS>>" body "<</SYS>>" | "<|role|>" body "<|text|>" body "<|end|>"

The forms are those of a user, an assistant, a system and any other role. Each turn is first rendered as it stands and read back by the
parser; where the turn that comes back differs from the source, its body is escaped one level further, until it is identical: level 1 breaks up control
strings, level 2 every character that can begin one. Turns that are each read back alone are read back when joined, as every turn begins and ends with control
strings of its own and no body holds one: nothing can straddle two turns. An escape is a
backslash before the character it protects; a backslash in a text is doubled at every level, so one rule undoes all levels.

Defined results: a null text is empty; a null role is the empty role; turns of one number stand in order of role and text;
a repeated row is a turn of its own; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.llm.common import _to_arrow, table, width

FORMS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROLS = (*(c for f in FORMS.values() for c in f), *OTHER)
LEARNED = "assistant"
CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
#: A control string, or an escaped character, whichever comes first.
SCAN = re.compile(rf"\\.|{CONTROL.pattern}", re.S)


def escape(text: str, level: int) -> str:
    text = text.replace("\\", "\\\\")
    if level == 1:
        return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    if level == 2:
        return re.sub(r"[\[<]", lambda m: "\\" + m[0], text)
    return text


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", r"\1", body, flags=re.S)


def render(turns: list[tuple[str, str]], levels: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and, by code points, the spans of the bodies that are learned from."""
    parts, mask, at = [], [], 0

    def put(s: str) -> None:
        nonlocal at
        parts.append(s)
        at += len(s)

    for (role, text), level in zip(turns, levels, strict=True):
        body = escape(text, level)
        if role in FORMS:
            put(FORMS[role][0])
        else:
            put(OTHER[0])
            put(escape(role, 2))
            put(OTHER[1])
        begin = at
        put(body)
        if role == LEARNED:
            mask.append((begin, at))
        put(FORMS[role][1] if role in FORMS else OTHER[2])
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted conversation; None where the grammar does not accept it."""
    opens = {f[0]: (r, f[1]) for r, f in FORMS.items()}
    turns, at, role, close, begin = [], 0, None, None, 0
    for m in SCAN.finditer(formatted):
        t = m[0]
        if t[0] == "\\":
            if close is None:
                return None
            continue
        if close is None:
            if m.start() != at:
                return None
            if t in opens:
                role, close = opens[t]
            elif t == OTHER[0]:
                close = OTHER[1]
            else:
                return None
            begin = m.end()
        elif t != close:
            return None
        elif close == OTHER[1]:
            role, close, begin = unescape(formatted[begin : m.start()]), OTHER[2], m.end()
            if role in FORMS:
                return None
        else:
            turns.append((role, unescape(formatted[begin : m.start()])))
            close, at = None, m.end()
    return turns if close is None and at == len(formatted) else None


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str]]]:
    """Formatted text, mask and the turns as read back: each turn gets the lowest level at which it survives the round trip."""
    levels = []
    for turn in turns:
        level = 0
        while parse(render([turn], [level])[0]) != [turn]:
            level += 1
        levels.append(level)
    while True:
        formatted, mask = render(turns, levels)
        back = parse(formatted)
        if back == turns:
            return formatted, mask, back
        levels = [min(v + 1, 2) for v in levels]  # what one turn does to the next


def format_turn(turn: tuple[str, str]) -> tuple[str, list[tuple[int, int]], tuple[str, str]]:
    """Formatted text, mask and the turn as read back. A turn's text ends with its close, where the parser starts afresh, so a
    conversation is its turns' texts one after the other."""
    level = 0
    while parse((got := render([turn], [level]))[0]) != [turn]:
        level += 1
    return *got, parse(got[0])[0]


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped boolean"
TURNS = "conv_id long, position long, formatted string, begin long, end long"


@dataclass
class Running:
    """What a conversation's turns have added up to so far."""

    conv_id: int | None
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    escaped: bool = False
    said: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, role: str, text: str) -> tuple:
        """A row of ``TURNS``."""
        formatted, mask, back = format_turn((role, text))
        row = (self.conv_id, self.n_turns, formatted, *([self.formatted_chars + k for k in mask[0]] if mask else (None, None)))
        for a, b in mask:
            learned = unescape(formatted[a:b])
            self.loss_chars += len(learned)
            self.loss.update(_bytes(learned))
        self.said.update(_bytes(f"{back[0]}\n{back[1]}\n"))
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        self.escaped |= "\\" in formatted
        return row

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.escaped)


def _walked(rows: DataFrame, schema: str, by_turn: bool) -> DataFrame:
    """The turns of each conversation in order, one batch held at a time: a row for each turn, or one for each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    dealt = given.repartition(width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = _to_arrow(T._parse_datatype_string(schema))

    def put(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(k, 500).to_pylist():
                    if now is None or now.conv_id != r["conv_id"]:
                        if now and not by_turn:
                            out.append(now.row())
                        now = Running(r["conv_id"])
                    said = now.add(r["role"], r["text"])
                    if by_turn:
                        out.append(said)
                if out:
                    yield put(out)
        if now and not by_turn:
            yield put([now.row()])

    return dealt.mapInArrow(go, schema)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: digests and lengths of what is read back from the formatted text."""
    return _walked(rows, SCHEMA, False)


def format_rows(rows: DataFrame) -> DataFrame:
    """The formatted text, a row for each turn by its position, and the span in the conversation's text that is learned from."""
    return _walked(rows, TURNS, True)


def _bytes(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return format_conversations(rows.unionByName(probe)).drop("escaped")


# Levels are the lowest that survive: level 1 only where a control string stands in the text, so lengths follow in SQL.
_CONTROL_SQL = r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>"
SQL = {
    "op2_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(text) - length(replace(text, chr(92), '')) + len(regexp_extract_all(text, '{_CONTROL_SQL}'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 23 + length(role) + length(role) - length(regexp_replace(role, '[\[<\\]', '', 'g')) END)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
}
QUERIES = {"op2_chat_format": op2_chat_format}
