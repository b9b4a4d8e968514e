"""Repairs that ask a word list: documents whose spaces are lost and whose words are cut at places that their key picks, made whole by the words of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import SHORT_WORDS, URL, once
from folium.operators import lexicon as L
from folium.registry import query, table

_LETTERS = f"[{L.LETTER}]+"
_URL = URL.replace("'", "''")
_LEX = rf"""w AS (SELECT unnest(list_distinct(list_concat(regexp_extract_all(b, '{_LETTERS}'), regexp_extract_all(b, '{_LETTERS}(?:-{_LETTERS})+')))) AS word
    FROM (SELECT regexp_replace(lower(text), '{_URL}', ' ', 'g') AS b FROM documents)),
  c AS (SELECT word, count(*) AS n FROM w WHERE length(word) <= {L.LONGEST} GROUP BY word HAVING count(*) >= 2),
  lex AS (SELECT word, round(1000 * (ln((SELECT sum(n) FROM c)::DOUBLE / n) + 1))::BIGINT AS cost FROM c)"""


def _joined(text: Column, step) -> Column:
    """The text's words by single spaces, each as ``step`` of (words, word, place) gives it with what stands before it."""
    return once(F.split(text, " ", -1), lambda parts: F.array_join(F.transform(parts, lambda p, i: step(parts, p, i)), ""))


def _run_together(text: Column, key: Column) -> Column:
    lower = lambda x: x.rlike("^[a-z]+$")

    def step(parts: Column, p: Column, i: Column) -> Column:
        lost = ((i + key) % 5 == 0) & lower(F.get(parts, i - 1)) & lower(p)
        return F.concat(F.when((i == 0) | F.coalesce(lost, F.lit(False)), "").otherwise(" "), p)

    return _joined(text, step)


_SPACED = rf"""
WITH RECURSIVE {_LEX},
  g AS (SELECT row_number() OVER () AS r, doc_id, text, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 OR coalesce((i - 1 + doc_id) % 5 = 0
    AND regexp_full_match(p[i - 1], '[a-z]+') AND regexp_full_match(x, '[a-z]+'), false) THEN x ELSE ' ' || x END), '') AS given FROM (SELECT *, string_split(text, ' ') AS p FROM documents)),
  h AS (SELECT r, unnest(string_split_regex(given, '{_URL}|{_LETTERS}')) AS gap, unnest(hits) AS hit, unnest(range(len(hits) + 1)) AS place
    FROM (SELECT *, regexp_extract_all(given, '{_URL}|{_LETTERS}') AS hits FROM g)),
  runs AS (SELECT DISTINCT hit, lower(hit) AS low FROM h WHERE regexp_full_match(hit, '[{L.LETTER}][a-zà-ɏ]{{{L.LEAST_RUN - 1},}}') AND lower(hit) NOT IN (SELECT word FROM lex)),
  cut AS (SELECT hit, s, n, substr(low, (s + 1)::INT, n::INT) AS word FROM runs, unnest(range(length(low))) AS a(s), unnest(range(1, {L.LONGEST + 1})) AS b(n) WHERE s + n <= length(low)),
  piece AS (SELECT hit, s + n AS e, list({{'s': s, 'cost': cost, 'word': word}}) AS l FROM cut JOIN lex USING (word) WHERE n > 2 OR word IN ({", ".join(f"'{w}'" for w in sorted(SHORT_WORDS))}) GROUP BY hit, e),
  dp AS (SELECT hit, 0::BIGINT AS e, [0::BIGINT] AS best, [''] AS words FROM runs
    UNION ALL SELECT hit, e, list_append(best, x.cost), list_append(words, x.words) FROM (
      SELECT dp.hit, dp.e + 1 AS e, best, words, list_sort(list_filter(list_transform(l, lambda p: {{'cost': best[p.s + 1] + p.cost, 's': p.s, 'words': words[p.s + 1] || ' ' || p.word}}), lambda q: q.cost IS NOT NULL))[1] AS x
      FROM dp JOIN runs USING (hit) LEFT JOIN piece ON piece.hit = dp.hit AND piece.e = dp.e + 1 WHERE dp.e < length(low))),
  put AS (SELECT hit, hit[1] || words[-1][3:] AS put FROM dp JOIN runs USING (hit) WHERE e = length(low) AND best[-1] IS NOT NULL),
  done AS (SELECT r, string_agg(gap || coalesce(put, hit, ''), '' ORDER BY place) AS text, count(put) AS n FROM h LEFT JOIN put USING (hit) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_split, done.text = g.text AS whole, sha256(done.text) AS text_sha FROM g LEFT JOIN done USING (r)"""


@query(_SPACED)
def lost_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT12, TXT13: each document without some spaces between lower-case words, restored by the words of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    given = docs.select("doc_id", _run_together(F.col("text"), F.col("doc_id")).alias("given"), F.sha2("text", 256).alias("was"))
    done = L.spaced(given, L.word_costs(docs), "given", "done")
    return done.select("doc_id", F.size("done.edits").cast("long").alias("n_split"), (F.sha2("done.text", 256) == F.col("was")).alias("whole"), F.sha2("done.text", 256).alias("text_sha"))


_CUT = L.CUT.replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '")
_CUTS = rf"""
WITH {_LEX},
  g AS (SELECT row_number() OVER () AS r, doc_id, text, array_to_string(list_transform(string_split(text, ' '), lambda x, i: CASE WHEN (i - 1 + doc_id) % 7 <> 0 OR doc_id IS NULL THEN x
    WHEN regexp_full_match(x, '[a-z]{{6,}}') THEN x[:3] || '-' || chr(10) || x[4:] WHEN regexp_full_match(x, '[a-z]+-[a-z]+') THEN replace(x, '-', '-' || chr(10)) ELSE x END), ' ') AS given FROM documents),
  h AS (SELECT r, unnest(string_split_regex(given, '{_CUT}')) AS gap, unnest(hits) AS hit, unnest(range(len(hits) + 1)) AS place FROM (SELECT *, regexp_extract_all(given, '{_CUT}') AS hits FROM g)),
  part AS (SELECT hit, regexp_extract(hit, '{_CUT}', 1) AS head, regexp_extract(hit, '{_CUT}', 2) AS tail FROM (SELECT DISTINCT hit FROM h WHERE hit IS NOT NULL)),
  rule AS (SELECT hit, head, tail, CASE WHEN regexp_matches(tail, '^\p{{Lu}}') THEN 'kept' WHEN lower(head || tail) IN (SELECT word FROM lex) THEN 'rejoined'
    WHEN lower(head || '-' || tail) IN (SELECT word FROM lex) THEN 'kept' ELSE 'unverified' END AS rule FROM part),
  done AS (SELECT r, string_agg(gap || coalesce(CASE rule WHEN 'kept' THEN head || '-' || tail ELSE head || tail END, ''), '' ORDER BY place) AS text,
    count(*) FILTER (WHERE rule = 'rejoined') AS n_rejoined, count(*) FILTER (WHERE rule = 'unverified') AS n_unverified, count(*) FILTER (WHERE rule = 'kept') AS n_kept FROM h LEFT JOIN rule USING (hit) GROUP BY r)
SELECT doc_id, coalesce(n_rejoined, 0) AS n_rejoined, coalesce(n_unverified, 0) AS n_unverified, coalesce(n_kept, 0) AS n_kept, sha256(done.text) AS text_sha FROM g LEFT JOIN done USING (r)"""


@query(_CUTS)
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT9, TXT13: each document with some words cut by a hyphen and a line's end, made whole by the words of all documents, and what each joint rests on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def step(parts: Column, p: Column, i: Column) -> Column:
        cut = F.when(p.rlike("^[a-z]{6,}$"), F.concat(F.substring(p, 1, 3), F.lit("-\n"), p.substr(F.lit(4), F.length(p)))).when(p.rlike("^[a-z]+-[a-z]+$"), F.replace(p, F.lit("-"), F.lit("-\n"))).otherwise(p)
        return F.concat(F.when(i == 0, "").otherwise(" "), F.when((i + F.col("doc_id")) % 7 == 0, cut).otherwise(p))

    given = docs.select("doc_id", _joined(F.col("text"), step).alias("given"))
    done = L.dehyphenated(given, L.word_costs(docs), "given", "done")
    n = lambda rule: F.size(F.filter("done.edits", lambda e: e["rule"] == rule)).cast("long")
    return done.select("doc_id", n("hyphen_rejoin").alias("n_rejoined"), n("hyphen_rejoin_unverified").alias("n_unverified"), n("hyphen_compound_kept").alias("n_kept"), F.sha2("done.text", 256).alias("text_sha"))
