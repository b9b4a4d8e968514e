"""Text scalars, search and segmentation over documents and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import frontmatter as M
from folium.operators import grams as H
from folium.operators import search as S
from folium.operators import segment as G
from folium.registry import query, table
from folium.sources.io import short_batches

QUERY = ["the", "and"]

_WORDS = "regexp_extract_all(lower(body), '[a-z0-9]+')"


_RANKED = rf"""
WITH w AS (SELECT doc_id, ordinal, {_WORDS} AS words FROM (SELECT doc_id, 0 AS ordinal, coalesce(text, '') AS body FROM documents)),
t AS (SELECT doc_id, len(words) AS n, len(list_filter(words, lambda x: x = 'the')) AS a, len(list_filter(words, lambda x: x = 'and')) AS b FROM w),
c AS (SELECT count(*) AS n, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
SELECT doc_id, round(ln(1 + (c.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * t.n / mean))
  + ln(1 + (c.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * t.n / mean)), 6) AS score
FROM t, c WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 20
"""


@query(_RANKED)
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV3, SRT6: BM25 over whole documents, the best twenty, without an index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return S.search_once(docs, QUERY, ["doc_id"], 20, marked=False)


@query(_RANKED)
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV3, SRT6: the same from written postings, of which the search reads the blocks of highest weight alone."""
    from folium.sources.io import scratch

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    path = scratch(spark, "postings")
    S.write_index(docs, ["doc_id"], path)
    return S.search(spark, path, QUERY, ["doc_id"], 20)


_GROWN = rf"""
WITH w AS (SELECT kind, id, {_WORDS} AS words FROM (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS body FROM documents
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, coalesce(text, '') FROM conversations UNION ALL SELECT 'item', item_id, coalesce(text, '') FROM benchmark)),
t AS (SELECT kind, id, len(words) AS n, len(list_filter(words, lambda x: x = 'with')) AS a, len(list_filter(words, lambda x: x = 'for')) AS b FROM w),
c AS (SELECT count(*) AS n, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
SELECT kind, id, round(ln(1 + (c.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * t.n / mean))
  + ln(1 + (c.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * t.n / mean)), 6) AS score
FROM t, c WHERE a > 0 AND b > 0 ORDER BY score DESC, kind, id LIMIT 25
"""


@query(_GROWN)
def search_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV3: an index of documents, turns appended and merged into it, items appended after that; the query says a word twice and in capitals."""
    from folium.sources.io import scratch

    texts = lambda t, kind, key: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), key.alias("id"), F.coalesce("text", F.lit("")).alias("body"))
    path = scratch(spark, "postings")
    S.write_index(texts("documents", "document", F.col("doc_id")), ["kind", "id"], path)
    S.append_index(texts("conversations", "turn", F.col("conv_id") * 1000 + F.col("turn")), ["kind", "id"], path)
    S.merge_index(spark, ["kind", "id"], path)
    S.append_index(texts("benchmark", "item", F.col("item_id")), ["kind", "id"], path)
    return S.search(spark, path, "With for, WITH!", ["kind", "id"], 25)


@query(r"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents)
GROUP BY ALL
""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that search is built on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return S.postings(docs, ["doc_id"]).select("doc_id", "term", "tf")


@query(rf"""
WITH w AS (SELECT conv_id, turn, {_WORDS} AS words FROM (SELECT conv_id, turn, coalesce(text, '') AS body FROM conversations)),
t AS (SELECT conv_id, turn, len(words) AS n, len(list_filter(words, lambda x: x = 'that')) AS a FROM w),
c AS (SELECT count(*) AS n, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da FROM t),
h AS (SELECT conv_id, turn, round(ln(1 + (c.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * t.n / mean)), 6) AS score FROM t, c WHERE a > 0 ORDER BY score DESC, conv_id, turn LIMIT 20)
SELECT conv_id AS document_id, turn AS ordinal, score, 'talk ' || conv_id || '.pdf' AS filename, p_name AS title FROM h LEFT JOIN part ON p_partkey = conv_id AND conv_id % 3 > 0
""")
def search_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN4: hits with their chunk, its document and the document's work, if it has one."""
    from folium.operators.serving import found_chunks

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("body"))
    d = c.select(F.col("document_id").alias("id")).distinct().select("id", F.concat(F.lit("talk "), "id", F.lit(".pdf")).alias("filename"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("work_id"))
    hits = S.search_once(c, "That", ["document_id", "ordinal"], 20, marked=False)
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return found_chunks(hits, c, d, works).select("document_id", "ordinal", "score", "filename", "title")


#: Two characters, words that many kinds hold, a phrase with a space and capitals, one that no row holds.
NEEDLES = ["ed", "widget", "SPECIFIED", "red ring", "license", "zqzq"]

_FOUND = r"""
WITH rows AS (
SELECT 'Topic' AS kind, p_partkey AS id, CASE WHEN p_size <> 0 THEN 'Week ' || p_size ELSE '' END AS place, p_name AS body, p_name AS shown FROM part
UNION ALL SELECT 'Reading', doc_id, '', coalesce(source, '') || ' ' || coalesce(text, ''), coalesce(source, '') FROM documents
UNION ALL SELECT 'Your note', conv_id * 1000 + turn, CASE WHEN turn <> 0 THEN 'Week ' || turn ELSE '' END, coalesce(text, ''), coalesce(text, '') || ' — on ' || coalesce(role, '') FROM conversations
UNION ALL SELECT 'Assignment', o_orderkey, strftime(o_orderdate, '%-m/%-d'), o_orderpriority || ' ' || o_orderstatus, o_orderpriority FROM orders
UNION ALL SELECT 'Policy', page_id, '', coalesce(html, ''), left(flat, 160) || CASE WHEN length(flat) > 160 THEN '…' ELSE '' END FROM (SELECT *, trim(regexp_replace(html, '[ \t\n\r\f\v\x{00a0}]+', ' ', 'g')) AS flat FROM pages)),
n AS (SELECT unnest(['ed', 'widget', 'SPECIFIED', 'red ring', 'license', 'zqzq']) AS needle)
SELECT needle, kind, id, place, shown FROM rows, n WHERE contains(lower(body), lower(needle))
"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five kinds, from parts, documents, turns, orders and pages."""
    t = lambda name: table(spark, sf_dir, name)
    one = F.lit(1).alias("course_id")
    return H.searchable(
        t("part").select(one, F.col("p_partkey").alias("id"), F.col("p_name").alias("topic"), F.col("p_size").alias("week")),
        t("documents").select(one, F.col("doc_id").alias("id"), F.col("source").alias("cited"), F.col("text").alias("raw"), F.lit(None).cast("int").alias("week")),
        t("conversations").select(one, (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("note"), F.col("role").alias("cited"), F.col("turn").alias("week")),
        t("orders").select(one, F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("requirements"), F.col("o_orderdate").alias("due")),
        t("pages").select(one, F.col("page_id").alias("id"), F.col("html").alias("body")),
    )


@query(_FOUND)
def substring_search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV4, SET5: needles in all five kinds of text, from the index of their runs of characters."""
    from folium.sources.io import scratch

    rows, path = _kinds(spark, sf_dir), scratch(spark, "grams")
    H.write_grams(rows, ["kind", "id"], path)
    hits = reduce(DataFrame.unionByName, [H.find(spark, path, n, ["kind", "id"]).select(F.lit(n).alias("needle"), "kind", "id") for n in NEEDLES])
    return hits.join(rows.select("kind", "id", "place", "shown"), ["kind", "id"]).select("needle", "kind", "id", "place", "shown")


@query(_FOUND)
def substring_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRV4, SET5 without an index: one pass over all kinds."""
    rows = _kinds(spark, sf_dir)
    held = F.filter(F.array(*[F.lit(n) for n in NEEDLES]), lambda n: F.contains(F.lower("body"), F.lower(n)))
    return rows.select(F.explode(held).alias("needle"), "kind", "id", "place", "shown")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM documents")
def clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT15."""
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT5."""
    short_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", T.nfc(F.col("text")).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9]) *[‐-—−] *([0-9])', '\1-\2', 'g'), '([0-9]) *[‐-—−] *([0-9])', '\1-\2', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z])[‐-—−]([A-Za-z])', '\1-\2', 'g'), '([A-Za-z])[‐-—−]([A-Za-z])', '\1-\2', 'g') AS text FROM d
""")
def dash_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT6."""
    return table(spark, sf_dir, "documents").select("doc_id", T.fold_dashes(F.col("text")).alias("text"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-zà-ɏ.]),([A-Za-z])', '\1, \2', 'g'), '([a-zà-ɏ.]),([A-Za-z])', '\1, \2', 'g'), '([a-zà-ɏ]{3})\.([A-Z][a-zà-ɏ])', '\1. \2', 'g') AS text
FROM documents WHERE NOT regexp_matches(text, '(?i)https?://|www\.')
""")
def punct_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT10, of texts without a link (``spaced_marks`` has those with one)."""
    return table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?i)https?://|www\.")).select("doc_id", T.space_after_punctuation(F.col("text")).alias("text"))


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT16: the whole repair of a page, and how many edits it took."""
    short_batches(spark)
    out = T.logged(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", T.PAGE_STEPS, "r")
    return out.select("doc_id", F.col("r.text").alias("text"), F.size("r.edits").cast("long").alias("n_edits"))


@query()
def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir)


@query(r"""
SELECT page_id, regexp_replace(regexp_extract(html, '(?i:https?://|www\.)[^\s<>"''\]}]+'), '[.,;:]+$', '') AS first_url,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages
""")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT17, TXT18."""
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(T.first_url(F.col("html")), F.lit("")).alias("first_url"), T.slug(F.col("url")).alias("slug"))


@query(r"""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages
""")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT18."""
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


_TOKENS = r"""list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the','and','for')))"""


@query(rf"SELECT doc_id, len({_TOKENS})::BIGINT AS n_tokens, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM documents")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT20."""
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(r"""
WITH l AS (SELECT doc_id, lower(regexp_replace(trim(regexp_replace(u.line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS shape FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) AS u(line) WHERE trim(u.line) <> '')
SELECT shape, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM l GROUP BY shape HAVING count(DISTINCT doc_id) >= 3
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY4 over the corpus: shapes of lines that several documents share."""
    from folium.operators.layout import shape

    rows = G.lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "").select("doc_id", shape(F.col("line")).alias("shape"))
    by_doc = rows.groupBy("shape", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("shape").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).where("n_docs >= 3")


@query(r"""
WITH s AS (SELECT doc_id, lower(regexp_replace(trim(regexp_replace(u.line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS shape, trim(u.line) AS t FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) AS u(line)),
f AS (SELECT shape FROM s WHERE t <> '' GROUP BY shape HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS kept FROM s WHERE shape NOT IN (SELECT shape FROM f) AND NOT regexp_full_match(t, '[0-9]{1,4}') GROUP BY doc_id
""")
def without_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY5: what is left of each document."""
    from folium.operators.layout import shape

    rows = G.lines(table(spark, sf_dir, "documents")).withColumn("shape", shape(F.col("line")))
    running = repeated_lines(spark, sf_dir).select("shape")
    return rows.join(running, "shape", "left_anti").where(~F.trim("line").rlike("^[0-9]{1,4}$")).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG24."""
    return G.chunks(G.one_page(table(spark, sf_dir, "documents")))


@query()
def zone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG2, SEG7: lines of each zone of a document."""
    z = G.zones(G.lines(table(spark, sf_dir, "documents")))
    return z.groupBy("doc_id", "zone_id", "zone").agg(F.count("*").alias("lines"), F.min("idx").alias("first_line"))


_LINES = """
l AS (SELECT doc_id, i - 1 AS idx, lines[i] AS line, len(lines) AS n, list_position(list_transform(lines, lambda v: trim(v) = ''), false) - 1 AS first_at
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)),
b AS (SELECT *, trim(line) <> '' AND (idx = first_at OR n > 15 AND coalesce(trim(lag(line) OVER (PARTITION BY doc_id ORDER BY idx)) = '', true)) AS starts_block FROM l),
x AS (SELECT *, trim(line) AS t, trim(regexp_replace(regexp_replace(trim(line), '^\\s*(?:[0-9]+[.)]|[ivxIVX]+[.)]|[A-Z][.)])\\s*', ''), ':+$', '')) AS body FROM b),
w AS (SELECT *, regexp_extract_all(body, '[A-Za-z][A-Za-z''’-]*') AS words FROM x),
h AS (SELECT *, length(t) BETWEEN 1 AND 90 AND NOT regexp_matches(t, '[.,;?!]$') AND len(string_split_regex(t, '\\s+')) <= 12 AND body <> '' AND (
  upper(body) = body AND regexp_matches(body, '\\p{L}') AND length(body) > 3 OR suffix(t, ':') OR regexp_matches(t, '^\\s*(?:[0-9]+[.)]|[ivxIVX]+[.)]|[A-Z][.)])\\s*') AND regexp_matches(body, '^\\p{Lu}')
  OR starts_block AND length(body) <= 60 AND regexp_matches(body, '^\\p{Lu}') AND len(words) BETWEEN 1 AND 10 AND len(list_filter(words, lambda v: regexp_matches(v, '^[A-Z]'))) >= 0.6 * len(words)) AS head FROM w)"""


@query(f"""
WITH {_LINES},
r AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM h)
SELECT doc_id, island::BIGINT AS island, count(*) AS lines, min(idx)::BIGINT AS first_line FROM r GROUP BY doc_id, island
""")
def heading_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG1, SEG2, WIN7: lines grouped by the heading above them."""
    from pyspark.sql import Window

    rows = G.lines(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(G.is_heading(F.col("line"), F.col("starts_block")).cast("long")).over(w)
    return rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("lines"), F.min("idx").cast("long").alias("first_line"))


@query(r"""
SELECT doc_id, CASE WHEN contains(lower(text), 'licens') THEN 'license' WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret'
  WHEN contains(lower(text), '@') THEN 'contact' END AS class FROM documents
""")
def first_match_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG3, SEG21, EXT17: ordered word lists, the first that fits."""
    classes = {"license": ("licens",), "secret": ("password", "token"), "contact": ("@",)}
    return table(spark, sf_dir, "documents").select("doc_id", G.first_class(F.col("text"), classes).alias("class"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""
WITH d AS (SELECT doc_id, text, len(list_distinct(regexp_extract_all(text, {_q(M.WEEKS)}))) AS weeks FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, round((CASE WHEN weeks >= 3 THEN 0.4 WHEN weeks >= 1 THEN 0.1 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\\b[0-9]{{1,2}}\\s*/\\s*[0-9]{{1,2}}\\b')) >= 5 THEN 0.25 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(text, {_q(M.SHARES)})) >= 2 THEN 0.15 ELSE 0 END
  + CASE WHEN len(list_distinct(list_transform(regexp_extract_all(text, {_q(M.COURSE_WORDS)}), lambda v: lower(v)))) >= 2 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, {_q(M.SCALE)}) THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?i)\\bsyllabus\\b') THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(text, '(?i)\\b10\\.[0-9]{{4,9}}/\\S+') THEN 0.3 ELSE 0 END
  - CASE WHEN len(list_distinct(list_transform(regexp_extract_all(text, {_q(M.ARTICLE_WORDS)}), lambda v: lower(v)))) >= 2 THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS score FROM d)
SELECT doc_id, score, score >= 0.5 AS is_kind, round(least(1, 2 * abs(score - 0.5)), 3) AS confidence FROM s
""")
def kind_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT18: additive cues, a threshold, and the distance to it as confidence."""
    k = M.kind_of(F.col("text"), F.col("text"), F.lit(False))
    told = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", k.alias("k"))
    return told.select("doc_id", "k.score", (F.col("k.kind") == "syllabus").alias("is_kind"), "k.confidence")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1
""")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: the first document of each text, by a hash of it and an aggregate that combines before the shuffle."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("doc_id", "lang"), F.col("doc_id")).alias("d")).select("d.*")


@query(r"""
SELECT sig, min(doc_id) AS first_id, count(*) AS n FROM (
  SELECT doc_id, lang || '|' || coalesce(source, '') || '|' || array_to_string((list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> ''))[1:6], ' ') AS sig
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY sig
""")
def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXT5, AGG16: a signature of the first six words, and the first document that has it."""
    words = F.slice(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), " "), lambda w: w != ""), 1, 6)
    sig = F.concat_ws("|", "lang", F.coalesce("source", F.lit("")), F.array_join(words, " "))
    return table(spark, sf_dir, "documents").where("text is not null and lang is not null").groupBy(sig.alias("sig")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query(rf"""
WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), b AS (SELECT item_id, len({_TOKENS}) AS n, unnest({_TOKENS}) AS t FROM benchmark),
s AS (SELECT doc_id, item_id, count(*) / min(n)::DOUBLE AS cover FROM d JOIN b USING (t) GROUP BY ALL HAVING count(*) / min(n)::DOUBLE >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cover DESC, item_id) AS k FROM s)
SELECT doc_id, item_id, round(cover, 6) AS cover FROM r WHERE k = 1
""")
def best_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7, SET4: each document's best-covered item."""
    from folium.operators.matching import best_matches

    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("item_tokens"))
    return best_matches(docs, items, "doc_id", "item_id", "tokens", "item_tokens", 0.9).withColumn("cover", F.round("cover", 6))


@query(rf"""
WITH d AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM documents), b AS (SELECT item_id, len({_TOKENS}) AS n, unnest({_TOKENS}) AS t FROM benchmark),
m AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, item_id FROM d JOIN b USING (t) GROUP BY ALL HAVING count(*) = min(n)))
SELECT d.doc_id, m.doc_id IS NOT NULL AS held FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
""")
def late_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2, JOIN8 in batch: documents that hold all the words of an item, matched when the item arrives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("item_tokens"))
    from folium.operators.matching import best_matches

    hits = best_matches(docs, items, "doc_id", "item_id", "tokens", "item_tokens", 1.0).select("doc_id", F.lit(True).alias("hit"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("held"))


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def rejections_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN10, JOIN11: rejected documents go, marks of the others are carried."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    kept = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return kept.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""
SELECT 'label' AS entity, doc_id AS ref, 'low quality' AS reason FROM labels WHERE quality = 0
UNION ALL SELECT 'document', doc_id, 'short' FROM documents WHERE n_chars < 100
UNION ALL SELECT 'document', doc_id, 'no language' FROM documents WHERE lang IS NULL
""")
def review_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1, PRJ9: what needs a look, of all entities."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pick = lambda d, e, r: d.select(F.lit(e).alias("entity"), F.col("doc_id").alias("ref"), F.lit(r).alias("reason"))
    return pick(labels.where("quality = 0"), "label", "low quality").unionByName(pick(docs.where("n_chars < 100"), "document", "short")).unionByName(pick(docs.where("lang is null"), "document", "no language"))


@query("""
SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)
""")
def hash_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SRC2: content hashes are identities; a second copy changes nothing."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
