"""The pipeline against its stages done one by one in plain Python, and what deleting the subpackage leaves."""

import base64
import hashlib

from pyspark.sql import functions as F


def test_pipeline_is_its_stages(spark):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from folium.llm import bpe, langid, pii
    from tests.llm.test_pairs import brute, sets

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    model = langid.fit(langid.known(docs))
    kept = {r.doc_id: r.text for r in langid.identify(docs, model).where("lang_pred <> 'und'").collect()}
    groups = brute(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = [sets(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(q and 5 * len(q & sets(t)) >= 4 * len(q) for q in items)}
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    clear = {r.doc_id: r.text for r in pii.redact(left, pii.fit(left)).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary(), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(got) == set(clear)
    for i, t in clear.items():
        ids = own.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()


def test_stages_on_nulls_and_nothing(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, score string"
    rows = [(1, "the of and in that was with this for", "en", "s", 5, "x", "y"), (1, "the of and in that was with this for", "en", "s", 5, "x", "y"), (None, "the of and in that was with this for", None, None, None, None, None), (2, None, "en", None, None, None, None), (3, "", "de", "s", 0, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            out.collect()
    first = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "/root/testdata/sf0.001")
    # The row without an id is a copy of document 1: one row of the group stays.
    assert first.where("doc_id = 1").count() == 1 and first.where(F.col("doc_id").isNull()).count() == 0


def test_stages_with_clashing_columns_and_what_the_language_is_for(spark):
    import corpus_pipeline

    text = "the of and in that was with this for her they from have are not but had by his as you on it is"
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, _lang string, _pii_base string, lang_pred string, score int, spans int"
    rows = [(k, text + f" {k}", "en" if k else None, "s", 5, "a", "b", "c", "d", 1, 2) for k in range(12)] + [(50, "12 34 !!", "en", "s", 5, "a", "b", "c", "d", 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns and {r.lang for r in out.collect()} == {"en"} and out.count() == 12
    for name in ("_text", "_lang", "_pii_base", "lang_pred", "score", "spans"):
        assert {r[0] for r in out.select(name).distinct().collect()} == {r[0] for r in docs.select(name).distinct().collect()}
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.first()["_text"] == "a" and out.first()["_pii_base"] == "c"
    from folium.llm import bpe, toxicity

    ids = bpe.encode(docs.select("doc_id", "text", "_text"), bpe.vocabulary())
    assert ids.columns == ["doc_id", "text", "_text", "n_tokens", "ids"] and ids.first()["_text"] == "a"
    scored = toxicity.score(docs.select("doc_id", "text", "_text"), toxicity.train([], []))
    assert scored.columns == ["doc_id", "text", "_text", "score"] and scored.first()["_text"] == "a"
