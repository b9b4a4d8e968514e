"""All registered queries of this subpackage, and the SQL for those that SQL can express."""

from folium.llm import bpe, chat, decontaminate, langid, manifest, ngram_join, pii, secrets, sharding, substrings, toxicity, trie, vector_dedup

MODULES = [ngram_join, chat, pii, decontaminate, secrets, sharding, bpe, toxicity, vector_dedup, langid, substrings, manifest, trie]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
