"""All queries of the subpackage and the SQL that states the same results."""

from salestide.llm import queries_alignment, queries_ann, queries_decontam, queries_langid, queries_licences, queries_mixing, queries_packing, queries_pages, queries_pii, queries_repeats, queries_sharding, queries_simhash, queries_trie

QUERIES = {}
ORACLES = {}
for _part in (queries_mixing, queries_decontam, queries_simhash, queries_repeats, queries_pii, queries_sharding, queries_langid, queries_ann, queries_pages, queries_licences, queries_trie, queries_packing, queries_alignment):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
