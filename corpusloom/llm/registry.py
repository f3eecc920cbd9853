"""All queries of this subpackage, and SQL where SQL can express them."""

from corpusloom.llm import byte_quality, decontamination, fill_in_middle, hamming_search, language_id, merkle, near_dedup, packing, pii, substring_dedup, toxicity, url_filter, vector_dedup

MODULES = [hamming_search, toxicity, pii, near_dedup, decontamination, packing, substring_dedup, language_id, url_filter, byte_quality, vector_dedup, merkle, fill_in_middle]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
