"""All queries of the subpackage, by name, and the SQL of those that have one."""

from __future__ import annotations

from qaloom.llm import alignment, ann, collocations, contamination, jaccard_join, language_id, licenses, lm_score, packing, sharding, suffix_array, suffix_tree, toxicity

MODULES = (lm_score, ann, suffix_array, language_id, packing, suffix_tree, toxicity, contamination, licenses, jaccard_join, collocations, alignment, sharding)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
CHECKS = {name: sql for m in MODULES for name, sql in getattr(m, "CHECKS", {}).items()}
