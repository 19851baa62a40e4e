"""The queries of all operators of this subpackage by name."""

from __future__ import annotations

from subsumo.llm import bpe, jaccard, licenses, merge_tables, mixing, neighbors, outliers, packing, ranking, secrets, sharding, spelling, toxicity
from subsumo.llm.common import Query

QUERIES: dict[str, Query] = {}
for _module in (jaccard, sharding, licenses, mixing, outliers, toxicity, neighbors, packing, bpe, secrets, spelling, merge_tables, ranking):
    QUERIES.update(_module.QUERIES)
