"""Queries and oracle SQL of the numbered operators."""

from __future__ import annotations

from lexquarry.llm.alignment import op11_alignment
from lexquarry.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from lexquarry.llm.jaccard import op1_jaccard
from lexquarry.llm.lines import op5_lines
from lexquarry.llm.packing import op2_packing
from lexquarry.llm.personal import op12_personal
from lexquarry.llm.quality import op7_quality
from lexquarry.llm.secrets import op9_secrets
from lexquarry.llm.shallot import OP13_SQL, op13_clusters
from lexquarry.llm.sharding import op4_sharding
from lexquarry.llm.transducer import op10_bpe
from lexquarry.llm.suffix_tree import op6_suffix_tree
from lexquarry.llm.vectors import OP3_SQL, op3_embeddings

QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_packing": op2_packing,
    "op3_embeddings": op3_embeddings,
    "op4_sharding": op4_sharding,
    "op5_lines": op5_lines,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_bpe": op10_bpe,
    "op11_alignment": op11_alignment,
    "op12_personal": op12_personal,
    "op13_clusters": op13_clusters,
}

ORACLE_SQL = {
    "op3_embeddings": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op13_clusters": OP13_SQL,
}
