"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chunks, decontam, jaccard, lines, packing, pii, quality, repair, repeats, sharding, sketches, toxicity, trie
from .sql import ORACLE  # noqa: F401

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substring_dedup": chunks.op3_substring_dedup,
    "op4_run_length_index": repeats.op4_run_length_index,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_sharding": sharding.op10_sharding,
    "op11_structure_repair": repair.op11_structure_repair,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_document_fingerprints": sketches.op13_document_fingerprints,
}
