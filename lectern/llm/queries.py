"""Queries opN_* of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lectern.llm import centroids, decontaminate, jaccard, licenses, packing, quality, sharding, simhash, substrings, topk, toxicity, variants, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_licenses": licenses.op2_licenses,
    "op3_warc": warc.op3_warc,
    "op4_topk": topk.op4_topk,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality": quality.op7_quality,
    "op8_substrings": substrings.op8_substrings,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_jaccard": jaccard.op11_jaccard,
    "op12_centroids": centroids.op12_centroids,
    "op13_variants": variants.op13_variants,
}
ORACLES: dict[str, str] = {"op2_licenses": licenses.ORACLE, "op4_topk": topk.ORACLE, "op11_jaccard": jaccard.ORACLE, "op12_centroids": centroids.ORACLE, "op13_variants": variants.ORACLE}
