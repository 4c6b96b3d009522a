"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, maxent, middles, neighbours, packing, pii, ranked, secrets, simhash, sketches, substring, toxicity, urls

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op10_pii": pii.op10_pii,
    "op9_packing": packing.op9_packing,
    "op2_maxent": maxent.op2_maxent,
    "op3_urls": urls.op3_urls,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_substring": substring.op7_substring,
    "op8_simhash": simhash.op8_simhash,
    "op11_sketches": sketches.op11_sketches,
    "op12_middle": middles.op12_middle,
    "op13_ranked": ranked.op13_ranked,
}

ORACLE_SQL: dict[str, str] = {"op7_substring": substring.ORACLE, "op12_middle": middles.ORACLE, "op13_ranked": ranked.ORACLE}
