"""The queries of this folder, by name, and their DuckDB equivalents."""

from __future__ import annotations

from pulseforge.llm import bpe, fingerprints, infill, languages, licences, linededup, neardup, negatives, packing, quality, topk, toxicity, warc

QUERIES: dict = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_linededup": linededup.op3_linededup,
    "op4_topk": topk.op4_topk,
    "op5_languages": languages.op5_languages,
    "op6_packing": packing.op6_packing,
    "op7_licences": licences.op7_licences,
    "op8_bpe": bpe.op8_bpe,
    "op9_neardup": neardup.op9_neardup,
    "op10_warc": warc.op10_warc,
    "op11_quality": quality.op11_quality,
    "op12_infill": infill.op12_infill,
    "op13_negatives": negatives.op13_negatives,
}
ORACLES: dict[str, str] = {
    "op4_topk": topk.OP4_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_infill": infill.OP12_SQL,
    "op13_negatives": negatives.OP13_SQL,
}
