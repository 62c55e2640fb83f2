"""The operators' registered queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from tallygrid.llm import bitpack, decontaminate, exactdedup, jaccard, langid, licenses, mix, pieces, sortmeans, suffixdedup, tokencounts, warc, yinyang

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_tokencounts": tokencounts.query,
    "op3_langid": langid.query,
    "op4_jaccard": jaccard.query,
    "op5_pieces": pieces.query,
    "op6_bitpack": bitpack.query,
    "op7_licenses": licenses.query,
    "op8_exactdedup": exactdedup.query,
    "op9_warc": warc.query,
    "op10_suffixdedup": suffixdedup.query,
    "op11_mix": mix.query,
    "op12_sortmeans": sortmeans.query,
    "op13_yinyang": yinyang.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_jaccard": jaccard.SQL,
    "op7_licenses": licenses.SQL,
    "op8_exactdedup": exactdedup.SQL,
    "op9_warc": warc.SQL,
    "op11_mix": mix.SQL,
    "op12_sortmeans": sortmeans.SQL,
    "op13_yinyang": yinyang.SQL,
}
