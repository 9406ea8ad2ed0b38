"""Registered queries of this folder, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from quarry.llm import align, decontam, embed, idpack, langid, mixing, pst, sharding, simhash, spelling, substring, toxicity, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeats": substring.op4_repeats,
    "op5_warc": warc.op5_warc,
    "op6_simhash": simhash.op6_simhash,
    "op7_embeddings": embed.op7_embeddings,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_suffix_tree": pst.op9_suffix_tree,
    "op10_sharding": sharding.op10_sharding,
    "op11_idpack": idpack.op11_idpack,
    "op12_align": align.op12_align,
    "op13_spelling": spelling.op13_spelling,
}
ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op7_embeddings": embed.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
