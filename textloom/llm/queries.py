"""The queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import alignment, bitslice, bpe, chat, license, matroska, minhash, mixing, phrases, pii, repeats, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_perspectives": chat.op2_perspectives,
    "op3_minhash": minhash.op3_minhash,
    "op4_matroska": matroska.op4_matroska,
    "op5_pii": pii.op5_pii,
    "op6_repeats": repeats.op6_repeats,
    "op7_bit_sliced": bitslice.op7_bit_sliced,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_license": license.op9_license,
    "op10_bpe": bpe.op10_bpe,
    "op11_phrases": phrases.op11_phrases,
    "op12_alignment": alignment.op12_alignment,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE_SQL: dict[str, str] = {"op2_perspectives": chat.OP2_SQL, "op7_bit_sliced": bitslice.OP7_SQL, "op11_phrases": phrases.OP11_SQL}
