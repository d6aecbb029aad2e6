"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, html, langid, lengths, merkle, mixing, neardup, tokenbin, toxicity

QUERIES = {
    "op1_pareto_mix": mixing.op1,
    "op2_odd_sketch": neardup.op2,
    "op3_host_consensus": html.op3,
    "op4_mixture_em": langid.op4,
    "op5_merkle": merkle.op5,
    "op6_length_histogram": lengths.op6,
    "op7_wu_manber": decontam.op7,
    "op8_simple8b": tokenbin.op8,
    "op9_subword_bag": toxicity.op9,
    "op10_template_compiler": chat.op10,
}

ORACLES = {
    "op1_pareto_mix": mixing.SQL,
}
