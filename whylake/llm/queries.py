"""The queries of this package and the SQL that states the same results, where SQL can."""

from __future__ import annotations

from whylake.llm import bags, bpe, chat, cover, fertility, imatch, langid, licenses, merkle, packing, pii, simhash, toxicity

QUERIES = {
    "op1_curve_packing": packing.op1_curve_packing,
    "op2_license_rules": licenses.op2_license_rules,
    "op3_perspectives": chat.op3_perspectives,
    "op4_imatch": imatch.op4_imatch,
    "op5_subword_softmax": toxicity.op5_subword_softmax,
    "op6_bootstrapped_pii": pii.op6_bootstrapped_pii,
    "op7_simhash": simhash.op7_simhash,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_string_kernel": langid.op9_string_kernel,
    "op10_fertility": fertility.op10_fertility,
    "op11_bag_search": bags.op11_bag_search,
    "op12_cover_dedup": cover.op12_cover_dedup,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op2_license_rules": licenses.sql(),
    "op3_perspectives": chat.SQL,
    "op11_bag_search": bags.SQL,
    "op12_cover_dedup": cover.SQL,
    "op13_merkle": merkle.SQL,
}
