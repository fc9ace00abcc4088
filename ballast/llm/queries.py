"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from ballast.llm import align, chat, classifier, decontaminate, language, ngram, packing, rules, shards, simhash, substring, warc, whiten

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op3_sharding": shards.op3_sharding,
    "op4_chat": chat.op4_chat,
    "op5_packing": packing.op5_packing,
    "op6_warc": warc.op6_warc,
    "op7_kneser_ney": ngram.op7_kneser_ney,
    "op8_rules": rules.op8_rules,
    "op9_classifier": classifier.op9_classifier,
    "op10_substring": substring.op10_substring,
    "op11_whitening": whiten.op11_whitening,
    "op12_alignment": align.op12_alignment,
    "op13_language": language.op13_language,
}
ORACLE = {
    "op1_decontamination": decontaminate.SQL,
    "op4_chat": chat.SQL,
    "op6_warc": warc.SQL,
    "op8_rules": rules.SQL,
    "op10_substring": substring.SQL,
}
