"""The registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from colsight.llm import collocations, divergence, maintext, mixing, neardup, ngrams, phrases, pii, ppm, quality, secrets, simhash, tokens

QUERIES = {
    "op1_token_files": tokens.op1_token_files,
    "op2_trie_scores": ngrams.op2_trie_scores,
    "op3_boosted_pii": pii.op3_boosted_pii,
    "op4_risk_rules": quality.op4_risk_rules,
    "op5_ppm_language": ppm.op5_ppm_language,
    "op6_secret_layers": secrets.op6_secret_layers,
    "op7_phrase_index": phrases.op7_phrase_index,
    "op8_mincut_text": maintext.op8_mincut_text,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_minhash_neardup": neardup.op10_minhash_neardup,
    "op11_phrase_stripes": collocations.op11_phrase_stripes,
    "op12_gray_simhash": simhash.op12_gray_simhash,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op4_risk_rules": quality.SQL,
    "op7_phrase_index": phrases.SQL,
    "op9_mix_sources": mixing.SQL,
    "op11_phrase_stripes": collocations.SQL,
    "op13_source_divergence": divergence.SQL,
}
