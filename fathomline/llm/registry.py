"""The queries of this subpackage and the SQL that states the same results."""

from . import bpe, chat, divergence, html, interaction, langid, lm, mixing, pii, quality, simhash, toxicity, winnow

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_toxicity_scores": toxicity.op2_toxicity_scores,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_html_main_text": html.op4_html_main_text,
    "op5_simhash_components": simhash.op5_simhash_components,
    "op6_chat_format": chat.op6_chat_format,
    "op7_pii_pseudonyms": pii.op7_pii_pseudonyms,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_bpe_roundtrip": bpe.op9_bpe_roundtrip,
    "op10_winnow_fingerprints": winnow.op10_winnow_fingerprints,
    "op11_language_id": langid.op11_language_id,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_filter_interactions": interaction.op13_filter_interactions,
}

#: Where SQL can express the whole result on whole tables.
ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_filter_interactions": interaction.OP13_SQL,
}
