"""The driver queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, chat, fim, jaccard, licences, lm, media, packing, pqcodes, quality, suffixes, wordbpe

QUERIES = {
    f.__name__: f
    for f in (
        ann.op1_ann_graph,
        bpe.op2_byte_bpe,
        jaccard.op3_jaccard_join,
        packing.op4_packing,
        licences.op5_license_scan,
        lm.op6_lm_trie,
        media.op7_audio_features,
        suffixes.op8_suffix_dedup,
        chat.op9_chat_rotation,
        quality.op10_quality_classifier,
        fim.op11_fim_units,
        wordbpe.op12_word_bpe,
        pqcodes.op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op9_chat_rotation": chat.OP9_SQL,
    "op11_fim_units": fim.OP11_SQL,
    "op13_vector_codes": pqcodes.OP13_SQL,
}
