"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bilstm_crf, bpe_segment_tree, byte_cnn, fuzzy_lines, perspectives, simhash_golay, string_tiling, topk_norm, toxic_lexicon, warc_revisits


def queries() -> dict:
    return {
        "op1_fuzzy_lines": fuzzy_lines.op1_query,
        "op2_warc_revisits": warc_revisits.op2_query,
        "op3_norm_topk": topk_norm.op3_query,
        "op4_simhash_golay": simhash_golay.op4_query,
        "op5_perspectives": perspectives.op5_query,
        "op6_toxic_lexicon": toxic_lexicon.op6_query,
        "op7_byte_cnn": byte_cnn.op7_query,
        "op8_bpe_segment_tree": bpe_segment_tree.op8_query,
        "op9_bilstm_crf": bilstm_crf.op9_query,
        "op10_string_tiling": string_tiling.op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_revisits": warc_revisits.OP2_SQL,
        "op3_norm_topk": topk_norm.OP3_SQL,
        "op5_perspectives": perspectives.OP5_SQL,
    }
