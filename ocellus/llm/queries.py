"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from ocellus.llm import elias, hilbert, langid, mixing, neardup, ngram, ogg, packing, substring, warczip


def queries() -> dict:
    return {
        "op1_ogg_media": ogg.op1_ogg_media,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_hilbert_ann": hilbert.op3_hilbert_ann,
        "op4_language_id": langid.op4_language_id,
        "op5_mix_to_targets": mixing.op5_mix_to_targets,
        "op6_deleted_interpolation": ngram.op6_deleted_interpolation,
        "op7_elias_fano_ids": elias.op7_elias_fano_ids,
        "op8_lsh_forest": neardup.op8_lsh_forest,
        "op9_warc_zip": warczip.op9_warc_zip,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_to_targets": mixing.sql(), "op2_substring_dedup": substring.OP2_SQL, "op9_warc_zip": warczip.OP9_SQL}
