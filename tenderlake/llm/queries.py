"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, importance, langid, mixing, quality, repair, simhash, suffixdedup, tokenfile, toxicity, warc, webp

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_simhash": simhash.op2_simhash,
    "op3_revisits": warc.op3_revisits,
    "op4_media": webp.op4_media,
    "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_language": langid.op7_language,
    "op8_token_file": tokenfile.op8_token_file,
    "op9_nearest": ann.op9_nearest,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_repair": repair.op11_repair,
    "op12_quality": quality.op12_quality,
    "op13_importance": importance.op13_importance,
}

ORACLE_SQL: dict[str, str] = {"op3_revisits": warc.OP3_SQL}
