"""Queries of the text operators, with SQL where SQL can express them."""

from . import cross_align, decontaminate, exact_dedup, language_id, line_dedup, merkle, near_dedup, packing, records, secret_scan, suffix_dedup, superkmers, warc

QUERIES = {
    "op1_secrets": secret_scan.op1_secrets,
    "op2_token_records": records.op2_token_records,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_packing": packing.op8_packing,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_warc": warc.op10_warc,
    "op11_superkmers": superkmers.op11_superkmers,
    "op12_cross_align": cross_align.op12_cross_align,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_superkmers": superkmers.OP11_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
