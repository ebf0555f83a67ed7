"""Queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from skyloom.llm import align, bpe, decontaminate, html_text, jaccard, line_dedup, merkle, neighbours, shards, simhash, token_counts, toxicity, url_filter


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_simhash": simhash.op3_simhash,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_shards": shards.op5_shards,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_html_text": html_text.op10_html_text,
        "op11_jaccard": jaccard.op11_jaccard,
        "op12_merkle": merkle.op12_merkle,
        "op13_align": align.op13_align,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a whole query; the others are held against brute force in the tests."""
    import corpus_pipeline

    said = {"op4_decontaminate": decontaminate.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op12_merkle": merkle.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in said.items() if sql}
