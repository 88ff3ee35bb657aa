"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from millrace.llm import centroids, decontaminate, extract, langid, middle, mixing, neardup, quality, tokenstore, toxicity, vecdup, warc, webp


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_warc": warc.op2_warc,
        "op3_quality": quality.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_mixing": mixing.op5_mixing,
        "op6_extract": extract.op6_extract,
        "op7_tokens": tokenstore.op7_tokens,
        "op8_neardup": neardup.op8_neardup,
        "op9_langid": langid.op9_langid,
        "op10_webp": webp.op10_webp,
        "op11_middle": middle.op11_middle,
        "op12_vectors": vecdup.op12_vectors,
        "op13_lloyd": centroids.op13_lloyd,
    }


def oracle_sql():
    return {
        "op2_warc": warc.OP2_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op11_middle": middle.OP11_SQL,
        "op12_vectors": vecdup.OP12_SQL,
        "op13_lloyd": centroids.OP13_SQL,
    }
