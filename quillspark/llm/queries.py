"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from quillspark.llm import bpe, decontaminate, licenses, lm, media, pii, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_warc": warc.op2_warc,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_lm_score": lm.op10_lm_score,
}

ORACLES = {
    "op3_license_scan": licenses.oracle(),
    "op4_secret_scan": secrets.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
}
