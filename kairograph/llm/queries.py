"""Queries of the training-data operators and their SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, decontaminate, licences, linededup, quality, simhash, tokencount, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_kn": quality.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_token_counts": tokencount.op3,
    "op4_license_digests": licences.op4,
    "op5_audio_features": audio.op5,
    "op6_toxicity_kn": toxicity.op6,
    "op7_decontamination": decontaminate.op7,
    "op8_warc": warc.op8,
    "op9_simhash_golay": simhash.op9,
    "op10_line_dedup": linededup.op10,
}

ORACLES: dict[str, str] = {
    "op4_license_digests": licences.OP4_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
}
