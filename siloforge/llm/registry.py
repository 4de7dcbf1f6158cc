"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siloforge.llm import chat, decontaminate, linededup, mixing, neighbours, quality, sharding, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1,
    "op2_urls": urls.op2,
    "op3_neighbours": neighbours.op3,
    "op4_chat": chat.op4,
    "op5_line_dedup": linededup.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_mix": mixing.op7,
    "op8_shard": sharding.op8,
    "op9_simhash": simhash.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_urls": urls.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_mix": mixing.ORACLE,
    "op10_warc": warc.ORACLE,
}
