"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licences, media, neardup, ngramjoin, pieces, secrets, sharding, spelling, substrings, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1,
    "op2_pieces": pieces.op2,
    "op3_substrings": substrings.op3,
    "op4_language": language.op4,
    "op5_secrets": secrets.op5,
    "op6_media": media.op6,
    "op7_neardup": neardup.op7,
    "op8_licences": licences.op8,
    "op8_notices": licences.op8_notices,
    "op9_sharding": sharding.op9,
    "op10_decontamination": decontaminate.op10,
    "op11_ngram_join": ngramjoin.op11,
    "op12_whitening": whitening.op12,
    "op13_spelling": spelling.op13,
}
#: For DuckDB; the other queries are tested against brute force, exact round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op3_substrings": substrings.ORACLE_SQL,
    "op7_neardup": neardup.ORACLE_SQL,
    "op8_licences": licences.ORACLE_SQL,
    "op8_notices": licences.NOTICES_SQL,
    "op11_ngram_join": ngramjoin.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
