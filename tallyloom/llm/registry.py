"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.chat_windows import op13_chat_format
from tallyloom.llm.common import found_by_workers
from tallyloom.llm.decontamination import OP5_SQL, op5_decontamination
from tallyloom.llm.html_extract import op7_html_extract
from tallyloom.llm.language_id import op4_language_id
from tallyloom.llm.licenses import op2_licenses
from tallyloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from tallyloom.llm.packing import op1_packing
from tallyloom.llm.ppm import op8_lm_scoring
from tallyloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from tallyloom.llm.simhash import op10_simhash
from tallyloom.llm.topk import OP3_SQL, op3_topk
from tallyloom.llm.url_filter import op6_url_filter
from tallyloom.llm.whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found_by_workers(spark)
        return query(spark, sf_dir)

    return run


def llm_queries() -> dict[str, Query]:
    return {name: _ready(query) for name, query in _QUERIES.items()}


_QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_topk": op3_topk,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_html_extract": op7_html_extract,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op3_topk": OP3_SQL,
        "op5_decontamination": OP5_SQL,
        "op9_line_dedup": OP9_SQL,
        "op11_prefix_trie": OP11_SQL,
    }
