"""The subpackage's queries, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_join, exact_dedup, line_dedup, mixing, ngram_join, packing, periodic_runs, pii, quality, toxicity, url_filter, warc, whitening
from .shared import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_warc_derivatives": lambda s, d: warc.derivatives(warc.responses(read(s, d, "pages"))),
    "op2_pii": lambda s, d: pii.digest(read(s, d, "documents")),
    "op3_ngram_join": lambda s, d: ngram_join.near_groups(read(s, d, "documents")),
    "op4_embedding_join": lambda s, d: embedding_join.near_vectors(read(s, d, "embeddings")),
    "op5_mixing": lambda s, d: mixing.taken(mixing.mix(read(s, d, "documents"))).drop("row"),
    "op6_url_filter": lambda s, d: url_filter.judge(read(s, d, "pages").select("page_id", "url"), url_filter.RULES).drop("url"),
    "op7_line_dedup": lambda s, d: line_dedup.drop_repeated_lines(read(s, d, "documents")),
    "op8_quality": lambda s, d: quality.judge(read(s, d, "documents"), read(s, d, "labels")),
    "op9_exact_dedup": lambda s, d: exact_dedup.exact_groups(read(s, d, "documents")),
    "op10_packing": lambda s, d: packing.pack_documents(read(s, d, "documents")),
    "op11_periodic_runs": lambda s, d: periodic_runs.digest(read(s, d, "documents")),
    "op12_toxicity": lambda s, d: toxicity.judge(read(s, d, "documents"), read(s, d, "labels")).drop("matches"),
    "op13_whitening": lambda s, d: whitening.whitening(read(s, d, "embeddings")),
}

ORACLE: dict[str, str] = {
    "op1_warc_derivatives": warc.ORACLE,
    "op2_pii": pii.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_embedding_join": embedding_join.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
