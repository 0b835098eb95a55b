"""The thin queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query, module, function, tables.
_OPERATORS = (
    ("op1_best_fit_packing", "packing", "op1", ("documents",)),
    ("op2_exact_dedup", "exact_dedup", "op2", ("documents",)),
    ("op3_simhash", "simhash", "op3", ("documents",)),
    ("op4_pii", "pii", "op4", ("documents",)),
    ("op5_toxicity", "toxicity", "op5", ("documents", "labels")),
    ("op6_embedding_dedup", "embedding_dedup", "op6", ("embeddings",)),
    ("op7_line_dedup", "line_dedup", "op7", ("documents",)),
    ("op8_mixing", "mixing", "op8", ("documents",)),
    ("op9_language_id", "language_id", "op9", ("documents",)),
    ("op10_url_filter", "url_filter", "op10", ("pages",)),
    ("op11_centroids", "centroids", "op11", ("embeddings",)),
    ("op12_token_files", "token_files", "op12", ("documents",)),
    ("op13_whitening", "whitening", "op13", ("embeddings",)),
)


def _query(module: str, function: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply = getattr(import_module(f"lynceus.llm.{module}"), function)
        return apply(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run as pipeline

    return {"pipeline": pipeline} | {name: _query(*rest) for name, *rest in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL
    from lynceus.llm.centroids import OP11_SQL
    from lynceus.llm.embedding_dedup import OP6_SQL
    from lynceus.llm.exact_dedup import OP2_SQL
    from lynceus.llm.line_dedup import OP7_SQL
    from lynceus.llm.url_filter import oracle_sql as op10_sql

    out = {"op2_exact_dedup": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_url_filter": op10_sql(), "op11_centroids": OP11_SQL}
    return out | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
