"""From raw documents to packed sequences: each stage works on all that its predecessor kept.

Documents that the quality classifier rejects go; of equal texts one stays, and of each class of near duplicates one;
documents that share a window with the benchmark go; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import decontamination, exact_dedup, near_duplicates, packing, quality
from skysift.llm.shared import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality.clean),
    ("exact_dedup", exact_dedup.clean),
    ("near_duplicates", near_duplicates.clean),
    ("decontamination", decontamination.clean),
    ("packing", packing.packed),
]

#: The classifier is trained and the packing searched: neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
