"""Shared helpers: table reads, lineage cuts and the learning split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.sources.shared import cut, shared_dir, table

__all__ = ["SPACE", "cut", "fold", "held_out", "only", "read", "shared_dir", "table"]

#: ASCII white space as the contracts write it.
SPACE = r"\x20\x09-\x0D"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those an operator adds."""
    return df.select(*names)
