"""Inputs and folds of the training-data operators; the shared folder's helpers are the library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from egress.plans.store import new_path, released, shared_dir, shuffle_parts, written

__all__ = ["documents", "fold_of", "new_path", "released", "shared_dir", "shuffle_parts", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and whole text; other columns are not read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
