"""How the text tables are read, and names that clash with none of a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.store import fresh_path, settle, shared_dir

__all__ = ["crc32_residue", "fresh_path", "settle", "shared_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_residue(id_col: str, modulus: int):
    """``crc32(id as text) mod modulus``; a null id has residue null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until it is none of ``df``'s columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
