"""Operators that add columns to whole rows, whatever the rows' columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from penumbra.llm.words import slices


def _added(batches: Iterator[pa.RecordBatch], text_at: int, names: list[str], slice_bytes: int, score: Callable) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, f"c{text_at}", slice_bytes):
        if not batch.num_rows:
            continue
        made = score(batch.column(text_at))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(made[n] for n in names)], names=[*batch.schema.names, *names])


def with_text_columns(df: DataFrame, text_col: str, added_ddl: str, score: Callable[[pa.Array], dict[str, pa.Array]], slice_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``df``, then the columns that ``score`` makes from the texts of a slice.

    ``score`` runs in tasks on at most ``slice_bytes`` of text, or one row, at a
    time. An added column replaces a column of its name. Nothing is shuffled.
    """
    added = StructType.fromDDL(added_ddl)
    fields = [f for f in df.schema.fields if f.name not in added.names]
    inner = df.select(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(fields)))
    schema = StructType([*(StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)), *added.fields])
    text_at = [f.name for f in fields].index(text_col)
    out = inner.mapInArrow(partial(_added, text_at=text_at, names=added.names, slice_bytes=slice_bytes, score=score), schema)
    return out.toDF(*(f.name for f in fields), *added.names)
