"""Bounded samples of labelled rows, and models that one task fits on them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 62


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, class_col: str, max_per_class: int, most_classes: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, class) of at most ``max_per_class`` ids of each class.

    ``labels`` holds ids and classes, and ``learn`` says which of its rows may
    be learned from. Ids are taken by the least hash; null ids, classes and
    texts are left out, and of rows that share an id the least text counts. Only
    the picked ids and the classes reach the driver. More than ``most_classes``
    classes are an error, never cut.
    """
    types = dict(labels.dtypes)
    rows = labels.filter(learn).select(F.col(id_col).alias("id"), F.col(class_col).alias("class")).dropna()
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(_STEPS)))
    counts = rows.groupBy("class").count().limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    spark = docs.sparkSession
    limits = [(r["class"], int(min(1.0, (1.2 * max_per_class + 20) / r["count"]) * _STEPS)) for r in counts]  # a little more than needed; the rest is cut below
    below = spark.createDataFrame(limits, f"class {types[class_col]}, most long")
    near = rows.join(F.broadcast(below), "class").filter("h < most").select("h", "id", "class").distinct()  # most_classes rows at most
    picked, per_class = [], {}
    for r in sorted(near.collect(), key=lambda r: (r["h"], r["id"], str(r["class"]))):
        per_class[r["class"]] = per_class.get(r["class"], 0) + 1
        if per_class[r["class"]] <= max_per_class:
            picked.append((r["id"], r["class"]))
    ids = spark.createDataFrame(picked, f"id {types[id_col]}, class {types[class_col]}")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    met = texts.join(F.broadcast(ids), "id")  # as many ids as the sample has rows
    return met.groupBy("id", "class").agg(F.min("text").alias("text")).select("text", "class")


def _fit(batches: Iterator[pa.RecordBatch], fit: Callable[[list[str], list], object]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((t, c) for b in batches for t, c in zip(b.column("text").to_pylist(), b.column("class").to_pylist(), strict=True)), key=lambda r: (r[0], str(r[1])))
    model = fit([t for t, _ in rows], [c for _, c in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fitted(sample: DataFrame, fit: Callable[[list[str], list], object]):
    """``fit(texts, classes)`` of a bounded sample (text, class), in one task; only the model reaches the driver."""
    made = sample.repartition(1).mapInArrow(partial(_fit, fit=fit), "model binary").first()
    return fit([], []) if made is None else pickle.loads(bytes(made["model"]))
