"""Bounded samples of labelled documents, for the operators that learn a classifier on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, whole

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """_id, _y: all training rows. Rows without id, and labels other than 0 and 1, are left out; an id labelled twice counts by
    its larger label."""
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    return marked.filter(~held_out("_id"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", brief: Callable[[str], str] | None = None) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels (0/1) of at most per_class training rows of each class, by hash of the id, and the share of label 1.

    The identifiers drawn are at most 2 x per_class, so they are broadcast, and as many texts come to the driver: brief(text),
    worked out where the text lies, and of an id with several texts the least. Rows without id or label, and labels other
    than 0 and 1, are left out; an id labelled twice counts by its larger label.
    """
    marked = training(labels, label, id_col)
    rate = marked.agg(F.avg("_y")).first()[0]
    kinds = [marked.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    drawn = kinds[0].unionByName(kinds[1])
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole(text_col).alias("_t")).join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
    if brief is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([brief(t) for t in batch.column("_t").to_pylist()], pa.string()), batch.column("_y")], names=["_id", "_t", "_y"])

        rows = rows.mapInArrow(run, "_id long, _t string, _y int")
    rows = sorted(rows.collect(), key=lambda r: r["_id"])
    return [r["_t"] for r in rows], np.array([r["_y"] for r in rows], dtype=np.int64), float(rate or 0.0)
