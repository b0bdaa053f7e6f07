"""Members of tar archives as rows."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBER = "path string, member string, stem string, content binary"


def tar_members(files: DataFrame, path: str = "path", content: str = "content", size: int = 256) -> DataFrame:
    """path, member, stem (the member's file name up to its first dot), content: one row a regular member, compressed archives too.

    files: binary files, as spark.read.format("binaryFile") gives them; an archive is a row, so it is read as a stream within
    one task and leaves it in batches of `size` members. A damaged archive gives the members before the damage.
    """
    names = [c.split()[0] for c in MEMBER.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for name, body in _members(data.as_py() or b""):
                    rows.append((p, name, name.rsplit("/", 1)[-1].split(".", 1)[0], body))
                    if len(rows) == size:
                        yield out(rows)
                        rows = []
                yield out(rows)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, MEMBER)


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as tar:
            for info in tar:
                body = tar.extractfile(info) if info.isfile() else None
                if body is not None:
                    yield info.name, body.read()
    except (tarfile.TarError, EOFError, OSError):
        return


def wanted_members(files: DataFrame, wanted: DataFrame, stem: str = "md5") -> DataFrame:
    """Members whose stem is wanted, the first (by path and member) of each stem. The join spreads both sides by stem."""
    have = tar_members(files).join(wanted.select(F.col(stem).alias("stem")).distinct(), "stem", "left_semi")
    return have.groupBy("stem").agg(F.min_by(F.struct("path", "member", "content"), F.struct("path", "member")).alias("m")).select(F.col("stem").alias(stem), "m.*")
