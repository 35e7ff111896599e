"""Helpers of the operators: shared stage tables, shipping to the workers, text columns as arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import siftguard
from siftguard.session import ship_packages, work_dir

#: Text bytes that one round of array work takes at a time (one longer document is a round of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers."""
    ship_packages(spark, siftguard)


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write a stage table below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a lost executor costs at most the tasks of the running stage. The
    setting is read from the session; where it is unset, a local folder stands in for it on a single machine only.
    """
    spark = frame.sparkSession
    path = work_dir(spark, name)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stage_path = path
    return out


def dropped(*stages: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for stage in stages:
        jvm = stage.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(stage.stage_path)
        path.getFileSystem(stage.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Have the driver collect its garbage. Only then Spark removes shuffle files and broadcasts of steps that are through, and the driver keeps their plans as long."""
    spark._jvm.System.gc()


def ascii_lower(text):
    """Lower-case A-Z and nothing that matters besides, as an expression.

    ``lower`` maps two other characters onto ASCII letters; they are replaced first by
    characters of the same kind, so no ASCII word appears that was not there.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most`` bytes each, and no more than ``rows`` rows."""
    start, end = 0, len(offsets) - 1
    while start < end:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        stop = min(stop, end, start + rows if rows else end)
        yield start, stop
        start = stop


def release() -> None:
    """Hand freed memory back to the system; the pools of a worker would keep many megabytes between batches, and idle workers for good."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        library = ctypes.CDLL("libc.so.6")
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of bounded text size, and of bounded row number: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_arrays(batch.column(text))
        for start, stop in slices(offsets, most, rows):
            yield batch.slice(start, stop - start), data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]
        del batch, data
        release()


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the text as zstd bytes, for joins that have to move whole texts."""
    schema = docs.select(*keep).schema.add("ztext", "binary").add("n_bytes", "long")

    def pack(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            columns = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary()),
                 pa.array([len(x) for x in texts], pa.int64())], [*keep, "ztext", "n_bytes"])

    return docs.select(*keep, "text").mapInArrow(pack, schema)


def unpacked(ztext: list[bytes], n_bytes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts that ``packed`` made."""
    codec = pa.Codec("zstd")
    raw = b"".join(codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(ztext, n_bytes, strict=True))
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(n_bytes, dtype=np.int64)]).astype(np.int64)


def unused(name: str, frame: DataFrame) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id, parts: int, part: int):
    """Whether crc32(doc_id as text) mod ``parts`` is ``part``; an absent id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
