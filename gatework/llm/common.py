"""What the operators share: tables, durable intermediate results, and fixed character sets."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word and case rules of the contracts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Tables that end with the scratch they were written in, innermost last.
_scratches: list[list[str]] = []


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """df, computed once into a table in the shared folder: lineage ends there, and losing executors loses nothing.
    Within a scratch the table ends with it; one that is kept ends with the scratch around that, if any."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    if len(_scratches) > keep:
        _scratches[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what was written within. What is returned from it must rest on kept tables only."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as none of df's columns needs."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 16 << 20


def slices(batches, column: str, most: int = SLICE_BYTES):
    """Cuts an executor's stream of Arrow batches into pieces of about `most` bytes in `column`, and joins small ones.

    A row is never cut, so only a text that is itself larger makes a larger piece.
    """
    held, size = [], 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < n:
            room = most - size + (int(ends[start - 1]) if start else 0)
            stop = max(int(np.searchsorted(ends, room, "right")), start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - (int(ends[start - 1]) if start else 0)
                start = stop
            if start < n or size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


def pieces_of(df: DataFrame, column: str, most: int) -> int:
    """How many pieces of about `most` bytes df's texts make, so that a piece is as large for any input."""
    size = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-size // most))


#: Rows and bytes of an Arrow batch, so that a batch of long texts fits in an executor beside the JVM.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def over_texts(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow for wide rows: small batches, and freed memory given back to the machine after each task."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the worker process, so later tasks find what earlier ones made."""
    module = sys.modules.setdefault("gatework_worker_cache", types.ModuleType("gatework_worker_cache"))
    return module.__dict__.setdefault(name, {})


def ragged(starts, counts):
    """The indexes of all runs start, start + 1, ... of the given counts, laid end to end."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts) + np.arange(total)


def distinct(values):
    """np.unique by sorting, which is much faster on integers."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
