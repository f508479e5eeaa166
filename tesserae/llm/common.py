"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import io
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on a local
    master, as in tests, one is made and set; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tesserae-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, where it isn't installed; once a context."""
    sc = spark.sparkContext
    # Long texts are many bytes a row; where the session says nothing, fewer rows go to a worker at a time.
    if int(spark.conf.get(BATCH)) == 10_000:
        spark.conf.set(BATCH, 2000)
    if getattr(sc, "_tesserae_shipped", False):
        return
    top, held = Path(__file__).resolve().parents[2], io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for path in sorted((top / "tesserae").rglob("*.py")):
            out.write(path, path.relative_to(top))
    target = Path(tempfile.mkdtemp(prefix="tesserae-code-")) / "tesserae_code.zip"
    target.write_bytes(held.getvalue())
    sc.addPyFile(str(target))
    sc._tesserae_shipped = True


#: What a Python worker holds beyond a task, by operator, as functions that drop it.
_HELD: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def holds(owner: str, drop: Callable[[], None]) -> None:
    _HELD[owner] = drop


def claim(owner: str) -> None:
    """To be called by a task: what other operators left in this worker, which Spark reuses, goes."""
    global _owner
    if _owner == owner:
        return
    _owner = owner
    for other, drop in _HELD.items():
        if other != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    # Freed memory goes back to the system where the C library can do that.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tesserae-llm/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends at files that outlive any executor.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: ``narrowed(df, id="doc_id")``.

    What else the table holds, clashing names included, can't matter afterwards.
    """
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def column_or_null(df: DataFrame, name: str | None, kind: str):
    """The column cast to ``kind``, or a typed null if the table has no such column."""
    if name is not None and name in df.columns:
        return df[name].cast(kind)
    return F.lit(None).cast(kind)


#: Rows of a few dozen bytes up to which ``without`` broadcasts what it removes.
BROADCAST_ROWS = 200_000


def without(df: DataFrame, gone: DataFrame, condition) -> DataFrame:
    """``df`` without the rows that ``gone``, a narrow table, matches; ``df`` keeps its columns.

    Few rows to remove are broadcast, after they have been counted, and ``df`` isn't
    shuffled; with more both sides are.
    """
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return df.join(gone, condition, "left_anti")
