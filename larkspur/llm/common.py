"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK_SET = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), 0)


def _shared(spark: SparkSession) -> str:
    """The shared folder for copies: that of ``spark.checkpoint.dir``, else one in the warehouse, if all machines can reach that."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place, house = sc.getConf().get("spark.checkpoint.dir"), spark.conf.get("spark.sql.warehouse.dir")
        if not place and not sc.master.startswith("local") and house.partition(":/")[0] in ("file", house):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; {house!r} lies on one machine alone")
        sc.setCheckpointDir(place or os.path.join(house, "larkspur-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the shared folder, which outlives any executor."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage at a Parquet table in the shared folder.

    Unlike a checkpoint, which keeps its plan's estimates, the copy has the size
    of its files: estimates of joins multiply, and over many steps they would
    get so long that planning never ends.
    """
    path = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of steps that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when a task ends, its worker gives unused memory back, for it lives on beside the next stages' workers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def free_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def settle(df: DataFrame, *cols) -> DataFrame:
    """``select`` whose results are computed once, whatever later steps ask for.

    A one-element generator stands between the steps: Catalyst neither inlines
    what is below it into lambdas above it, nor pushes filters over it that
    would compute an array again for every element.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.select(F.inline(F.array(F.struct(*cols))))


def sums_before(lengths: str) -> str:
    """SQL: for each element of an array the sum of those before it, in blocks of about the square root of its size."""
    step = f"cast(ceil(sqrt(size({lengths}))) as int)"
    blocks = f"transform(sequence(0, size({lengths}) - 1, {step}), j -> slice({lengths}, j + 1, {step}))"
    return (
        f"flatten(flatten(transform(array({blocks}), bs -> flatten(transform(array(transform(bs, x -> aggregate(x, 0, (a, y) -> a + y))), sums -> "
        "transform(bs, (x, j) -> transform(x, (y, i) -> aggregate(slice(sums, 1, j), 0, (a, z) -> a + z) + aggregate(slice(x, 1, i), 0, (a, z) -> a + z))))))))"
    )
