"""What the operators of this subpackage share.

Functions that run on executors are pickled by value (see ``ship``), so a cluster needs no copy
of this package on its workers. Large intermediate results are written as Parquet below
``spark.checkpoint.dir``; a lost executor costs the rerun of a stage, never of the whole lineage.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: a worker holds a few of them.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ship() -> None:
    """Pickle this subpackage's functions by value."""
    package = sys.modules[__name__.rpartition(".")[0]]
    cloudpickle.register_pickle_by_value(package)


ship()


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks. A worker keeps one operator's: asking for
    another's drops it, so stages of a pipeline don't add up their caches."""
    every = sys.__dict__.setdefault("_texloom_worker", {})
    for other in [k for k in every if k not in (name, "driver")]:
        del every[other]
    return every.setdefault(name, {})


def limit_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session sets its own bounds."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is absent and the master is this machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cache = worker_cache("driver")
        found = cache.setdefault("dir", tempfile.mkdtemp(prefix="texloom-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, read by whoever needs it, lineage cut."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._texloom_path = path
    return found


def discard(table: DataFrame) -> None:
    """Remove the files of a table that `written` made and nothing will read again; other tables stay."""
    if path := table.__dict__.pop("_texloom_path", None):
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: A key of more than one in KEY_SHARE rows is hot. There are at most KEY_SHARE such keys, whatever the input's size.
KEY_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with a table that has each key once and in `n` about how many rows have it; n stays.
    total: the sum of n, where it is known.

    Hot keys are broadcast (at most KEY_SHARE entries), so their rows stay where they are; only rows with other keys,
    none of which has more than its share, are shuffled.
    """
    total = (table.agg(F.sum("n")).first()[0] or 0) if total is None else total
    hot = F.col("n") > total / KEY_SHARE
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~hot).hint("merge"), key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read where the driver is; workers get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def free_columns(df: DataFrame, fields: list[T.StructField], keep: list[str] | None) -> list[str]:
    """Columns of df that stay beside the new fields; a column named as a new field gives way to it."""
    new = {f.name.lower() for f in fields}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in new]


def map_text(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep: list[str] | None = None,
    where: str | None = None,
) -> DataFrame:
    """Append columns computed from a text column, an Arrow batch at a time, without a shuffle.

    make: called once a task; what it returns maps a text column to a column for each field.
    keep: the columns that stay (all by default). where: name of a boolean field; only rows where it is
    true stay and no field is appended (a filter).
    """
    limit_batches(df.sparkSession)
    kept = df.columns if where else free_columns(df, fields, keep)
    own = "__text"
    while own in df.columns:
        own += "_"
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(own))
    schema = T.StructType([source.schema[c] for c in kept] + ([] if where else fields))
    at = [f.name for f in fields].index(where) if where else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            found = work(batch.column(len(kept)))
            if where:
                rows = pa.RecordBatch.from_arrays(columns, names=kept).filter(found[at])
                if rows.num_rows:
                    yield rows
            else:
                yield pa.RecordBatch.from_arrays([*columns, *found], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


#: Most UTF-8 bytes of texts that training takes to the driver.
SAMPLE_BYTES = 64 << 20


def within_bytes(rows: list[tuple], most: int) -> list:
    """Keys of (key, bytes) rows, in their order, as long as all of them together have at most `most` bytes; a row that would
    pass it is left out and smaller ones after it may stay."""
    kept, held = [], 0
    for key, size in rows:
        if held + size <= most:
            kept.append(key)
            held += size
    return kept


def distinct_ids(words: list) -> tuple[np.ndarray, list]:
    """An id for each word, in order of first sight, and the distinct words."""
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


class TailLengths(dict):
    """Last three symbols of a stretch of text -> the lengths of the vocabulary's strings that can end there, longest first."""

    def __init__(self, vocabulary):
        super().__init__()
        self.short = {p for p in vocabulary if len(p) < 3}
        by_tail: dict = {}
        for p in vocabulary:
            if len(p) >= 3:
                by_tail.setdefault(p[-3:], set()).add(len(p))
        self.by_tail = by_tail

    def __missing__(self, tail) -> tuple[int, ...]:
        lengths = set(self.by_tail.get(tail, ())) | {n for n in (1, 2) if len(tail) >= n and tail[-n:] in self.short}
        found = tuple(sorted(lengths, reverse=True))
        if len(self) < 1 << 20:
            self[tail] = found
        return found


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
