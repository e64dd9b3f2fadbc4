"""Intermediate tables and Arrow batches shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from pagemill.session import materialize, shared_folder
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

#: Bytes of text worked on at once in a Python worker; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """*df* as a Parquet table in the shared folder, read back: it outlives lost executors."""
    if compression is None:
        return materialize(df, f"llm-{name}")
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast value that needs no copy of its classes on the executors: it travels pickled by
    value, which a plain broadcast does not do. A task unpickles it once."""

    def __init__(self, spark: SparkSession, value):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = value

    def __getstate__(self):
        return {"_held": self._held}

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = cloudpickle.loads(self._held.value)
        return self._value

    def unpersist(self) -> None:
        self._held.unpersist()


def unused(columns: list[str], name: str) -> str:
    """*name*, or a longer one if *columns* have it, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def folders(df: DataFrame) -> list[str]:
    """Folders of the files behind *df*, for :func:`dropped`."""
    return sorted({f.rpartition("/")[0] for f in df.inputFiles()})


def dropped(df: DataFrame) -> None:
    """Deletes the files of a :func:`stored` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in folders(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose *column* holds about *limit* bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start = i
                held = 0
            held += size + 64
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(column).to_pylist()
