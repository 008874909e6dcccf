"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; with the byte bound below it keeps a worker's memory flat.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Characters of texts that are worked on together.
PORTION = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master. On a cluster it is an error, since each executor would
    write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_metasieve_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="metasieve-")
            spark.sparkContext._metasieve_shared = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/metasieve/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any letter case."""
    return f"__{name}_{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, sizes are known."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python operators planned from here on, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def portions(rows: list[str], size: int = PORTION) -> Iterator[list[str]]:
    """rows in portions of about size characters, or one longer row."""
    held, n = [], 0
    for t in rows:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Ragged:
    """Values of different lengths behind one another, to be laid out by number."""

    def __init__(self, values: list[bytes], kind: type = np.uint8):
        self.data = np.frombuffer(b"".join(values), kind)
        self.sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.data.itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    def laid_out(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these numbers in turn, and where each run of numbers, which stop at ends, stops among them."""
        size = self.sizes[numbers]
        stop = np.cumsum(size)
        place = np.repeat(self.starts[numbers] - stop + size, size)
        place += np.arange(len(place))
        return self.data[place], np.r_[0, stop][ends]


def split_spans(rows: list[str], lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct spans between spaces, the number of each span of all rows in turn, where each row's spans stop).

    With lower, A-Z are lower-cased first.
    """
    column = pa.array(rows, pa.large_string())
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.split_pattern(column, " ")
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()[1:]


def is_held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as the empty text, whose remainder is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blob(path: str):
    """(filesystem, path) of a URI or local path, for whole files that Spark's writers have no format for."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
