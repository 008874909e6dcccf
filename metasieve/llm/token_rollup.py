"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch holds signed changes: an inserted document adds its row and tokens to
the total of its (source, lang, tokenizer), a deleted one subtracts them, a revised one does both. Changes are summed
per key before they are written, so a batch is a few rows, and totals are the sum over the batches.

Each attempt to commit writes its own folder, then renames the batch's marker into place, a file that names the attempt; a
second rename fails. So a batch counts once, whoever commits it and however often; what a lost attempt left is never read.
Folding sums all batches into one base: it writes the sums with the list of the batches in them, then renames the marker of
the next base into place. Readers take the latest base and the batches that it does not list, so they see either all of a fold or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.common import bounded_batches, texts

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens")
#: Columns of a batch.
SCHEMA = ", ".join(f"{k} string" for k in KEYS) + ", n_docs long, n_tokens long"


@lru_cache(maxsize=2)
def _encoding(rank_file: str, pattern: str):
    import tiktoken

    from metasieve.llm.byte_bpe import read_ranks

    return tiktoken.Encoding("rank_file", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})


def count_tokens(docs: DataFrame, rank_file: str, pattern: str, version: str) -> DataFrame:
    """source, lang, tokenizer, n_tokens, n_words (runs without white space) for every row of docs, counted over whole texts.

    Null and empty text: no tokens and no words. Null source or lang: a key of its own. Columns of other names are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(rank_file, pattern)
        for b in batches:
            if b.num_rows:
                rows = texts(b.column(2))
                counts = (pa.array(n, pa.int64()) for n in ([len(encoding.encode_ordinary(t)) for t in rows], [len(t.split()) for t in rows]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts], ["source", "lang", "n_tokens", "n_words"])

    counted = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, "source string, lang string, n_tokens long, n_words long")
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", "n_words")


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Signed changes from counted documents; a revised document is deleted with its old count and inserted anew."""
    signed = [df.select(*KEYS, F.lit(s).alias("sign"), (F.col("n_tokens") * s).alias("n_tokens")) for df, s in ((inserted, 1), (deleted, -1)) if df is not None]
    return signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])


class TokenRollup:
    """A rollup in the folder at path, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        fs, p = self._fs(kind)
        return [x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().startswith(".")] if fs.exists(p) else []

    def _mark(self, marker: str, attempt: str) -> bool:
        """Create a marker that names an attempt; False if another attempt was first."""
        fs, p = self._fs(marker)
        if fs.exists(p):
            return False
        _, whole = self._fs(f"attempts/.{uuid.uuid4().hex}")
        out = fs.create(whole, False)
        out.write(attempt.encode())
        out.close()
        fs.mkdirs(p.getParent())
        return fs.rename(whole, p)  # onto what exists, it fails

    def _attempts(self, markers: list[str]) -> list[str]:
        """The attempts that markers name."""
        if not markers:
            return []
        found = self.spark.read.text([f"{self.path}/{m}" for m in markers], wholetext=True).collect()
        return [f"{self.path}/attempts/{r.value}" for r in found if r.value]

    def _base(self) -> tuple[int, DataFrame | None, set[str]]:
        """(number, sums, batches in them) of the latest base."""
        latest = max(map(int, self._names("bases")), default=0)
        if not latest:
            return 0, None, set()
        at = self._attempts([f"bases/{latest}"])[0]
        return latest, self.spark.read.schema(SCHEMA).parquet(f"{at}/sums"), {r.batch for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect()}

    def is_committed(self, batch_id: str) -> bool:
        fs, p = self._fs(f"commits/{batch_id}")
        return fs.exists(p) or batch_id in self._base()[2]

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Commit a batch of changes under its id; False, and no change, where that id is committed already."""
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id is made of letters, digits, - and _")
        if self.is_committed(batch_id):
            return False
        attempt = f"{batch_id}.{uuid.uuid4().hex}"
        delta = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        delta.write.parquet(f"{self.path}/attempts/{attempt}")
        return self._mark(f"commits/{batch_id}", attempt)

    def batches(self) -> list[str]:
        """The ids of the committed batches, those in the base too."""
        return sorted({*self._names("commits"), *self._base()[2]})

    def _deltas(self, base: DataFrame | None, batches: list[str]) -> DataFrame:
        paths = self._attempts([f"commits/{b}" for b in batches])
        deltas = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        deltas = deltas if base is None else deltas.unionByName(base)
        return deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS)).filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def fold(self) -> int:
        """Sum all committed batches into a new base; gives the number of batches that were not in the old one.

        Their markers and attempts stay until forget(), for readers that took the old base.
        """
        number, base, folded = self._base()
        new = sorted(set(self._names("commits")) - folded)
        if new:
            attempt = f"base.{uuid.uuid4().hex}"
            self._deltas(base, new).coalesce(1).write.parquet(f"{self.path}/attempts/{attempt}/sums")
            self.spark.createDataFrame([(b,) for b in sorted({*folded, *new})], "batch string").coalesce(1).write.parquet(f"{self.path}/attempts/{attempt}/batches")
            if not self._mark(f"bases/{number + 1}", attempt):
                return 0
        return len(new)

    def forget(self) -> None:
        """Delete the markers and attempts of batches that the base holds, once no reader uses an older one."""
        for b in sorted(self._base()[2] & set(self._names("commits"))):
            (at,) = self._attempts([f"commits/{b}"])
            for name in (f"commits/{b}", f"attempts/{at.rsplit('/', 1)[1]}"):
                fs, p = self._fs(name)
                fs.delete(p, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the committed batches; keys whose documents all went are gone."""
        _, base, folded = self._base()
        return self._deltas(base, sorted(set(self._names("commits")) - folded))
