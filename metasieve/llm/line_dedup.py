"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of (hash, documents, largest doc_id, fresh) sorted by hash and bucketed on it, in the shared folder, so
that runs merge bucket by bucket without a shuffle or a sort. Each new batch of documents is aggregated to a run of its
own; it is merge-anti-joined with the runs that exist (lines of the batch whose hash no run holds are fresh), then joins the
store at level 0. When a level has FANOUT runs they are merged into one run of the next level. A manifest beside the runs
names them, so that a later job can go on with the store.

Each line is fresh in one run, the oldest that holds it. What later runs add to known lines is little, so the totals take
no merge of whole runs: those additions are summed, and each run's fresh lines look them up. Counts and maxima are
additive, so the totals are the same however the corpus was cut into batches. The documents then meet the lines that go by
hash, with the most frequent lines dealt over salts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve.llm.common import scratch, stored

#: Lines shorter than this many code points never go.
MIN_LENGTH = 40
#: Documents that must hold a line before its copies go.
MIN_DOCS = 5
#: Runs of a level before they are merged into the next.
FANOUT = 4
#: Batches that a whole table is added in.
BATCHES = 5
#: Documents of a frequent line for each of its salts, of which a line has one for each shuffle partition at most.
SALT_DOCS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space of the contract: fixed values.
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased (lower() does that faster where all is ASCII)."""
    t = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, h1, h2): each document's distinct line keys of min_length code points or more, hashed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_length)
    return docs.select("doc_id", F.inline(F.array_distinct(F.transform(keys, _hash))))


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Bucketed tables count as sorted here: each bucket of a run is one sorted file, which its task has written whole."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """A store of levelled sorted runs in a folder that driver and executors share.

    add() takes the line hashes of a batch of documents; common() gives the lines that enough documents hold. Runs are
    bucketed tables, with as many buckets as the session has shuffle partitions unless told otherwise. A store that exists
    at the folder is opened as its last manifest has it; files that no manifest names are left over from a lost job.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = (folder or scratch(spark, "line-runs")).rstrip("/")
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: dict[int, list[str]] = {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        fs, path = self._fs("manifests")
        self._version = max((int(x.getPath().getName()) for x in fs.listStatus(path)), default=0) if fs.exists(path) else 0
        if self._version:
            kept = spark.read.schema("level int, run string, buckets int").json(f"{self.folder}/manifests/{self._version}").orderBy("level", "run").collect()
            for r in kept:
                self.buckets = r.buckets
                self.levels.setdefault(r.level, []).append(r.run)
            for run in self.tables():
                spark.sql(f"CREATE TABLE {self._table(run)} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _table(self, run: str) -> str:
        return f"{self.name}_{run}"

    def run(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def tables(self) -> list[str]:
        return [t for level in sorted(self.levels) for t in self.levels[level]]

    def _write(self, rows: DataFrame, level: int) -> str:
        run = f"l{level}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.folder}/{run}").saveAsTable(self._table(run))
        return run

    def _commit(self, levels: dict[int, list[str]]) -> None:
        """The manifest is renamed into place whole; then what it no longer names goes."""
        gone = set(self.tables()) - {t for runs in levels.values() for t in runs}
        rows = [(level, t, self.buckets) for level, runs in levels.items() for t in runs]
        self._version += 1
        fs, path = self._fs(f"manifests/{self._version}")
        attempt = f".{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "level int, run string, buckets int").coalesce(1).write.json(f"{self.folder}/{attempt}")
        fs.mkdirs(path.getParent())
        if not fs.rename(self._fs(attempt)[1], path):
            raise RuntimeError(f"another job has written {path}")
        self.levels = levels
        self._drop(gone)

    def _drop(self, runs) -> None:
        for t in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(t)}")
            fs, path = self._fs(t)
            fs.delete(path, True)

    def run_of(self, hashes: DataFrame) -> DataFrame:
        """(h1, h2, n_docs, last_id, fresh) of a batch.

        Combining precedes the shuffle, so a line that a third of the documents hold travels once per task. The shuffle
        deals rows as the runs are bucketed, on both halves of the hash: a bucket is written by one task, and the
        merge-anti-join with each run, here as a join that marks what it finds, shuffles neither side again.
        """
        run = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            run = run.repartition(self.buckets, "h1", "h2")
        known = F.lit(False)
        for k, t in enumerate(self.tables()):
            run = run.join(self.run(t).select("h1", "h2", F.lit(True).alias(f"_in{k}")).hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(F.col(f"_in{k}"), F.lit(False))
        return run.select("h1", "h2", "n_docs", "last_id", (~known).alias("fresh"))

    def fresh_lines(self, hashes: DataFrame) -> DataFrame:
        """The rows of a batch whose line no run of the store holds, as an incremental filter would keep them."""
        return reduce(lambda left, t: left.join(self.run(t).select("h1", "h2"), ["h1", "h2"], "left_anti"), self.tables(), hashes)

    def add(self, hashes: DataFrame) -> str:
        """Add the line hashes (doc_id, h1, h2) of a batch as a run of level 0, compact full levels; returns the run."""
        with sorted_buckets(self.spark):
            run = self._write(self.run_of(hashes), 0)
            levels = {k: [*v] for k, v in self.levels.items()}
            levels.setdefault(0, []).append(run)
            self._commit(levels)
            level = 0
            while len(self.levels.get(level, ())) >= self.fanout:
                levels = {k: [*v] for k, v in self.levels.items()}
                old = levels.pop(level)
                levels.setdefault(level + 1, []).append(self._write(merged([self.run(t) for t in old]), level + 1))
                self._commit(levels)
                level += 1
        return run

    def common(self, min_docs: int = 1) -> DataFrame:
        """(h1, h2, n_docs, last_id) of the lines that min_docs documents or more hold, over all runs."""
        runs = [self.run(t) for t in self.tables()]
        if not runs:
            return self.spark.createDataFrame([], RUN).drop("fresh")
        known = reduce(DataFrame.unionByName, [r.filter("NOT fresh") for r in runs])
        known = known.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.sum("n_docs").alias("m"), F.max("last_id").alias("l"))
        out = []
        for r in runs:
            j = r.filter("fresh").join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
            out.append(j.select("h1", "h2", (F.col("n_docs") + F.coalesce("m", F.lit(0))).alias("n_docs"), F.greatest("last_id", "l").alias("last_id")).filter(F.col("n_docs") >= min_docs))
        return reduce(DataFrame.unionByName, out)

    def drop(self) -> None:
        """The store and its folder go."""
        self._drop(self.tables())
        fs, path = self._fs("")
        fs.delete(path, True)
        self.levels = {}


#: Columns of a run.
RUN = "h1 bigint, h2 bigint, n_docs bigint, last_id bigint, fresh boolean"


def merged(runs: list[DataFrame]) -> DataFrame:
    """Runs merged bucket by bucket: full outer merge joins on the hash, which need no shuffle of either side."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n_docs").alias("m"), F.col("last_id").alias("l"), F.col("fresh").alias("f"))
        j = a.join(b.hint("merge"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "full_outer")
        return j.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n_docs"), F.greatest("last_id", "l").alias("last_id"), (F.coalesce("fresh", F.lit(False)) | F.coalesce("f", F.lit(False))).alias("fresh"))

    return reduce(two, runs)


def batches_of(hashes: DataFrame, batches: int) -> list[DataFrame]:
    """hashes cut into ranges of doc_id, the latest first, which cover all rows; null ids go with the first."""
    low, high = hashes.agg(F.min("doc_id"), F.max("doc_id")).first()
    if batches < 2 or low is None or not isinstance(low, int):
        return [hashes]
    cuts = sorted({low + (high - low + 1) * k // batches for k in range(1, batches)} - {low})
    edges = [None, *cuts, None]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        keep = F.lit(True)
        if a is not None:
            keep = keep & (F.col("doc_id") >= a)
        if b is not None:
            keep = keep & (F.col("doc_id") < b)
        out.append(hashes.filter(keep | F.col("doc_id").isNull() if b is None else keep))
    return out[::-1]


def held(hashes: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, h1, h2, last_id of the line hashes whose line is among the common ones (h1, h2, n_docs, last_id).

    The lines that most documents hold, one for each shuffle partition at most, are dealt over salts by how many do; a line
    beyond that list has less than a partition's share of all rows.
    """
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.least(F.ceil(F.col("n_docs") / SALT_DOCS), F.lit(parts)).cast("int")
    large = common.filter(F.col("n_docs") > SALT_DOCS).orderBy(F.col("n_docs").desc(), "h1", "h2").limit(parts).select("h1", "h2", salts.alias("salts"))
    dealt = lambda df: df.join(F.broadcast(large), ["h1", "h2"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = dealt(hashes).withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    lines = dealt(common).select("h1", "h2", "last_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    return rows.join(lines, ["h1", "h2", "s"]).select("doc_id", "h1", "h2", "last_id")


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of docs (columns doc_id, an integer, and text), texts without repeated lines.

    A line whose key has min_length code points and is in min_docs documents goes from all of them but the one with the
    largest doc_id. Null and empty texts have one empty line, which stays, and give an empty text. Rows that repeat a
    doc_id are documents of their own and share their verdict; a null doc_id is smaller than any other. Runs given are
    added to, so lines of earlier batches count. Keys are compared by 128-bit hashes. An empty table gives none.
    """
    own = runs is None
    runs = runs or LineRuns(docs.sparkSession)
    hashes = stored(line_hashes(docs, min_length), "line-hashes")
    for batch in batches_of(hashes, batches):
        runs.add(batch)
    common = stored(runs.common(min_docs), "line-common")
    if own:
        runs.drop()
    gone = held(hashes, common).filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    # collect_set has no more entries than the document has distinct lines
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    joined = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~((F.length(x) >= min_length) & F.array_contains(F.col("_gone"), _hash(line_key(x))))))
    cut = joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("_kept"))
    return cut.select("doc_id", F.concat_ws("\n", "_kept").alias("text"), "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"))
