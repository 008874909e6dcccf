"""Exact deduplication by skew-safe combining.

Texts are equal when identical after replacing each run of ASCII white space by one space. A first pass counts digests alone,
with partial sums; its largest groups, one for each shuffle partition at most, are dealt over salts by their size. A group
beyond that list holds less than a partition's share of all rows. Copies are then merged in three steps, each comparing the
full normalised content beside the digest: Spark's map-side combine merges the copies of a task, the salted groups merge what
tasks of one salt hold, and the salt winners merge globally. The rows meet their winner by digest, content and salt again,
with the winner of a large group once for each of its salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group for each of its salts, of which a group has one for each shuffle partition at most.
SALT_ROWS = 1000
#: White space, as in the contract: fixed values.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column | str) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def digest(t: Column) -> Column:
    """sha256, told to be never null, so that joins need not filter by it."""
    return F.coalesce(F.sha2(t, 256), F.lit(""))


def large_groups(digests: DataFrame, salt_rows: int) -> DataFrame:
    """d, salts of the largest groups of digests (column d): a row for each shuffle partition at most, so it can be broadcast."""
    parts = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = digests.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > salt_rows)
    return counted.orderBy(F.col("n").desc(), "d").limit(parts).select("d", F.least(F.ceil(F.col("n") / salt_rows), F.lit(parts)).cast("int").alias("salts"))


def classified(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """row (a struct of all columns of docs), id, t (normalised text), d (its sha256), keep_id, group_size of every row.

    keep_id is the smallest doc_id of the group; null ids count in group_size and name only a group of nulls. Different
    texts with one digest stay apart, since the content is part of every grouping and join key. Rows alike in id and text
    have one salt.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), normalised("text").alias("t"))
    rows = rows.withColumn("d", digest(F.col("t")))
    large = large_groups(docs.select(digest(normalised("text")).alias("d")), salt_rows)
    rows = rows.join(F.broadcast(large), "d", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    salted = rows.groupBy("d", "s", "t").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"), F.first("salts").alias("salts"))
    repeated = salted.filter("c > 1 OR salts > 1")
    winners = repeated.groupBy("d", "t").agg(F.min("id").alias("keep_id"), F.sum("c").alias("group_size"), F.first("salts").alias("salts"))
    winners = winners.select("d", "t", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    found = rows.select("row", "id", "t", "d", "s").join(winners, ["d", "s", "t"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))  # a text that occurs once has no winner
    return found.select("row", "id", "t", "d", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (columns doc_id, text; others are ignored).

    The row with the smallest doc_id of a group stays. Rows that repeat this id and text are all marked kept. Null text:
    empty text. Null doc_id: such rows stay only where their whole group has null ids, all of them marked kept. An empty
    table gives an empty result.
    """
    found = classified(docs.select("doc_id", "text"), salt_rows)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("d").alias("text_sha256"))


def drop_duplicates_exact(docs: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, which may have any name.

    Of each group the rows with the smallest doc_id stay: one row, or all that repeat both this id and the text. Null and
    empty texts are one group. A null doc_id stays only where its whole group has none. An empty table gives none.
    """
    return classified(docs, salt_rows).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("row.*")
