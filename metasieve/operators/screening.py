"""Deduplication, prescreening, dual screening and the flow counts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Confidence from which two exclusions need no arbiter, and below which an arbiter's decision goes to a person.
SURE, ARBITER_SURE = 80, 60


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def dedup_by_title(studies: DataFrame, order: str = "ord") -> DataFrame:
    """The first study of each title, compared without case and outer white space; all studies without a title stay.

    The first of each title is found by an aggregate with partial sums, so a title that many rows share is not sorted on
    one task. Of several rows with one title and place in the order, the one with the smallest hash stays.
    """
    key, place, first = (f"__{name}_{uuid.uuid4().hex}" for name in ("key", "place", "first"))
    keyed = studies.withColumn(key, F.lower(strip(F.coalesce("title", F.lit(""))))).withColumn(place, F.struct(F.col(order), F.xxhash64(*(F.col(f"`{c}`") for c in studies.columns if not isinstance(studies.schema[c].dataType, MapType)))))
    firsts = keyed.filter(F.col(key) != "").groupBy(key).agg(F.min(place).alias(first))
    joined = keyed.join(firsts, key, "left")
    return joined.filter((F.col(key) == "") | (F.col(place) == F.col(first))).select(*(F.col(f"`{c}`") for c in studies.columns))


def prescreen(studies: DataFrame, exclusion: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """studies with status (passed, excluded) and reason: an exclusion keyword found, or no required one found.

    Keywords are substrings of title and abstract, without case; empty keywords are ignored. Exclusion comes first.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))

    def any_of(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for w in words:
            if w:
                found = found | F.contains(text, F.lit(w.lower()))
        return found

    wanted = [w for w in required if w]
    reason = F.when(any_of(exclusion), "exclusion_keyword_match")
    if wanted:
        reason = reason.when(~any_of(wanted), "no_required_keyword")
    return studies.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "passed").otherwise("excluded"))


def _clamped(confidence: Column, missing: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(confidence.cast("double").cast("int"), F.lit(missing))))


def valid_vote(decision: Column, confidence: Column) -> Column:
    """decision, confidence of a screener: an unknown decision becomes include with 20 points less.

    The points go before the confidence is bounded, and a missing one counts 0 there, 50 elsewhere.
    """
    d = F.lower(strip(decision))
    ok = F.coalesce(d.isin("include", "exclude"), F.lit(False))
    less = _clamped(F.coalesce(confidence.cast("double"), F.lit(0.0)) - 20, 0)
    return F.struct(F.when(ok, d).otherwise("include").alias("decision"), F.when(ok, _clamped(confidence, 50)).otherwise(less).alias("confidence"))


def valid_arbitration(decision: Column, confidence: Column) -> Column:
    """decision, confidence of an arbiter: low confidence goes to human_review as it is, an unknown decision after it with 0."""
    d, c = F.lower(strip(decision)), _clamped(confidence, 50)
    known = F.coalesce(d.isin("include", "exclude", "human_review"), F.lit(False))
    low = c < ARBITER_SURE
    return F.struct(F.when(low | ~known, "human_review").otherwise(d).alias("decision"), F.when(low | known, c).otherwise(0).alias("confidence"))


def valid_fulltext(decision: Column, confidence: Column) -> Column:
    """decision, confidence of a full-text vote: an unknown decision becomes include with 0."""
    d, c = F.lower(strip(decision)), _clamped(confidence, 50)
    ok = F.coalesce(d.isin("include", "exclude"), F.lit(False))
    return F.struct(F.when(ok, d).otherwise("include").alias("decision"), F.when(ok, c).otherwise(0).alias("confidence"))


def needs_arbiter(d1: Column, c1: Column, d2: Column, c2: Column) -> Column:
    """False if either includes, or both exclude and are sure."""
    sure = (d1 == "exclude") & (d2 == "exclude") & (c1 >= SURE) & (c2 >= SURE)
    return ~((d1 == "include") | (d2 == "include") | sure)


def resolve_screening(d1: Column, c1: Column, d2: Column, c2: Column, arbiter_decision: Column, arbiter_confidence: Column) -> Column:
    """final_decision, method, confidence."""
    result = lambda d, m, c: F.struct(d.alias("final_decision"), F.lit(m).alias("method"), c.cast("int").alias("confidence"))
    i1, i2 = d1 == "include", d2 == "include"
    return (
        F.when(i1 & i2, result(F.lit("include"), "dual_include", F.greatest(c1, c2)))
        .when(i1, result(F.lit("include"), "union_include", c1))
        .when(i2, result(F.lit("include"), "union_include", c2))
        .when((c1 >= SURE) & (c2 >= SURE) & (d1 == "exclude") & (d2 == "exclude"), result(F.lit("exclude"), "dual_exclude_high_confidence", F.least(c1, c2)))
        .when(arbiter_decision.isNull(), result(F.lit("human_review"), "arbiter_missing", F.lit(0)))
        .otherwise(result(arbiter_decision, "arbiter", arbiter_confidence))
    )


def screen(votes: DataFrame, arbitrations: DataFrame) -> DataFrame:
    """study_id, d1, c1, d2, c2, needed, final_decision, method, confidence.

    votes has study_id, screener_id (screener1, screener2), decision, confidence; arbitrations study_id, decision,
    confidence, of which those not needed are not used.
    """
    v = votes.withColumn("v", valid_vote(F.col("decision"), F.col("confidence")))
    pick = lambda s: F.max(F.when(F.col("screener_id") == s, F.col("v")))
    both = v.groupBy("study_id").agg(pick("screener1").alias("a"), pick("screener2").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = both.select("study_id", F.col("a.decision").alias("d1"), F.col("a.confidence").alias("c1"), F.col("b.decision").alias("d2"), F.col("b.confidence").alias("c2"))
    both = both.withColumn("needed", needs_arbiter(F.col("d1"), F.col("c1"), F.col("d2"), F.col("c2")))
    arb = arbitrations.select("study_id", valid_arbitration(F.col("decision"), F.col("confidence")).alias("arb"))
    joined = both.join(arb, "study_id", "left").withColumn("arb", F.when(F.col("needed"), F.col("arb")))
    return joined.select("study_id", "d1", "c1", "d2", "c2", "needed", F.inline(F.array(resolve_screening(F.col("d1"), F.col("c1"), F.col("d2"), F.col("c2"), F.col("arb.decision"), F.col("arb.confidence")))))


def included(studies: DataFrame, results: DataFrame) -> DataFrame:
    """The studies whose final decision is include; human_review is not."""
    return studies.join(results.filter("final_decision = 'include'").select("study_id"), "study_id", "left_semi")


def screen_fulltext(studies: DataFrame, votes: DataFrame) -> DataFrame:
    """studies (study_id, content) with decision, confidence, reason: without content a study is included."""
    v = votes.select("study_id", valid_fulltext(F.col("decision"), F.col("confidence")).alias("v"))
    # found before the join, which then need not carry the texts where they are not asked for
    marked, empty = studies.withColumn("_empty", F.coalesce("content", F.lit("")) == ""), F.col("_empty")
    none = F.struct(F.lit("include").alias("decision"), F.lit(0).alias("confidence"))
    return marked.join(v, "study_id", "left").withColumn("v", F.when(empty | F.col("v").isNull(), none).otherwise(F.col("v"))).select(*studies.columns, "v.decision", "v.confidence", F.when(empty, "no full text available").alias("reason"))


def prisma_counts(raw: Column, deduplicated: Column, prescreen_excluded: Column, screened: Column, screen_excluded: Column, human_review: Column, fulltext_assessed: Column, fulltext_excluded: Column, included_n: Column, not_retrieved: Column) -> Column:
    """The counters of the flow diagram; studies sent to a person count as sought."""
    return F.struct(
        raw.alias("identified"), (raw - deduplicated).alias("duplicates_removed"), deduplicated.alias("after_dedup"), prescreen_excluded.alias("prescreen_excluded"),
        (deduplicated - prescreen_excluded).alias("after_prescreen"), screened.alias("screened"), screen_excluded.alias("screen_excluded"), human_review.alias("human_review"),
        (screened - screen_excluded).alias("sought"), not_retrieved.alias("not_retrieved"), fulltext_assessed.alias("fulltext_assessed"), fulltext_excluded.alias("fulltext_excluded"), included_n.alias("included"),
    )


def pico_score(pico: DataFrame) -> DataFrame:
    """pico with score, 0 to 100: how complete the question is.

    population and intervention 20 each (half for one word), comparator 15, outcome 15, criteria 15, study_design 10,
    timing or follow_up 5. outcome is an array of strings.
    """
    words = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda x: x != ""))
    filled = lambda c: words(c) > 0
    listed = lambda c: F.coalesce(F.size(F.filter(F.col(c), lambda x: F.coalesce(x, F.lit("")) != "")) > 0, F.lit(False))
    part = lambda c, n: F.when(words(c) > 1, n).when(words(c) == 1, n // 2).otherwise(0)
    points = part("population", 20) + part("intervention", 20) + F.when(filled("comparator"), 15).otherwise(0) + F.when(listed("outcome"), 15).otherwise(0)
    points = points + F.when(listed("inclusion_criteria") | listed("exclusion_criteria"), 15).otherwise(0) + F.when(filled("study_design"), 10).otherwise(0) + F.when(filled("timing") | filled("follow_up"), 5).otherwise(0)
    return pico.withColumn("score", points)
