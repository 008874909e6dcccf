"""Extraction in four rounds, each asked with what the rounds before have parsed; a failure restarts all four, once.

Rounds: the study's skeleton, the numbers of each outcome, a check of those numbers without the text, the text spans that
show them. The state is a table for each attempt and round, kept before the next round reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.plans.responders import Responder
from metasieve.sources.scratch import stored

#: Attempts of a study at all four rounds, and answers to one prompt of which the first that parses counts.
ATTEMPTS, TRIES = 2, 2
ROUNDS = ("skeleton", "extraction", "cross_check", "evidence")
#: Confidence of a span below which it is listed as low.
SURE_SPAN = 0.7
LISTS = ("primary_outcomes", "secondary_outcomes")

Keep = Callable[[str, DataFrame], DataFrame]


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def _joined(c: Column) -> Column:
    """JSON texts as one JSON list."""
    return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))


def n_fields(extractions: Column) -> Column:
    """How many values the arms of extracted rows (JSON texts) have."""
    arms = F.transform(extractions, lambda x: F.from_json(x, "arm1 map<string,string>, arm2 map<string,string>"))
    filled = lambda m: F.coalesce(F.size(F.filter(F.map_values(m), lambda v: v.isNotNull())), F.lit(0))
    return F.aggregate(arms, F.lit(0), lambda s, a: s + filled(a["arm1"]) + filled(a["arm2"]))


def round_prompts(number: int, rows: DataFrame, pico: str, system: str) -> DataFrame:
    """key, tier, system, user, phase, max_tokens of a round's studies.

    rows has study_id, content (without its references) and, from the second round on, skeleton, outcomes and extractions.
    """
    question, content = _section("PICO", F.lit(pico)), F.col("content")
    if number == 1:
        user, budget = F.concat_ws("\n", question, _section("PDF Content", content)), tx.token_budget("skeleton", tx.estimate_pages(content))
    elif number == 2:
        user = F.concat_ws("\n", question, _section("Study Skeleton", F.col("skeleton")), _section("Outcomes to Extract", _joined(F.col("outcomes"))), _section("Relevant PDF Sections", content))
        budget = tx.token_budget("extraction", F.size("outcomes"))
    elif number == 3:
        user = F.concat_ws("\n", _section("Study Skeleton", F.col("skeleton")), _section("Extracted Data", _joined(F.col("extractions"))))
        budget = tx.token_budget("cross_check", F.size("extractions"))
    else:
        user = F.concat_ws("\n", _section("Extracted Data", _joined(F.col("extractions"))), _section("PDF Content", content))
        budget = tx.token_budget("evidence", F.greatest(n_fields(F.col("extractions")), F.size("extractions")))
    return rows.select(F.col("study_id").cast("string").alias("key"), F.lit("smart").alias("tier"), F.lit(system).alias("system"), user.alias("user"), F.lit(f"extraction_round{number}").alias("phase"), budget.alias("max_tokens"))


def read_round(number: int, value: Column) -> dict[str, Column]:
    """What a round adds to a study's row, from its parsed answer; all null where the answer is of no use."""
    if number in (1, 3):
        value = tx.as_object(value)
    if number == 1:
        listed = [F.coalesce(F.transform(F.try_variant_get(value, f"$.{k}", "array<variant>"), lambda x: F.to_json(x)), F.array().cast("array<string>")) for k in LISTS]
        return {"skeleton": F.to_json(value), "outcomes": F.when(value.isNotNull(), F.concat(*listed))}
    if number == 2:
        return {"extractions": tx.items(value, "extractions", "outcomes")}
    if number == 3:
        passed = F.coalesce(F.try_variant_get(value, "$.checks_passed", "boolean"), F.lit(False))
        return {"crosscheck": F.to_json(value), "checks_passed": F.when(value.isNotNull(), passed), "n_issues": F.when(value.isNotNull(), F.coalesce(F.size(F.try_variant_get(value, "$.issues", "array<variant>")), F.lit(0)))}
    spans = tx.items(value, "spans", "bindings")
    sure = lambda s: F.coalesce(F.from_json(s, "match_confidence double")["match_confidence"], F.lit(0.0)) >= SURE_SPAN
    return {"evidence_spans": spans, "low_confidence_spans": F.filter(spans, lambda s: ~sure(s))}


def extract(studies: DataFrame, pico: str, ask: Responder, keep: Keep, systems: Mapping[int, str] = {}, attempts: int = ATTEMPTS) -> DataFrame:  # noqa: B006
    """study_id, attempts, rounds_completed, skeleton, outcomes, extractions, crosscheck, checks_passed, n_issues,
    evidence_spans, low_confidence_spans, error of every study (study_id, content).

    ask gets the prompts of one round with their attempt and gives key, attempt (from 1), response; of the first TRIES
    responses to a prompt the first that parses counts. An answer that never parses, or is no object in the first or third
    round, fails the study's attempt; what failed starts again from the first round. A study that failed all attempts has
    the error of the last one and the rounds that it completed there. keep stores a table under a name and gives it back.
    """
    whole = studies.select("study_id", tx.strip_references(F.coalesce("content", F.lit(""))).alias("content"))
    texts = keep("extraction_texts", whole)
    pending, finished = texts.select("study_id"), []
    for attempt in range(1, attempts + 1):
        alive, fell = pending, []
        for number in range(1, 5):
            asked = round_prompts(number, alive.join(texts, "study_id") if number != 3 else alive, pico, systems.get(number, "")).withColumn("attempt", F.lit(attempt))
            tried = ask(asked).filter(F.col("attempt") <= TRIES).select("key", F.col("attempt").alias("try"), "response").filter(tx.answer(F.col("response")).isNotNull())
            first = tried.groupBy("key").agg(F.min_by("response", "try").alias("response"))
            answered = alive.join(first, F.col("study_id").cast("string") == F.col("key"), "left").drop("key").withColumn("_v", tx.answer(F.col("response")))
            added = read_round(number, F.col("_v"))
            error = F.when(F.col("response").isNull(), f"round {number}: no answer parses").when(F.col(next(iter(added))).isNull(), f"round {number}: the answer has no use")
            state = answered.withColumns(added).withColumn("error", error).drop("_v", "response")
            state = keep(f"extraction_attempt{attempt}_round{number}", state)
            fell.append(state.filter("error IS NOT NULL").select("study_id", "error", F.lit(number - 1).alias("rounds_completed")))
            alive = state.filter("error IS NULL").drop("error")
        finished.append(alive.withColumns({"attempts": F.lit(attempt), "rounds_completed": F.lit(4), "error": F.lit(None).cast("string")}))
        lost = reduce(DataFrame.unionByName, fell)
        pending = lost.select("study_id")
        if attempt == attempts or not pending.limit(1).count():
            finished.append(lost.withColumn("attempts", F.lit(attempt)))
            break
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), finished)
    return out.select("study_id", "attempts", "rounds_completed", "skeleton", "outcomes", "extractions", "crosscheck", "checks_passed", "n_issues", "evidence_spans", "low_confidence_spans", "error")


def extracted_rows(found: DataFrame, schema: str) -> DataFrame:
    """study_id, ord and the fields of schema: the extracted rows of extract(), in order, as a table for the statistics."""
    rows = found.filter("error IS NULL").select("study_id", F.posexplode("extractions").alias("ord", "row"))
    return rows.select("study_id", "ord", F.from_json("row", schema).alias("r")).select("study_id", "ord", "r.*")


# ---- screening in batches --------------------------------------------------------------------------------------------


def pack(rows: DataFrame, group: str, order: str, tokens: Column, budget: int) -> DataFrame:
    """rows with batch and place: consecutive rows of a group that fit a prompt of `budget` tokens together.

    A row goes to the batch in which its running total of tokens begins: a batch begins less than budget tokens after the
    one before it, and a row longer than the budget does not split. Rows of a group come in its sorted order, null first.
    Totals run within ranges of the sorted rows, and behind the sums of the ranges before, so a group of any size is dealt
    over many tasks; the ranges are stored, since both sums must see the same ones.
    """
    ranged = stored(rows.withColumn("_tokens", tokens.cast("long")).repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum("_tokens").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_g", "_r", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    within = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totalled = ranged.withColumn("_total", F.sum("_tokens").over(within)).join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    placed = totalled.withColumn("batch", F.floor((F.col("_earlier") + F.col("_total") - F.col("_tokens")) / budget))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(group, "batch").orderBy(order)) - 1).select(*(F.col(f"`{c}`") for c in rows.columns), "batch", "place")


def screening_prompts(packed: DataFrame, group: str, pico: str, criteria: str) -> DataFrame:
    """group, batch, n, user: the studies of a batch in one prompt, numbered by place."""
    one = F.concat(F.lit("### "), F.col("place"), F.lit("\nTitle: "), F.coalesce("title", F.lit("N/A")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("N/A")))
    listed = packed.groupBy(group, "batch").agg(F.sort_array(F.collect_list(F.struct("place", one.alias("text")))).alias("s"))
    return listed.select(group, "batch", F.size("s").alias("n"), F.concat(_section("PICO Criteria", F.lit(pico)), F.lit("\n"), _section("Screening Criteria", F.lit(criteria)), F.lit("\n## Studies to Screen\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")).alias("user"))


def batch_votes(packed: DataFrame, group: str, answers: DataFrame, screener: str) -> DataFrame:
    """study_id, screener_id, decision, confidence, parse_error: one vote for each packed study.

    answers has group, batch, response: a list of votes by place (or an object with votes, decisions or results). Places
    that a short or broken answer lacks are included with confidence 0, so that no study is lost.
    """
    from metasieve.operators.screening import valid_vote

    votes = answers.select(group, "batch", F.posexplode(tx.items(tx.answer(F.col("response")), "votes", "decisions", "results")).alias("place", "vote"))
    joined = packed.select("study_id", group, "batch", "place").join(votes, [group, "batch", "place"], "left")
    v = F.from_json("vote", "decision string, confidence double")
    good = F.coalesce(v["decision"].isNotNull(), F.lit(False))
    checked = valid_vote(v["decision"], v["confidence"])
    return joined.select("study_id", F.lit(screener).alias("screener_id"), F.when(good, checked["decision"]).otherwise("include").alias("decision"), F.when(good, checked["confidence"]).otherwise(0).alias("confidence"), (~good).alias("parse_error"))
