"""Writing in three steps: a synthesis, the sections in the order in which they lean on one another, and the fact check.

Reports are rows, so all reports of a run are written side by side: each section is one round of prompts, kept before the
next one reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasieve.functions import text as tx
from metasieve.operators.writing import revise_sections
from metasieve.plans.extraction import TRIES, Keep
from metasieve.plans.responders import Responder

#: The order of writing, and the sections that see the statistics: fixed values.
SECTIONS = ("methods", "results", "discussion", "introduction", "abstract")
SEE_STATISTICS = ("results", "discussion", "introduction", "abstract")
#: What stands for a synthesis that failed.
NO_SYNTHESIS = '{"key_findings": ["Evidence synthesis unavailable"], "evidence_table": [], "narrative_skeleton": {}}'


def _part(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n"), body, F.lit("\n\n"))


def section_prompt(section: str, earlier: tuple[str, ...]) -> Column:
    """The prompt of a section from a report's columns pico, synthesis, statistics, quality and the earlier sections.

    A part without content, but for the statistics, is left out.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = [_part("Section to Write", F.lit(section)), _part("PICO", F.coalesce("pico", F.lit("{}"))), _part("Evidence Synthesis", F.col("synthesis"))]
    if section in SEE_STATISTICS:
        parts.append(_part("Statistical Results", F.coalesce("statistics", F.lit("{}"))))
    parts.append(F.when(given("quality"), _part("Quality Assessments", F.col("quality"))).otherwise(""))
    if earlier:
        parts.append(F.concat(F.lit("## Previously Written Sections\n"), *(F.concat(F.lit(f"### {s.title()}\n"), F.col(s), F.lit("\n\n")) for s in earlier)))
    thesis = F.try_variant_get(F.try_parse_json("synthesis"), f"$.narrative_skeleton.{section}", "string")
    parts.append(F.when(F.coalesce(thesis, F.lit("")) != "", _part("Thesis for This Section", thesis)).otherwise(""))
    return F.concat(*parts, F.lit(f"Write the {section} section now."))


def _answers(ask: Responder, rows: DataFrame, phase: str, user: Column) -> DataFrame:
    """rows with _v: the first of TRIES answers to each report's prompt that is an object."""
    asked = rows.select(F.col("report").cast("string").alias("key"), F.lit("smart").alias("tier"), F.lit("").alias("system"), user.alias("user"), F.lit(phase).alias("phase"))
    good = ask(asked).filter(F.col("attempt") <= TRIES).select("key", "attempt", tx.as_object(tx.answer(F.col("response"))).alias("v"), "response").filter("v IS NOT NULL")
    first = good.groupBy("key").agg(F.min_by("response", "attempt").alias("_r"))
    return rows.join(first, F.col("report").cast("string") == F.col("key"), "left").drop("key").withColumn("_v", tx.answer(F.col("_r"))).drop("_r")


def write_sections(reports: DataFrame, ask: Responder, keep: Keep) -> DataFrame:
    """report, section, ord, text of all sections of reports (report, pico, statistics, extractions, quality; JSON texts).

    An answer that never parses leaves a synthesis that says so, or a placeholder in brackets; an answer without a text
    gives an empty section.
    """
    parts = (_part("PICO", F.coalesce("pico", F.lit("{}"))), _part("Statistical Results", F.coalesce("statistics", F.lit("{}"))), _part("Extractions", F.coalesce("extractions", F.lit("[]"))), _part("Quality Assessments", F.coalesce("quality", F.lit("{}"))))
    told = _answers(ask, reports, "writer_synthesis", F.concat(*parts))
    rows = keep("writer_synthesis", told.withColumn("synthesis", F.coalesce(F.to_json("_v"), F.lit(NO_SYNTHESIS))).drop("_v"))
    for k, section in enumerate(SECTIONS):
        told = _answers(ask, rows, f"writer_{section}", section_prompt(section, SECTIONS[:k]))
        text = F.when(F.col("_v").isNull(), f"[{section} section could not be generated]").otherwise(F.coalesce(F.try_variant_get("_v", "$.text", "string"), F.lit("")))
        rows = keep(f"writer_{section}", told.withColumn(section, text).drop("_v"))
    return rows.select("report", F.inline(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("ord"), F.col(s).alias("text")) for k, s in enumerate(SECTIONS)))))


def check_sections(sections: DataFrame, ask: Responder, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(report, section and the columns of revise_sections(); the claims) of written sections.

    Empty sections and placeholders are not asked about. An answer is an object with claims, or a list of them: text,
    verdict, evidence, corrected_text; one that does not parse makes no claim.
    """
    keyed = sections.withColumn("_key", F.concat_ws("\u001f", F.col("report").cast("string"), "section"))
    open_ = keyed.filter((F.coalesce("text", F.lit("")) != "") & ~F.startswith("text", F.lit("[")))
    asked = open_.select(F.col("_key").alias("key"), F.lit("smart").alias("tier"), F.lit("").alias("system"), F.concat(_part("Section", F.col("section")), _part("Text", F.col("text"))).alias("user"), F.lit("fact_check").alias("phase"))
    good = ask(asked).filter((F.col("attempt") <= TRIES) & tx.answer(F.col("response")).isNotNull())
    first = good.groupBy("key").agg(F.min_by("response", "attempt").alias("response"))
    listed = first.select(F.col("key").alias("section"), F.posexplode(tx.items(tx.answer(F.col("response")), "claims")).alias("claim_idx", "c"))
    claims = keep("fact_check", listed.select("section", "claim_idx", F.from_json("c", "text string, verdict string, evidence string, corrected_text string").alias("c")).select("section", "claim_idx", "c.*"))
    revised = revise_sections(keyed.select(F.col("_key").alias("section"), "text"), claims.drop("evidence"))
    out = keyed.select("report", F.col("section").alias("_s"), "ord", "_key").join(revised.withColumnRenamed("section", "_key"), "_key").drop("_key").withColumnRenamed("_s", "section")
    return out, claims
