"""Fact checks of written sections, and plot-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = "[CITATION NEEDED]"
#: Tolerances of numbers in claims.
EFFECT_TOLERANCE, PERCENT_TOLERANCE = 0.01, 0.1


def revise_sections(sections: DataFrame, claims: DataFrame) -> DataFrame:
    """section, text, revised_text, n_supported, n_contradicted, n_unsupported, claims with resolved.

    sections has section and text; claims section, claim_idx, text, verdict, corrected_text. Claims apply in claim_idx's
    order: a contradicted one with a correction is replaced everywhere and resolved, found or not; an unsupported one is
    tagged unless the section has a tag already. Empty texts and placeholders in brackets are left alone.
    """
    resolved = (F.col("verdict") == "CONTRADICTED") & (F.coalesce("corrected_text", F.lit("")) != "")
    one = F.struct("claim_idx", "text", "verdict", "corrected_text", F.coalesce(resolved, F.lit(False)).alias("resolved"))
    lists = claims.groupBy("section").agg(F.sort_array(F.collect_list(one)).alias("claims"), *(F.count_if(F.col("verdict") == v.upper()).alias(f"n_{v}") for v in ("supported", "contradicted", "unsupported")))
    joined = sections.select("section", F.coalesce("text", F.lit("")).alias("text")).join(lists, "section", "left")

    def step(t: Column, c: Column) -> Column:
        usable = (F.coalesce(c["text"], F.lit("")) != "") & F.contains(t, c["text"])
        fixed = F.when(usable & c["resolved"], F.replace(t, c["text"], c["corrected_text"]))
        tagged = fixed.when(usable & (c["verdict"] == "UNSUPPORTED") & ~F.contains(t, F.lit(TAG)), F.replace(t, c["text"], F.concat(c["text"], F.lit(f" {TAG}"))))
        return tagged.otherwise(t)

    checked = (F.col("text") != "") & ~F.col("text").startswith("[")
    revised = F.when(checked & F.col("claims").isNotNull(), F.aggregate("claims", F.col("text"), step)).otherwise(F.col("text"))
    return joined.select("section", "text", revised.alias("revised_text"), *(F.when(checked, F.coalesce(n, F.lit(0))).otherwise(0).alias(n) for n in ("n_supported", "n_contradicted", "n_unsupported")), F.when(checked, F.col("claims")).alias("claims"))


def needs_revision(revised: DataFrame) -> bool:
    """Whether a contradicted claim is left unresolved."""
    return not revised.filter(F.exists("claims", lambda c: (c["verdict"] == "CONTRADICTED") & ~c["resolved"])).isEmpty()


def verdict_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("section").pivot("verdict", ["SUPPORTED", "CONTRADICTED", "UNSUPPORTED"]).agg(F.count(F.lit(1))).na.fill(0)


def numbers_agree(claimed: Column, found: Column, percent: bool = False) -> Column:
    return F.abs(claimed - found) <= F.lit(PERCENT_TOLERANCE if percent else EFFECT_TOLERANCE)


def magnitude(effect: Column) -> Column:
    """The band of a standardised effect."""
    e = F.abs(effect)
    return F.when(e < 0.2, "negligible").when(e < 0.5, "small").when(e < 0.8, "medium").when(e.isNotNull(), "large")


def forest_rows(effects: DataFrame, pooled: DataFrame) -> DataFrame:
    """outcome, y, label, effect, lo, hi, kind: the studies from the top down, the pooled effect at -1."""
    rank = effects.join(pooled.select("outcome", "k"), "outcome").withColumn("_i", F.row_number().over(Window.partitionBy("outcome").orderBy("ord")))
    studies = rank.select("outcome", (F.col("k") - F.col("_i")).cast("long").alias("y"), F.col("study_id").alias("label"), "effect", (F.col("effect") - 1.96 * F.col("se")).alias("lo"), (F.col("effect") + 1.96 * F.col("se")).alias("hi"), F.lit("study").alias("kind"))
    return studies.unionByName(pooled.select("outcome", F.lit(-1).cast("long").alias("y"), F.lit("Pooled").alias("label"), F.col("pooled_effect").alias("effect"), F.col("ci_lower").alias("lo"), F.col("ci_upper").alias("hi"), F.lit("pooled").alias("kind")))


def funnel_grid(effects: DataFrame, pooled: DataFrame, points: int = 100) -> DataFrame:
    """outcome, step, se, lo, hi: pseudo confidence limits from 0.001 to 1.2 times the largest se."""
    top = effects.groupBy("outcome").agg((F.max("se") * 1.2).alias("_top")).join(pooled.select("outcome", "pooled_effect"), "outcome")
    steps = top.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    se = 0.001 + (F.col("_top") - 0.001) * F.col("step") / (points - 1)
    return steps.select("outcome", "step", se.alias("se"), (F.col("pooled_effect") - 1.96 * se).alias("lo"), (F.col("pooled_effect") + 1.96 * se).alias("hi"))


#: The text of the flow of studies: its lines, with the counter of each: fixed values.
PRISMA_LINES = (
    ("PRISMA 2020 Flow Diagram", None), ("=" * 50, None), ("", None),
    ("IDENTIFICATION", None), ("  Records identified from databases: ", "identified"), ("  Duplicates removed: ", "duplicates_removed"), ("  Records after deduplication: ", "after_dedup"), ("", None),
    ("SCREENING", None), ("  Excluded by prescreen (keywords): ", "prescreen_excluded"), ("  Records screened (T/A): ", "screened"), ("  Records excluded (T/A): ", "screen_excluded"), ("  Records to human review: ", "human_review"), ("", None),
    ("ELIGIBILITY", None), ("  Reports sought for retrieval: ", "sought"), ("  Reports assessed (full-text): ", "fulltext_assessed"), ("  Reports excluded (full-text): ", "fulltext_excluded"), ("", None),
    ("INCLUDED", None), ("  Studies included in review: ", "included"),
)
#: Boxes of the figure: kind, x and y of the centre, width, height, text, counter: fixed values.
PRISMA_BOXES = (
    ("main", 5.0, 15.0, 5.0, 0.9, "Records identified", "identified"), ("main", 5.0, 13.3, 5.0, 0.9, "After duplicates removed", "after_dedup"), ("side", 8.5, 13.3, 2.5, 0.7, "Duplicates", "duplicates_removed"),
    ("main", 5.0, 11.6, 5.0, 0.9, "Records screened (T/A)", "screened"), ("side", 8.5, 11.6, 2.5, 0.7, "Excluded (T/A)", "screen_excluded"), ("side", 8.5, 12.5, 2.5, 0.7, "Prescreen excluded", "prescreen_excluded"),
    ("main", 5.0, 9.9, 5.0, 0.9, "Full-text assessed", "fulltext_assessed"), ("side", 8.5, 9.9, 2.5, 0.7, "Excluded (full-text)", "fulltext_excluded"), ("main", 5.0, 8.2, 5.0, 0.9, "Studies included", "included"),
)


def prisma_text(counts: Column) -> Column:
    """The flow of studies as text, from the struct that prisma_counts() gives."""
    return F.concat_ws("\n", *(F.lit(line) if n is None else F.concat(F.lit(line), counts[n].cast("string")) for line, n in PRISMA_LINES))


def prisma_layout(counts: DataFrame, column: str = "counts") -> DataFrame:
    """counts' other columns, kind (main, side, arrow), x, y, w, h, text: the figure's boxes, and its arrows as steps (w, h) from x, y.

    The prescreen's box is there where it has left something out. Arrows go from each main box to the next one below.
    """
    c = F.col(column)
    box = lambda kind, x, y, w, h, text, n: F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), text.alias("text"))
    label = lambda text, n: F.concat(F.lit(f"{text}\n(n = "), c[n].cast("string"), F.lit(")"))
    boxes = [F.when(c["prescreen_excluded"] > 0 if n == "prescreen_excluded" else F.lit(True), box(kind, x, y, w, h, label(text, n), n)) for kind, x, y, w, h, text, n in PRISMA_BOXES]
    mains = [b for b in PRISMA_BOXES if b[0] == "main"]
    arrows = [box("arrow", a[1], a[2] - a[4] / 2, 0.0, (b[2] + b[4] / 2) - (a[2] - a[4] / 2), F.lit(None).cast("string"), None) for a, b in zip(mains, mains[1:], strict=False)]
    return counts.select(*(x for x in counts.columns if x != column), F.inline(F.array_compact(F.array(*boxes, *arrows))))


def cost_bars(costs: DataFrame) -> DataFrame:
    """phase, agent, bottom, top, x: stacked bars of costs (phase, agent, cost), phases from the left, agents from below, by name."""
    w = Window.partitionBy("phase").orderBy("agent")
    place = costs.select("phase").distinct().withColumn("x", F.row_number().over(Window.orderBy("phase")) - 1)  # a row for each phase of a run
    top = F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("top", top).select("phase", "agent", (F.col("top") - F.col("cost")).alias("bottom"), "top").join(place, "phase")
