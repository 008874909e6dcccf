"""Text operators as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings of a bibliography, most specific first: fixed values.
REFERENCE_PATTERNS = (
    r"<!-- PAGE \d+ -->\s*\n\s*(?:REFERENCES|References|BIBLIOGRAPHY|Bibliography)\s*\n",
    r"\n\s*(?:\d+\.?\s+)?(?:REFERENCES|References|BIBLIOGRAPHY|Bibliography|WORKS\s+CITED|Works\s+Cited|LITERATURE\s+CITED)\s*\n",
    r"\n[^\n]*\bReferences\s*\n\s*(?:\[?1[\].])",
    r"\n\s*R\s*E\s*F\s*E\s*R\s*E\s*N\s*C\s*E\s*S\s*\n",
    r"(?i)\n[^\n]{0,50}references\s*\n",
)
#: Share of the text before which a heading does not count.
REFERENCE_FROM = 0.6

#: Sections that matter most, as patterns: fixed values.
SECTION_PATTERNS = (
    r"(?is)(methods?\b.*?)(?=\n\s*(?:results?|discussion|references)\b)",
    r"(?is)(results?\b.*?)(?=\n\s*(?:discussion|conclusion|references)\b)",
)
SECTION_RULE = "\n\n---\n\n"

#: Ends of cut texts and the marker of a compressed one: fixed values.
CUT_PARAGRAPH, CUT_SENTENCE, CUT_HARD = "\n\n[... truncated at paragraph boundary]", "\n\n[... truncated at sentence boundary]", "\n\n[... truncated]"
COMPRESSED = "\n\n[... compressed ...]\n\n"
CONTENT_CHARS = 24_000

#: Words that are no keywords: fixed values.
STOP_WORDS = (
    "the and for with from that this are was were been have has had will would could should not but they their which when what "
    "than more also between after before each other into through during about these those some such only over both using used"
).split()

#: (base, per item) of the token budgets of the four extraction rounds, and their bounds: fixed values.
TOKEN_BUDGETS = {"skeleton": (2048, 80), "extraction": (1024, 600), "cross_check": (1024, 200), "evidence": (512, 250)}
TOKEN_BOUNDS = (2048, 32768)

#: A fenced answer: fixed value.
FENCE = r"(?s)^```(?:json|js|javascript)?\s*\n?(.*?)\n?\s*```$"


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(rstrip(c), r"^\s+", "")


def strip_references(text: Column) -> Column:
    """text before its bibliography: the first pattern, in order, that matches in the last part of the text decides."""
    skip = F.ceil(F.length(text) * REFERENCE_FROM).cast("int")
    tail = F.substring(text, skip + 1, F.length(text))
    at = F.lit(None).cast("int")
    for p in reversed(REFERENCE_PATTERNS):
        found = F.regexp_instr(tail, F.lit(p))
        at = F.when(found > 0, found).otherwise(at)
    return F.when(at.isNull(), text).otherwise(rstrip(F.substring(text, F.lit(1), skip + at - 1)))


def priority_sections(text: Column) -> Column:
    """Methods and results, joined by a rule; null if neither is there."""
    parts = [strip(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in SECTION_PATTERNS]
    return F.nullif(F.array_join(F.array_compact(F.array(*parts)), SECTION_RULE), F.lit(""))


def _last(text: Column, what: str) -> Column:
    """The place before which the last occurrence starts, from 0; -1 if there is none."""
    back = F.locate(what[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - len(what) + 1).otherwise(-1)


def truncate_at_paragraph(text: Column, max_chars: int) -> Column:
    """text, or its first max_chars up to the last paragraph, else sentence, that ends beyond the half, with a remark."""
    cut = F.substring(text, 1, max_chars)
    paragraph = _last(cut, "\n\n")
    sentence = F.greatest(*(_last(cut, s) for s in (". ", ".\n", "? ", "! ")))
    return (
        F.when(F.length(text) <= max_chars, text)
        .when(paragraph > max_chars * 0.5, F.concat(rstrip(F.substring(text, F.lit(1), paragraph)), F.lit(CUT_PARAGRAPH)))
        .when(sentence > max_chars * 0.5, F.concat(rstrip(F.substring(text, F.lit(1), sentence + 1)), F.lit(CUT_SENTENCE)))
        .otherwise(F.concat(rstrip(cut), F.lit(CUT_HARD)))
    )


def prepare_content(text: Column, max_chars: int = CONTENT_CHARS) -> Column:
    """A text that fits: itself, its priority sections if they fit, else its beginning."""
    sections = priority_sections(text)
    return F.when(F.length(text) <= max_chars, text).when(F.length(sections) <= max_chars, sections).otherwise(truncate_at_paragraph(text, max_chars))


def estimate_pages(text: Column) -> Column:
    marks = F.regexp_count(text, F.lit("<!-- PAGE"))
    return F.when(marks > 0, marks).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3500))).cast("int")


def token_budget(kind: str, items: Column) -> Column:
    base, per_item = TOKEN_BUDGETS[kind]
    return F.greatest(F.lit(TOKEN_BOUNDS[0]), F.least(F.lit(TOKEN_BOUNDS[1]), base + per_item * items)).cast("int")


def keywords(text: Column) -> Column:
    """The distinct words of three ASCII letters or more, lower-cased, that are no stop words, sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z]{3,})"), 1)
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, STOP_WORDS))))


def pico_drift(task: Column, pico_text: Column) -> Column:
    """overlap_ratio, task_keywords, pico_keywords (the first 20) where a task of over 3 keywords shares under a tenth."""
    t, p = keywords(task), keywords(pico_text)
    ratio = F.size(F.array_intersect(t, p)) / F.nullif(F.size(t), F.lit(0))
    return F.when((F.size(p) > 0) & (F.size(t) > 3) & (ratio < 0.1), F.struct(ratio.alias("overlap_ratio"), t.alias("task_keywords"), F.slice(p, 1, 20).alias("pico_keywords")))


def compress_context(text: Column, max_tokens: int = 2000) -> Column:
    """text, or the halves of 3 * max_tokens characters from its start and end."""
    half = max_tokens * 3 // 2
    return F.when((F.floor(F.length(text) / 3) <= max_tokens) | (F.length(text) <= max_tokens * 3), text).otherwise(F.concat(F.substring(text, 1, half), F.lit(COMPRESSED), F.right(text, F.lit(half))))


def strip_fences(text: Column) -> Column:
    """The content of a text that is one fenced block, else the stripped text."""
    t = strip(text)
    return F.when(F.rlike(t, F.lit(FENCE)), strip(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def parse_json(response: Column, retry: Column | None, schema: str) -> Column:
    """The parsed answer; where that fails, the retried one; null where both do."""
    parse = lambda c: F.from_json(F.when(F.rlike(strip_fences(c), F.lit(r"(?s)^[\[{].*[\]}]$")), strip_fences(c)), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    first = parse(response)
    return first if retry is None else F.coalesce(first, parse(retry))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, worked out once: what f's own lambdas use would be worked out anew for each of their items."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def inverted_index(words: Column) -> Column:
    """The inverted index (map of word to its positions from 0, ascending) of an array of words."""

    def index(placed: Column) -> Column:
        place = lambda k: F.get(placed, k)
        starts = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: (k == 0) | (place(k)["w"] != place(k - 1)["w"]))
        entry = lambda start, end: F.struct(place(start)["w"].alias("w"), F.transform(F.slice(placed, start + 1, end - start), lambda x: x["p"]).alias("ps"))
        return bound(starts, lambda at: F.map_from_entries(F.transform(at, lambda start, k: entry(start, F.coalesce(F.get(at, k + 1), F.size(placed))))))

    ordered = F.array_sort(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    return bound(ordered, lambda placed: F.when(F.size(placed) > 0, index(placed)).otherwise(F.map_from_entries(F.slice(F.transform(placed, lambda x: F.struct(x["w"], F.array(x["p"]))), 1, 0))))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (map of word to positions): words by position, then alphabet; empty for none."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("long").alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def table_to_markdown(rows: Column) -> Column:
    """A table (array of arrays of cells) as Markdown: ragged rows padded, null for a table without text."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def table(clean: Column, width: Column) -> Column:
        lines = F.transform(clean, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = line(F.array_repeat(F.lit("---"), width))
        return bound(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))), "\n"))

    cleaned = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    some = lambda clean: F.coalesce(F.exists(clean, lambda r: F.exists(r, lambda c: c != "")), F.lit(False))
    return bound(cleaned, lambda clean: F.when(some(clean), bound(F.array_max(F.transform(clean, F.size)), lambda width: table(clean, width))))


def pages_of(text: Column) -> Column:
    """The pages of a text with page marks, as an array."""
    return F.filter(F.transform(F.split(text, r"<!-- PAGE \d+ -->"), strip), lambda p: p != "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def answer(response: Column) -> Column:
    """A model's answer as a VARIANT: without its fence, null where it is no JSON."""
    return F.try_parse_json(strip_fences(response))


def as_object(value: Column) -> Column:
    """A VARIANT that is an object; null for any other."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def items(value: Column, *keys: str) -> Column:
    """The items of an answer (VARIANT) as an array of JSON texts, whatever its shape.

    A list is its items. An object gives the list under the first of keys that it has, one item if no list is there, itself
    if it has none of the keys; anything else is one item. Null for no answer and for a key that holds null.
    """
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    named = F.coalesce(*(F.try_variant_get(as_object(value), f"$.{k}", "variant") for k in keys), F.lit(None).cast("variant"))
    inner = F.when(named.isNull(), F.array(value)).when(F.is_variant_null(named), F.lit(None)).otherwise(F.coalesce(listed(named), F.array(named)))
    return F.transform(F.when(value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False)), F.coalesce(listed(value), inner)), lambda x: F.to_json(x))
