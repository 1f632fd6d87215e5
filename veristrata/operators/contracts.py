"""Record contracts as Columns: the first failing rule of a record, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristrata.functions import text as T

#: The domains of enumerated fields.
CHUNK_LEVELS = ("parent", "passage")
DIAGNOSTIC_SEVERITIES = ("error", "warning")


def missing(field: str, c: Column | None = None) -> Column:
    c = F.col(field) if c is None else c
    return F.when(c.isNull() | T.is_blank(c.cast("string")), f"{field} is required")


def not_positive(field: str) -> Column:
    return F.when(F.coalesce(F.col(field), F.lit(0)) <= 0, f"{field} must be positive")


def negative(field: str) -> Column:
    return F.when(F.coalesce(F.col(field), F.lit(-1)) < 0, f"{field} must not be negative")


def no_probability(field: str, c: Column | None = None) -> Column:
    c = F.col(field) if c is None else c
    return F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), f"{field} is out of range")


def first_failure(*rules: Column) -> Column:
    return F.coalesce(*rules)


def corpus_source() -> Column:
    unparsed = F.when((F.col("coverage_status") == "supported") & (F.col("parser") == "unspecified"), "parser is required")
    return first_failure(*map(missing, ("source_family", "display_name", "jurisdiction", "canonical_url")), unparsed)


def clean_text_record() -> Column:
    return first_failure(missing("text"), not_positive("line_count"))


def _anchors(field: str) -> Column:
    """The first failing anchor's error; its value is looked at before its confidence."""
    error = lambda a: F.when(a["value"].isNull() | T.is_blank(a["value"]), f"{field}.value is required").when(
        a["confidence"].isNull() | F.isnan(a["confidence"]) | (a["confidence"] < 0) | (a["confidence"] > 1), f"{field}.confidence is out of range"
    )
    found = F.filter(F.transform(F.col(field), error), lambda e: e.isNotNull())
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(1)))


def query_signals() -> Column:
    return first_failure(missing("raw_query"), missing("semantic_text"), no_probability("confidence"), _anchors("exact_anchors"), _anchors("scope_anchors"))


def search_quality() -> Column:
    return first_failure(not_positive("attempt"), not_positive("top_k"), no_probability("top_score"), no_probability("coverage"), missing("reason"))


def document() -> Column:
    return first_failure(*map(missing, ("doc_id", "version_id", "citation", "title", "jurisdiction", "doc_type", "source")))


def chunk() -> Column:
    span = F.when(F.col("char_end") < F.col("char_start"), "char_range is out of range")
    return first_failure(*map(missing, ("chunk_id", "doc_id", "text", "rerank_text")), span, not_positive("token_count"))


#: The text fields that a section needs.
SECTION_TEXT = ("doc_id", "parent_doc_id", "version_id", "section_number", "section_heading", "citation", "title", "jurisdiction", "doc_type", "source", "authority_type", "instrument_status", "body_text")


def section() -> Column:
    """Rules over one struct of the fields, so that a filter by them refers to each field's expression once."""
    fields = F.array(F.struct(*[F.col(f) for f in (*SECTION_TEXT, "section_ordinal", "authority_rank")]))

    def rules(s: Column) -> Column:
        lost = {f: missing(f, s[f]) for f in SECTION_TEXT}
        ordinal = F.when(F.coalesce(s["section_ordinal"], F.lit(0)) <= 0, "section_ordinal must be positive")
        rank = F.when(F.coalesce(s["authority_rank"], F.lit(-1)) < 0, "authority_rank must not be negative")
        before, after = SECTION_TEXT[:3], SECTION_TEXT[3:-1]
        return first_failure(*[lost[f] for f in before], ordinal, *[lost[f] for f in after], rank, lost["body_text"])

    return F.element_at(F.transform(fields, rules), 1)


def source_location(c: str = "location") -> Column:
    """Pages and lines count from one, offsets from zero; lines are ordered within one page."""
    p = lambda f: F.col(f"{c}.{f}")
    return first_failure(
        F.when(p("page_start") < 1, "page_start must be positive"),
        F.when(p("page_end") < p("page_start"), "page_end is before page_start"),
        F.when((p("line_start") < 1) | (p("line_end") < 1), "lines must be positive"),
        F.when((p("page_start") == p("page_end")) & (p("line_end") < p("line_start")), "line_end is before line_start"),
        F.when(p("char_offset") < 0, "char_offset must not be negative"),
    )


def bounding_box(c: str = "bbox") -> Column:
    p = lambda f: F.col(f"{c}.{f}")
    outside = F.exists(F.array(*[p(f) for f in ("x0", "y0", "x1", "y1")]), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1000))
    return first_failure(F.when(outside, "bbox is out of range"), F.when((p("x1") <= p("x0")) | (p("y1") <= p("y0")), "bbox is empty"))
