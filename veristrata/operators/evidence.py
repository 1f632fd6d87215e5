"""Matching values to the sections they came from: exact first, then scored fuzzy windows.

``leaves``: ``doc_id, path, value``; ``sections``: ``doc_id, section_ord, text``
(and location columns).  Both sides meet by ``doc_id``; only leaves without an
exact match reach the fuzzy scorer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T

STRONG = 0.85
#: Fuzzy windows: prefix length, positions taken from prefix hits, least stride.
PREFIX, PREFIX_HITS, STRIDE = 5, 8, 8
ANCHOR_WORDS = 3
#: Items without a run of whole words, which are looked for in every text, go out in blocks of so many.
SHORT_ITEMS = 5_000
#: Where a citation stands; the place of a value that no section holds.
LOCATION = {"page_start": 1, "page_end": 1, "line_start": 1, "line_end": 1, "char_offset": 0}


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of the published definition: prefix of four, scale 0.1, applied from 0.7 on."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = [False] * lb
    hits = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), min(lb, i + reach + 1))
        while j >= 0 and used[j]:
            j = b.find(ch, j + 1, min(lb, i + reach + 1))
        if j >= 0:
            used[j] = True
            hits.append(ch)
    m = len(hits)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (b[j] for j in range(lb) if used[j]), strict=True)) // 2
    jaro = (m / la + m / lb + (m - swapped) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def windows(needle: str, text: str) -> Iterator[str]:
    """Candidate windows: the start, hits of the needle's prefix, regular strides; three lengths around the needle's."""
    n, size = len(needle), len(text)
    low, high = max(1, int(n * 4 // 5)), min(size, -(-n * 6 // 5))
    starts = [0]
    prefix = needle[:PREFIX]
    if prefix.strip():
        at = text.find(prefix)
        while at >= 0 and len(starts) <= PREFIX_HITS:
            starts.append(at)
            at = text.find(prefix, at + 1)
    stride = max(STRIDE, size // STRIDE)
    starts += range(stride, size, stride)
    for s in starts:
        for length in range(low, high + 1, max(1, (high - low) // 2)):
            if window := text[s : s + length]:
                yield window


def best_window(needle: str, text: str) -> tuple[float, str | None]:
    best, quote = -1.0, None
    for w in windows(needle, text):
        score = jaro_winkler(needle, w)
        if score > best:
            best, quote = score, w
    return (best, quote) if quote is not None and quote.strip() else (-1.0, None)


def exact_by_doc(leaves: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section of the leaf's document that contains its value: ``leaves`` with ``section_ord``."""
    found = leaves.join(sections.select("doc_id", "section_ord", "text"), "doc_id").where(F.instr("text", F.col("value")) > 0)
    return found.groupBy(*leaves.columns).agg(F.min("section_ord").alias("section_ord"))


def fuzzy_by_doc(leaves: DataFrame, sections: DataFrame) -> DataFrame:
    """The best-scoring section of the leaf's document, the earliest of equals: ``leaves`` with ``section_ord, quote, score``."""
    pairs = leaves.join(sections.select("doc_id", "section_ord", "text"), "doc_id").where((F.length("value") > 0) & (F.length("text") > 0))

    @F.pandas_udf("struct<score double, quote string>")
    def score(value: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(v, t) for v, t in zip(value, text, strict=True)], columns=["score", "quote"])

    scored = pairs.withColumn("m", score("value", "text")).where("m.score >= 0")
    best = F.max_by(F.struct("section_ord", "m"), F.struct("m.score", -F.col("section_ord"))).alias("b")
    return scored.groupBy(*leaves.columns).agg(best).select(*leaves.columns, "b.section_ord", "b.m.quote", "b.m.score")


def cite(leaves: DataFrame, sections: DataFrame) -> DataFrame:
    """Every leaf with ``section_ord, quote, score`` and its place: 1 for an exact match, else the best window's, else 0 without a section.

    A leaf is its document, path and value, so several values of one path are cited each.  The place
    is that of the section, by the columns of LOCATION it has; without a section it is the document's start.
    """
    key = ["doc_id", "path", "value"]
    leaves = leaves.where(F.col("value").isNotNull() & ~T.is_blank(F.col("value")))
    each = leaves.select(*key).distinct()
    exact = exact_by_doc(each, sections).select(*key, "section_ord", F.col("value").alias("quote"), F.lit(1.0).alias("score"))
    rest = each.join(exact.select(*key), key, "left_anti")
    near = fuzzy_by_doc(rest, sections).select(*key, "section_ord", "quote", "score")
    there = [c for c in LOCATION if c in sections.columns]
    found = exact.unionByName(near).join(sections.select("doc_id", "section_ord", *there).dropDuplicates(["doc_id", "section_ord"]), ["doc_id", "section_ord"], "left")
    out = leaves.join(found, key, "left")
    place = {c: F.coalesce(F.col(c) if c in there else F.lit(None), F.lit(at)).cast("long") for c, at in LOCATION.items()}
    return out.withColumns({"quote": F.coalesce("quote", "value"), "score": F.coalesce("score", F.lit(0.0)), **place})


def kept_citations(citations: DataFrame, required: tuple[str, ...] = (), provenance: bool = False, confidence: bool = False) -> DataFrame:
    """All citations if provenance or confidence is recorded, else those of required paths, else none."""
    if provenance or confidence:
        return citations
    return citations.where(F.col("path").isin(*required) if required else F.lit(False))


def exact_anywhere(items: DataFrame, sections: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, doc_id, pos, line_start`` of every section that contains an item's text.

    A text of enough words holds complete inner words, so sections and items
    meet by the hash of a run of ANCHOR_WORDS of them, the item's longest in characters, which
    is seldom a common one.  Only numbers are exploded and shuffled; the texts of
    sections that have met an item are fetched once.  Items with fewer words are
    looked for in every text, in blocks of SHORT_ITEMS.
    """
    n = ANCHOR_WORDS
    words = F.split("text", f"{T.SPACE}+")
    run = "xxhash64(" + ", ".join(f"_w[i + {k}]" for k in range(n)) + ")"
    item = items.select(F.col(key), F.col("text").alias("needle"), words.alias("_w")).where(F.length("needle") > 0)
    usable = F.size("_w") >= n + 2
    inner = F.expr(f"transform(sequence(1, size(_w) - {n + 1}), i -> struct(length(array_join(slice(_w, i + 1, {n}), ' ')) as size, -i as at, {run} as anchor))")
    long = item.where(usable).select(key, "needle", F.array_max(inner)["anchor"].alias("anchor"))
    texts = sections.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    hashed = sections.select("doc_id", F.xxhash64("text").alias("_h"), words.alias("_w")).where(F.size("_w") >= n)
    hashed = hashed.select("doc_id", "_h", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, size(_w) - {n}), i -> {run})"))).alias("anchor"))
    met = hashed.join(long, "anchor").select("doc_id", "_h", key, "needle").distinct()
    found = [texts.join(met, ["doc_id", "_h"]).where(F.instr("text", F.col("needle")) > 0)]
    short = item.where(~usable).select(key, "needle")
    blocks = -(-short.count() // SHORT_ITEMS)
    for b in range(blocks):
        few = short.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b)
        found.append(texts.join(F.broadcast(few), F.instr("text", F.col("needle")) > 0))
    start = F.instr("text", F.col("needle"))
    before = F.expr("substring(text, 1, instr(text, needle) - 1)")
    line = (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).cast("long")
    out = [f.select(F.col(key), "doc_id", start.alias("pos"), line.alias("line_start")) for f in found]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def rationale(score: Column) -> Column:
    return F.when(score >= 1.0, "quoted verbatim").when(score >= STRONG, "close to a quoted passage").when(score > 0, "weakly supported").otherwise("no supporting passage")


def gate_any_unsupported(citations: DataFrame, *by: str) -> DataFrame:
    """A result fails if any of its values has score 0."""
    return citations.groupBy(*by).agg(F.when(F.min("score") == 0, "EVIDENCE_MISSING").alias("error_code"))


def gate_required(required: DataFrame, citations: DataFrame, *by: str) -> DataFrame:
    """Required paths without a citation of STRONG score, ``by`` and ``path``."""
    strong = citations.where(F.col("score") >= STRONG).select(*by, "path")
    return required.join(strong, [*by, "path"], "left_anti")
