"""Assembling the sections of a document into one bounded text.

``sections``: ``doc_id, section_ord`` and the variants' columns; a document's
sections meet in one row, since every strategy looks at them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINER = "\n\n"


def rendered(kind: Column, text: Column, rows: Column, caption: Column) -> Column:
    """A text as it is, a table by lines of cells, a figure by its caption."""
    table = F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")
    return F.when(kind == "table", table).when(kind == "figure", F.concat(F.lit("[Figure: "), caption, F.lit("]"))).otherwise(text)


def _in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("section_ord", *columns)))


def full_text(sections: DataFrame, by: str = "doc_id") -> DataFrame:
    joined = F.array_join(F.transform(_in_order("text"), lambda s: s["text"]), JOINER)
    return sections.groupBy(by).agg(joined.alias("context"))


def prefix_window(sections: DataFrame, window_chars: int, overlap_chars: int = 0, by: str = "doc_id") -> DataFrame:
    """The first ``window_chars`` characters of the document; the overlap is checked but has no effect."""
    if window_chars <= 0 or not 0 <= overlap_chars < window_chars:
        raise ValueError("window_chars must be positive, overlap_chars smaller and not negative")
    return full_text(sections, by).withColumn("context", F.substring("context", 1, window_chars))


def priority_truncate(sections: DataFrame, max_chars: int, patterns: list[str], strict: bool = False, by: str = "doc_id") -> DataFrame:
    """All sections if they fit; else those that contain a pattern, and then others in order while each fits.

    A later, shorter section may still fit after one that did not.  If the
    pattern's own sections are too long, they are taken alone, or ``strict``
    gives ``error_code`` CONTEXT_OVER_BUDGET and no text.  Returns
    ``by, context, n_picked, over_budget, error_code``.
    """
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.lower("text"), F.lit(p.lower()))
    marked = sections.withColumn("_hit", hit).withColumn("_n", F.length("text"))
    d = marked.groupBy(by).agg(_in_order("text", "_hit", "_n").alias("s"))
    gap = len(JOINER)
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["_n"] + gap) - gap
    first = F.filter("s", lambda x: x["_hit"])
    need = F.greatest(F.lit(0), F.aggregate(first, F.lit(0), lambda a, x: a + x["_n"] + gap) - gap)
    start = F.struct(need.alias("used"), (F.size(first) > 0).alias("any"), F.array().cast("array<boolean>").alias("pick"))

    def step(acc, x):
        cost = x["_n"] + F.when(acc["any"], gap).otherwise(0)
        fits = ~x["_hit"] & (acc["used"] + cost <= max_chars)
        return F.struct(
            F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), (acc["any"] | fits).alias("any"), F.array_append(acc["pick"], x["_hit"] | fits).alias("pick")
        )

    chosen = F.aggregate("s", start, step, lambda a: a["pick"])
    over = need > max_chars
    pick = F.when(F.col("_total") <= max_chars, F.transform("s", lambda x: F.lit(True))).when(F.col("_over"), F.transform("s", lambda x: x["_hit"])).otherwise(chosen)
    d = d.withColumn("_total", total).withColumn("_over", over & (total > max_chars)).withColumn("_pick", pick)
    kept = F.transform(F.filter(F.arrays_zip("s", F.col("_pick").alias("p")), lambda z: z["p"]), lambda z: z["s"]["text"])
    refused = F.col("_over") & F.lit(strict)
    return d.select(
        by,
        F.when(~refused, F.array_join(kept, JOINER)).alias("context"),
        F.when(refused, 0).otherwise(F.size(kept)).cast("long").alias("n_picked"),
        F.col("_over").alias("over_budget"),
        F.when(refused, "CONTEXT_OVER_BUDGET").alias("error_code"),
    )


def hierarchical(sections: DataFrame) -> DataFrame:
    raise NotImplementedError("hierarchical assembly is reserved")
