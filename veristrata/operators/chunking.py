"""Passages and parents of block-structured documents.

``blocks``: ``doc_id, block_ord, section_path array<string>, text`` (other
columns are carried).  Everything of one document meets in one shuffle by
``doc_id``; windows and folds reuse it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T


@dataclass(frozen=True)
class Profile:
    """Token budgets."""

    parent_min: int = 500
    parent_max: int = 1000
    passage_max: int = 256
    overlap: int = 40
    prefix_max: int = 48

    def __post_init__(self):
        if min(self.parent_min, self.parent_max, self.passage_max, self.prefix_max) <= 0:
            raise ValueError("token budgets must be positive")
        if self.parent_max < self.parent_min:
            raise ValueError("parent_max is below parent_min")
        if self.overlap >= self.passage_max:
            raise ValueError("overlap must be smaller than passage_max")


def passages(blocks: DataFrame, profile: Profile) -> DataFrame:
    """A row per window of ``passage_max`` tokens, ``overlap`` shared with the next; no window lies wholly in the overlap."""
    step = profile.passage_max - profile.overlap
    b = blocks.withColumn("_tokens", T.tokens(F.col("text"))).where(F.size("_tokens") > 0)
    length = F.length(F.array_join("_tokens", " ")) + 1
    earlier = W.partitionBy("doc_id").orderBy("block_ord").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_base", F.coalesce(F.sum(length).over(earlier), F.lit(0)))
    last = F.greatest(F.lit(0), F.ceil((F.size("_tokens") - profile.passage_max) / step)).cast("int")
    p = b.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    taken = F.slice("_tokens", F.col("k") * step + 1, F.lit(profile.passage_max))
    before = F.length(F.array_join(F.slice("_tokens", F.lit(1), F.col("k") * step), " "))
    p = p.withColumn("_taken", taken).withColumn("text", F.array_join("_taken", " "))
    start = F.col("_base") + F.when(F.col("k") > 0, before + 1).otherwise(0)
    p = p.withColumn("char_start", start.cast("long")).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("long"))
    p = p.withColumn("token_count", F.size("_taken").cast("long"))
    order = W.partitionBy("doc_id").orderBy("block_ord", "k")
    return p.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long")).drop("_tokens", "_base", "_taken", "k")


def with_parents(found: DataFrame, profile: Profile) -> DataFrame:
    """Passages with ``parent_index``: a parent ends at a new section path, when it is full enough, or before it would grow too long."""
    order = W.partitionBy("doc_id").orderBy("chunk_index")
    path = F.to_json(F.struct("section_path"))
    new = F.coalesce((F.lag(path).over(order) != path).cast("int"), F.lit(1))
    p = found.withColumn("_island", F.sum(new).over(order))
    # Within an island the tokens so far decide; the fold's state is (parent number, its tokens, numbers given).
    islands = p.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "token_count"))).alias("m"))
    zero = F.struct(F.lit(-1).alias("no"), F.lit(0).cast("long").alias("t"), F.array().cast("array<int>").alias("given"))

    def step(acc, x):
        n = x["token_count"]
        opens = (acc["no"] < 0) | (acc["t"] >= profile.parent_min) | (acc["t"] + n > profile.parent_max)
        no = acc["no"] + opens.cast("int")
        return F.struct(no.alias("no"), F.when(opens, n).otherwise(acc["t"] + n).alias("t"), F.array_append(acc["given"], no).alias("given"))

    numbers = islands.select("doc_id", "_island", F.explode(F.arrays_zip(F.col("m.chunk_index").alias("chunk_index"), F.aggregate("m", zero, step, lambda a: a["given"]).alias("no"))).alias("z"))
    numbers = numbers.select("doc_id", "_island", F.col("z.chunk_index").alias("chunk_index"), F.col("z.no").alias("_no"))
    p = p.drop("_island").join(numbers, ["doc_id", "chunk_index"])
    rank = F.dense_rank().over(W.partitionBy("doc_id").orderBy("_island", "_no"))
    return p.withColumn("parent_index", (rank - 1).cast("long")).drop("_island", "_no")


def parents(found: DataFrame) -> DataFrame:
    """A row per parent from passages with ``parent_index``; overlapping tokens count in each passage."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy("doc_id", "parent_index").agg(
        F.count("*").alias("n_passages"),
        F.sum("token_count").alias("token_count"),
        F.min_by("char_start", "chunk_index").alias("char_start"),
        F.max_by("char_end", "chunk_index").alias("char_end"),
        F.min_by("section_path", "chunk_index").alias("section_path"),
        texts.alias("text"),
    )


def rerank_text(citation: Column, section_path: Column, body: Column, profile: Profile) -> Column:
    """At most ``prefix_max`` tokens of citation and section path, then the text."""
    section = F.array_join(section_path, " > ")
    prefix = F.when(section == "", citation).otherwise(F.concat(citation, F.lit(". "), section))
    return F.concat(F.array_join(F.slice(T.tokens(prefix), 1, profile.prefix_max), " "), F.lit(". "), body)
