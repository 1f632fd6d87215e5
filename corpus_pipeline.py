"""From raw documents to a training mix: five stages, each over all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)``; its result is written and read again as
the next one's ``docs``.  All but the last return the columns of documents.
Extra columns pass through all stages whatever their names; a table without rows
gives one without rows everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veristrata.llm import decontaminate, langid, mixing, near_dedup, pii
from veristrata.llm.session import col, crc_mod, free_names, join_checked, settle, table

#: A text is rejected if no language is clearly its own.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that fit no learned language; columns and texts stay as they are.

    Null, empty and letterless texts go; very long texts are judged whole; repeated rows are judged alike and all
    stay or go; rows with a null id are judged, not learned from; of languages that score alike the first by name
    counts.  Without a labelled row every text with a letter stays.
    """
    model = langid.train(langid.training_sample(docs, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))
    if model.net is None:
        return docs.where(F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("\\p{L}"))
    names = tuple(free_names(docs, "lang_pred", "score"))
    found = langid.identify(docs, model, *docs.columns, names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: five-word shingles, similarity 0.8.

    The row of the smallest id stays, a null id coming last; of several texts of that id the one of the least hash,
    of rows equal in id and text the first by their other columns.  So repeated rows, rows without an id and several
    texts of one id are judged each.  Null and empty texts are no copies of anything, but rows that repeat an id
    and its text are one.  Very long texts are compared whole.
    """
    (name,) = free_names(docs, "row_key")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn(name, F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), text.alias("text_key")))
    found = near_dedup.near_duplicates(rows, k=5, key=name).select(name, "kept")
    marked = settle(found.groupBy(name).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    repeated = settle(marked.where("kept").select(name))
    out = join_checked(rows, settle(marked.select(name)), [name], "left_anti")
    if repeated.head(1):
        # Rows that repeat an id and its text: ties of this order are the same in every column.
        number = F.row_number().over(Window.partitionBy(name).orderBy(*[col(c) for c in docs.columns if c not in ("doc_id", "text")]))
        (place,) = free_names(rows, "place")
        first = join_checked(rows, repeated, [name], "left_semi").withColumn(place, number).where(F.col(place) == 1).drop(place)
        out = out.unionByName(first)
    return out.select(*[col(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage.

    Null and empty texts hold none and stay; very long texts are searched whole; repeated rows and rows with a null
    id are judged by their texts alike.  Null or empty items are no passage; an empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays.

    Null and empty texts stay as they are; very long texts are searched whole; repeated rows are changed alike; of
    spans that overlap the first counts.
    """
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size, source_size, target, taken`` (words, repeats counted).

    Null, empty and wordless texts have size 0 and are not taken; a very long text is taken or left whole; a null
    source is a source of its own; repeated rows of an id are taken or left together.
    """
    return mixing.mix_by_source(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: The first two stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
