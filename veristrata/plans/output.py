"""What a run leaves behind: parsed documents, results with their audits, schemas, events."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The places of a section's location in its document's JSON.
PLACES = (("page_start", "pageStart"), ("page_end", "pageEnd"), ("line_start", "lineStart"), ("line_end", "lineEnd"), ("char_offset", "charOffset"))


def parsed_json(sections: DataFrame) -> DataFrame:
    """``doc_id, json``: a document a row, of sections ``doc_id, source_filename, page_count, section_ord, type, kind, text, rows, caption, bbox`` and the PLACES.

    A text has its kind, text and box, a table its rows, a figure its caption; what is absent is left out.
    """
    c = F.col
    place = F.struct(*[F.coalesce(c(n), F.lit(0 if n == "char_offset" else 1)).alias(a) for n, a in PLACES])
    only = lambda kind, n: F.when(c("type") == kind, c(n))
    section = F.struct(c("type"), place.alias("location"), only("text", "kind").alias("kind"), only("text", "text").alias("text"), only("text", "bbox").alias("boundingBox"), only("table", "rows").alias("rows"), only("figure", "caption").alias("caption"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("section_ord", F.to_json(section).alias("s")))), lambda x: x["s"])
    docs = sections.groupBy("doc_id").agg(F.first("source_filename").alias("sourceFilename"), F.first("page_count").alias("pageCount"), listed.alias("parts"))
    head = F.to_json(F.struct(F.col("doc_id").cast("string").alias("docId"), F.struct("sourceFilename", "pageCount").alias("metadata")))
    return docs.select("doc_id", F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"sections":['), F.array_join("parts", ","), F.lit("]}")).alias("json"))


def write_parsed(documents: DataFrame, path: str) -> None:
    documents.select(F.col("json").alias("value")).write.mode("errorifexists").text(path)


def run_id(now: datetime) -> str:
    """``run_`` and the instant's letters and digits."""
    at = now.astimezone(UTC).isoformat().replace("+00:00", "Z")
    return "run_" + "".join(ch for ch in at if ch.isalnum())


def write_run(results: DataFrame, audits: DataFrame, folder: str, now: datetime) -> str:
    """Results and audit documents as JSON lines in a folder of the run's own, which is returned."""
    place = f"{folder.rstrip('/')}/{run_id(now)}"
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("errorifexists").text(f"{place}/result")
    audits.select(F.col("audit").alias("value")).write.mode("errorifexists").text(f"{place}/audit")
    return place


def write_schema(spark: SparkSession, schema: dict, path: str) -> None:
    """A schema as one JSON document."""
    spark.createDataFrame([(json.dumps(schema, indent=2),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def audit_events(results: DataFrame, provider: str, by: str = "request_id", model_version: str = "unknown") -> DataFrame:
    """An event for each result, ``by, type, attributes``: of success with the tries made, of failure with its code."""
    good = F.col("error_code").isNull()
    won = F.create_map(F.lit("provider"), F.lit(provider), F.lit("modelVersion"), F.lit(model_version), F.lit("retries"), (F.col("attempts") - 1).cast("string"))
    lost = F.create_map(F.lit("provider"), F.lit(provider), F.lit("errorCode"), F.col("error_code"))
    return results.select(by, F.when(good, "extraction.success").otherwise("extraction.failed").alias("type"), F.when(good, won).otherwise(lost).alias("attributes"))


def corpus_stats(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over files ``path, doc_id, n_sections, error_code``: passed and failed, sections of those that passed, ids that several files share."""
    by = by or []
    good = F.col("error_code").isNull()
    n = F.when(good, F.col("n_sections"))
    whole = files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(good).alias("passed"), (F.count_if(good) / F.count("*")).alias("pass_rate"), F.min(n).alias("least"), F.median(n).alias("median"), F.max(n).alias("most"))
    shared = files.where("doc_id is not null").groupBy(*by, "doc_id").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.count_if(F.col("_n") > 1).alias("shared_ids"))
    return whole.join(shared, by, "left") if by else whole.crossJoin(F.broadcast(shared))


def error_codes(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("error_code", F.lit("none")).alias("error_code")).agg(F.count("*").alias("files"))
