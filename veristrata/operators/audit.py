"""Results and their evidence: confidence, PROV-O audit documents, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators import evidence

#: Fixed value: the JSON-LD context of audit documents.
PROV = "http://www.w3.org/ns/prov#"
NAMESPACE = "evidence"


def confidence(citations: DataFrame, by: str = "result_id") -> DataFrame:
    """``by, confidence``: a map from path to score and its rationale."""
    entry = F.struct(F.col("path"), F.struct(F.col("score"), evidence.rationale(F.col("score")).alias("rationale")).alias("c"))
    return citations.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("confidence"))


def prov_documents(citations: DataFrame, provenance: DataFrame, by: str = "result_id") -> DataFrame:
    """``by, audit``: one JSON-LD document per result; ``provenance``: ``by, model, model_version, extracted_at``."""
    c = F.col
    place = F.struct(*[c(n).alias(a) for n, a in (("page_start", "pageStart"), ("page_end", "pageEnd"), ("line_start", "lineStart"), ("line_end", "lineEnd"), ("char_offset", "charOffset"))])
    source = F.struct(
        F.lit("prov:Entity").alias("@type"), c("path").alias(f"{NAMESPACE}:fieldPath"), c("quote").alias("prov:value"), c("score").alias(f"{NAMESPACE}:matchScore"), place.alias(f"{NAMESPACE}:sourceLocation")
    )
    sources = F.transform(F.array_sort(F.collect_list(F.struct(c("path"), source.alias("s")))), lambda x: x["s"])
    agent = F.struct(F.lit("prov:SoftwareAgent").alias("@type"), c("model").alias("rdfs:label"), c("model_version").alias("prov:version"))
    activity = F.struct(F.lit("prov:Activity").alias("@type"), F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("prov:startedAtTime"), agent.alias("prov:wasAssociatedWith"))
    document = F.struct(F.struct(F.lit(PROV).alias("prov")).alias("@context"), F.lit("prov:Entity").alias("@type"), activity.alias("prov:wasGeneratedBy"), c("sources").alias("prov:wasDerivedFrom"))
    return provenance.join(citations.groupBy(by).agg(sources.alias("sources")), by, "left").select(by, F.to_json(document).alias("audit"))


def signed(documents: DataFrame, sign=None) -> DataFrame:
    """``audit`` through a signing function of a Column, the identity by default."""
    return documents if sign is None else documents.withColumn("audit", sign(F.col("audit")))


def counts(citations: DataFrame, *by: str) -> DataFrame:
    """Fields, cited fields and weak matches."""
    return citations.groupBy(*by).agg(F.count("*").alias("fields"), F.count_if(F.col("score") > 0).alias("cited"), F.count_if(F.col("score") < evidence.STRONG).alias("weak"))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select(F.col("audit").alias("value")).write.mode("errorifexists").text(path)


def checked(value: Column, predicate: Column, message: str) -> Column:
    """The message where a constraint doesn't hold; an unknown outcome counts as failure."""
    return F.when(~F.coalesce(predicate, F.lit(False)), message)


def first_constraint(rows: DataFrame, fields: list[tuple[Column, str]], objects: list[tuple[Column, str]] = ()) -> DataFrame:
    """``rows`` with ``constraint_error``: all rules of single fields come before those of whole objects."""
    failures = [checked(F.lit(None), p, m) for p, m in [*fields, *objects]]
    return rows.withColumn("constraint_error", F.coalesce(*failures, F.lit(None).cast("string")))
