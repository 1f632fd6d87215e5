"""A fluent front: documents, a prompt, a schema, evidence; each step returns a new immutable plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.operators import audit, context, evidence, projection
from veristrata.plans import completion


@dataclass(frozen=True)
class Extraction:
    """``sections``: ``doc_id, section_ord, text``. Nothing runs before ``run``."""

    sections: DataFrame
    provider: Callable[[str, int], str]
    prompt: str
    schema: dict
    max_retries: int = 0
    required: tuple[str, ...] = ()
    evidence: bool = False
    assemble: Callable[[DataFrame], DataFrame] = context.full_text
    constraints: tuple[tuple[Column, str], ...] = field(default=())

    def with_evidence(self, *required: str) -> Extraction:
        return replace(self, evidence=True, required=required)

    def with_retries(self, n: int) -> Extraction:
        return replace(self, max_retries=n)

    def with_constraint(self, predicate: Column, message: str) -> Extraction:
        return replace(self, constraints=(*self.constraints, (predicate, message)))

    def with_context(self, assemble: Callable[[DataFrame], DataFrame]) -> Extraction:
        return replace(self, assemble=assemble)

    def run(self) -> tuple[DataFrame, DataFrame | None]:
        """``(results, citations)``; a result whose required paths lack strong evidence carries an error."""
        asked = self.assemble(self.sections).select("doc_id", F.concat(F.lit(self.prompt + "\n\n"), F.coalesce("context", F.lit(""))).alias("prompt"))
        rules = list(self.constraints)
        check = (lambda df: audit.first_constraint(df, rules).withColumnRenamed("constraint_error", "check_error")) if rules else None
        results = completion.complete(asked, self.provider, self.schema, check, self.max_retries, key="doc_id")
        if not self.evidence:
            return results, None
        leaves = projection.flatten_json(results.where("error_code is null"), "doc_id", "response")
        cited = evidence.cite(leaves, self.sections)
        if self.required:
            needed = results.where("error_code is null").select("doc_id", F.explode(F.array(*[F.lit(p) for p in self.required])).alias("path"))
            weak = evidence.gate_required(needed, cited, "doc_id").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("_weak"))
            results = results.join(weak, "doc_id", "left")
            results = results.withColumn("error_code", F.when(F.col("_weak").isNotNull(), "EXTRACTION_EVIDENCE_MISSING").otherwise(F.col("error_code"))).withColumn("error", F.coalesce("_weak", "error")).drop("_weak")
        return results, cited


def extract(sections: DataFrame, provider: Callable[[str, int], str], prompt: str, schema: dict) -> Extraction:
    return Extraction(sections, provider, prompt, schema)
