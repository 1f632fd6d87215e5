"""Section records: normalisation, search-feed rows, and preflight diagnostics as DataFrames.

A diagnostic is a row ``stage, idx, code, severity, path, message, source_id``.
Schemas and queries are small specifications given as Python values; records
are data and are only ever looked at by Columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import contracts

REQUIRED_TEXT = contracts.SECTION_TEXT
#: Fixed value: the document id prefix of the feed.
PUT_PREFIX = "id:legal:legal_doc::"
#: Lines of a file that are counted together.
BLOCK_LINES = 8192
#: The lanes that queries may use, and the codes ``E_...`` and ``W_...`` of all diagnostics below.
LANES = ("bm25", "fuzzy", "prefix", "dense")
DIAGNOSTIC = "stage string, idx long, code string, severity string, path string, message string, source_id string"


# ---- typed reading of JSON records -------------------------------------------------


def text_value(value: Column) -> Column:
    """A non-blank string trimmed, or a number's or boolean's own text; arrays and objects count as absent."""
    return _plain_text(T.trimmed(value))


def _plain_text(plain: Column) -> Column:
    nested = (plain.startswith("[") | plain.startswith("{")) & F.try_parse_json(plain).isNotNull()
    return F.when((plain == "") | nested, None).otherwise(plain)


def as_int(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))


def as_bool(text: Column) -> Column:
    value = F.lower(text)
    return F.when(value.isin("true", "1", "yes"), True).when(value.isin("false", "0", "no"), False)


def int_array(json: Column) -> Column:
    items = F.from_json(json, "array<string>")
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull()), F.array().cast("array<long>"))


def float_array(json: Column) -> Column:
    items = F.from_json(json, "array<string>")
    return F.filter(F.transform(items, lambda x: F.trim(x).try_cast("float")), lambda x: x.isNotNull())


def bound(rows: DataFrame, name: str, inputs: Column, build) -> DataFrame:
    """``rows`` with the column ``name = build(inputs)``, computed once a row in one lambda.

    No projection or filter above repeats the work, and the lambda is evaluated
    node by node, so a wide record makes no generated method that is too long to compile.
    """
    return rows.select("*", F.explode(F.transform(F.array(inputs), build)).alias(name))


#: The names under which records carry text fields, and arrays.
TEXT_FIELDS = (
    "doc_id", "parent_doc_id", "version_id", "section_number", "section_heading", "citation", "title", "jurisdiction", "source", "doc_type", "type",
    "document_type", "instrument_status", "status", "part_label", "division_label", "subdivision_label", "authority_type", "legal_authority_type",
    "court_name", "url", "source_locator", "locator", "page_locator", "source_format", "locator_confidence", "version_date", "decision_date", "date",
    "published_date", "effective_from", "effective_to", "body_text", "text", "body", "content", "section_ordinal", "authority_rank", "court_rank",
    "version_date_days", "effective_from_days", "effective_to_days", "page_start", "page_end", "char_start", "char_end", "is_current",
)
ARRAY_FIELDS = ("page_numbers", "dense_embedding_v1_256_native", "dense_embedding")


# ---- normalisation and feed --------------------------------------------------------


def normalise(records: DataFrame, json: str = "json") -> DataFrame:
    """Section fields of JSON records, by aliases and defaults; ``error`` names a required field that is absent."""
    # One parse into a record of texts: strings as they are, other values by their JSON text.
    schema = ", ".join(f"{n} string" for n in (*TEXT_FIELDS, *ARRAY_FIELDS))
    parsed = bound(records, "_m", F.col(json), lambda j: F.from_json(j, schema))
    read = bound(parsed, "_v", F.array(*[F.col("_m")[n] for n in TEXT_FIELDS]), lambda texts: F.transform(F.transform(texts, T.trimmed), _plain_text))
    inputs = F.struct(F.col("_v").alias("v"), *[F.col("_m")[n].alias(n) for n in ARRAY_FIELDS])
    made = bound(read, "_n", inputs, _section)
    kept = [c for c in records.columns if c not in made.schema["_n"].dataType.names]
    return made.select(*kept, "_n.*")


def _section(x: Column) -> Column:
    text = lambda *names: F.coalesce(*[x["v"][TEXT_FIELDS.index(n)] for n in names])
    number = lambda n: as_int(text(n))
    status = F.coalesce(text("instrument_status", "status"), F.lit("unknown"))
    doc_type, source = text("doc_type", "type", "document_type"), text("source")
    pages = int_array(x["page_numbers"])
    located = F.coalesce(text("source_locator", "locator", "page_locator"), number("page_start").cast("string"), number("page_end").cast("string")).isNotNull() | (F.size(pages) > 0)
    body = text("body_text", "text", "body", "content")
    plain = {n: text(n) for n in ("doc_id", "parent_doc_id", "version_id", "section_number", "section_heading", "citation", "title", "jurisdiction")}
    fields = plain | {
        "section_ordinal": number("section_ordinal"),
        "part_label": F.coalesce(text("part_label"), F.lit("")),
        "division_label": F.coalesce(text("division_label"), F.lit("")),
        "subdivision_label": text("subdivision_label"),
        "doc_type": doc_type,
        "source": source,
        "authority_type": F.coalesce(text("authority_type", "legal_authority_type"), T.authority_type(doc_type, source)),
        "authority_rank": F.coalesce(number("authority_rank"), T.authority_rank(doc_type, source)),
        "court_name": text("court_name"),
        "court_rank": number("court_rank"),
        "instrument_status": status,
        "is_current": F.coalesce(as_bool(text("is_current")), F.lower(status) == "current"),
        "version_date_days": F.coalesce(number("version_date_days"), T.date_number(text("version_date", "decision_date", "date", "published_date"))),
        "effective_from_days": F.coalesce(number("effective_from_days"), T.date_number(text("effective_from"))),
        "effective_to_days": F.coalesce(number("effective_to_days"), T.date_number(text("effective_to"))),
        "decision_date": text("decision_date", "date", "published_date"),
        "url": text("url"),
        "source_locator": text("source_locator", "locator", "page_locator"),
        "page_start": number("page_start"),
        "page_end": number("page_end"),
        "page_numbers": pages,
        "char_start": number("char_start"),
        "char_end": number("char_end"),
        "source_format": text("source_format"),
        "locator_confidence": F.coalesce(text("locator_confidence"), F.when(~located, "unavailable")),
        "body_text": T.clean(body),
        "dense_embedding": F.coalesce(float_array(x["dense_embedding_v1_256_native"]), float_array(x["dense_embedding"])),
    }
    needed = ("doc_type", "source", *plain, "section_ordinal")
    error = F.coalesce(*[F.when(fields[n].isNull(), n) for n in needed], F.when(body.isNull(), "body_text"))
    return F.struct(error.alias("error"), *[c.alias(n) for n, c in fields.items()])


#: Columns of sections that feed rows are made of.
_FED = (
    *contracts.SECTION_TEXT, "section_ordinal", "part_label", "division_label", "subdivision_label", "authority_rank", "is_current", "decision_date", "url", "source_locator", "source_format", "court_name", "locator_confidence",
    "page_start", "page_end", "page_numbers", "char_start", "char_end", "court_rank", "version_date_days", "effective_from_days", "effective_to_days", "dense_embedding",
)


def put(sections: DataFrame) -> DataFrame:
    """Feed rows ``put, fields`` (a struct) of valid sections; optional fields are null where absent, and so left out of JSON."""
    def row(x: Column) -> Column:
        c = lambda n: x[n]
        empty = lambda n: F.coalesce(c(n), F.lit(""))
        present = lambda n: F.when(~T.is_blank(c(n)), c(n))
        always = {
            **{n: c(n) for n in ("doc_id", "parent_doc_id", "version_id")},
            "chunk_type": F.lit("section"),
            "section_ordinal": c("section_ordinal"),
            "section_number": c("section_number"),
            "section_number_attr": F.lower(c("section_number")),
            "section_tokens": T.search_tokens(c("section_number")),
            "section_heading": c("section_heading"),
            "heading_tokens": T.search_tokens(c("section_heading")),
            "part_label": c("part_label"),
            "division_label": c("division_label"),
            "subdivision_label": empty("subdivision_label"),
            "citation": c("citation"),
            "citation_attr": F.lower(c("citation")),
            "citation_tokens": T.search_tokens(c("citation")),
            "title": c("title"),
            "title_tokens": T.search_tokens(c("title")),
            **{n: c(n) for n in ("jurisdiction", "doc_type", "source", "authority_type", "authority_rank", "instrument_status")},
            "is_current": c("is_current").cast("int"),
            "decision_date": empty("decision_date"),
            "url": empty("url"),
            "body_text": c("body_text"),
        }
        optional = {n: present(n) for n in ("source_locator", "source_format", "court_name", "locator_confidence")}
        optional |= {n: c(n) for n in ("page_start", "page_end", "char_start", "char_end", "court_rank", "version_date_days", "effective_from_days", "effective_to_days")}
        optional |= {"page_numbers": F.when(F.size(c("page_numbers")) > 0, c("page_numbers")), "dense_embedding_v1_256_native": c("dense_embedding")}
        return F.struct(*[v.alias(k) for k, v in (always | optional).items()])

    # Bound before the filter: its rules would else repeat what the sections are computed by.
    valid = sections.where(contracts.section().isNull())
    names = [n for n in sections.columns if n in _FED]
    fed = bound(valid, "_fields", F.struct(*names), row)
    return fed.select(F.concat(F.lit(PUT_PREFIX), "doc_id").alias("put"), F.col("_fields").alias("fields"))


# ---- preflight ---------------------------------------------------------------------


def diagnostic(code: str, path: Column, message: Column | str, severity: str = "error", source_id: Column | None = None) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    source_id = F.lit(None).cast("string") if source_id is None else source_id
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"), source_id.alias("source_id"))


def _rows(df: DataFrame, stage: str, index: str, found: list[Column]) -> DataFrame:
    kept = F.filter(F.array(*found), lambda d: d.isNotNull())
    return df.select(F.lit(stage).alias("stage"), F.col(index).cast("long").alias("idx"), F.explode(kept).alias("d")).select("stage", "idx", "d.*")


def vector_problem(v: Column, size: int) -> Column:
    """The first failing check of a vector: its size, finite values, unit length within a hundredth."""
    return (
        F.when(v.isNull(), None)
        .when(F.size(v) != size, "E_DENSE_VECTOR_DIMENSION_MISMATCH")
        .when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "E_DENSE_VECTOR_NON_FINITE")
        .when(~norm(v).between(0.99, 1.01), "E_DENSE_VECTOR_NORM_OUT_OF_RANGE")
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def section_diagnostics(sections: DataFrame, index: str = "idx", size: int = 256) -> DataFrame:
    """All problems of sections; a repeated id points at its previous occurrence."""
    at = lambda f: F.format_string(f"sections[%d].{f}", F.col(index).cast("long"))
    own = F.when(~T.is_blank(F.coalesce("doc_id", F.lit(""))), F.col("doc_id"))
    found = [F.when(contracts.missing(f).isNotNull(), diagnostic("E_REQUIRED_FIELD_EMPTY", at(f), f"{f} is empty", source_id=own)) for f in REQUIRED_TEXT]
    if "dense_embedding" in sections.columns:
        for code in ("E_DENSE_VECTOR_DIMENSION_MISMATCH", "E_DENSE_VECTOR_NON_FINITE", "E_DENSE_VECTOR_NORM_OUT_OF_RANGE"):
            found.append(F.when(vector_problem(F.col("dense_embedding"), size) == code, diagnostic(code, at("dense_embedding"), "vector can't be fed", source_id=own)))
    found.append(F.when(F.coalesce("section_ordinal", F.lit(0)) <= 0, diagnostic("E_FEED_TYPE_MISMATCH", at("section_ordinal"), "section_ordinal must be positive", source_id=own)))
    before = F.lag(index).over(W.partitionBy("doc_id").orderBy(index))
    found.append(F.when(F.col("_before").isNotNull(), diagnostic("E_DUPLICATE_DOCUMENT_ID", at("doc_id"), F.format_string("same id as sections[%d]", F.col("_before").cast("long")), source_id=own)))
    return _rows(sections.withColumn("_before", before), "sections", index, found)


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    index: bool = False
    attribute: bool = False
    fast_search: bool = False
    bm25: bool = False
    summary: bool = False
    required: bool = False


@dataclass(frozen=True)
class RankProfile:
    name: str
    bm25_fields: tuple[str, ...] = ()
    rerank_count: int | None = None


@dataclass(frozen=True)
class SchemaSpec:
    name: str
    fields: tuple[FieldSpec, ...]
    fieldset: tuple[str, ...] = ()
    rank_profiles: tuple[RankProfile, ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    ranking: str = "bm25_recall"
    filters: tuple[tuple[str, str], ...] = ()
    lanes: tuple[str, ...] = ()
    rerank_top_k: int | None = None
    total_target_hits: int | None = None
    #: An opaque query string; it is carried, never read.
    query: str | None = field(default=None, compare=False)


def _spec_frame(spark: SparkSession, schema: SchemaSpec) -> DataFrame:
    rows = [(k, f.name, f.type, f.index, f.attribute, f.fast_search, f.bm25, f.summary, f.required) for k, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "ord int, name string, type string, index boolean, attribute boolean, fast_search boolean, bm25 boolean, summary boolean, required boolean")


def _listed(rows: list[tuple[str, str]], stage: str) -> list[tuple]:
    return [(stage, k, code, "error", path, code.lower(), None) for k, (code, path) in enumerate(rows)]


def check_schema(spark: SparkSession, schema: SchemaSpec) -> DataFrame:
    """Contradictions inside one schema: roles that need others, names that don't exist."""
    by_name = {f.name: f for f in schema.fields}
    rows = []
    for f in schema.fields:
        if f.bm25 and not f.index:
            rows.append(("E_BM25_FIELD_NOT_INDEXED", f"schema.fields.{f.name}"))
        if f.fast_search and not f.attribute:
            rows.append(("E_FAST_SEARCH_NOT_ATTRIBUTE", f"schema.fields.{f.name}"))
    rows += [("E_FIELDSET_FIELD_MISSING", f"schema.fieldset.{n}") for n in schema.fieldset if n not in by_name]
    for p in schema.rank_profiles:
        for n in p.bm25_fields:
            if n not in by_name:
                rows.append(("E_RANK_FIELD_MISSING", f"schema.rank_profiles.{p.name}.{n}"))
            elif not (by_name[n].bm25 and by_name[n].index):
                rows.append(("E_RANK_FIELD_NOT_BM25", f"schema.rank_profiles.{p.name}.{n}"))
    return spark.createDataFrame(_listed(rows, "schema"), DIAGNOSTIC)


def compare_schemas(spark: SparkSession, expected: SchemaSpec, actual: SchemaSpec) -> DataFrame:
    """Drift of the actual from the expected schema; fields only the actual has are no drift."""
    e, a = _spec_frame(spark, expected), _spec_frame(spark, actual)
    roles = ("index", "attribute", "fast_search", "bm25", "summary")
    both = e.join(a.select("name", F.lit(True).alias("there"), *[F.col(c).alias(f"a_{c}") for c in ("type", *roles)]), "name", "left")
    path = F.concat(F.lit("schema.fields."), "name")
    found = [F.when(F.col("there").isNull(), diagnostic("E_SCHEMA_FIELD_MISSING", path, "field is missing")), F.when(F.col("type") != F.col("a_type"), diagnostic("E_SCHEMA_FIELD_TYPE", path, "type differs"))]
    found += [F.when(F.col(r) & ~F.col(f"a_{r}"), diagnostic("E_SCHEMA_FIELD_ROLE", F.concat(path, F.lit(f".{r}")), f"{r} is missing")) for r in roles]
    fields = _rows(both, "schema", "ord", found)
    rows = [] if expected.name == actual.name else [("E_SCHEMA_NAME", "schema.name")]
    rows += [("E_SCHEMA_FIELDSET", f"schema.fieldset.{n}") for n in expected.fieldset if n not in actual.fieldset]
    profiles = {p.name: p for p in actual.rank_profiles}
    for p in expected.rank_profiles:
        if p.name not in profiles:
            rows.append(("E_RANK_PROFILE_MISSING", f"schema.rank_profiles.{p.name}"))
        else:
            rows += [("E_RANK_PROFILE_FIELD", f"schema.rank_profiles.{p.name}.{n}") for n in p.bm25_fields if n not in profiles[p.name].bm25_fields]
    return check_schema(spark, actual).unionByName(spark.createDataFrame(_listed(rows, "schema"), DIAGNOSTIC)).unionByName(fields)


def query_diagnostics(queries: DataFrame, spark: SparkSession, schema: SchemaSpec) -> DataFrame:
    """Problems of queries ``query_id, ranking, filters array<struct<field,operator>>, lanes, rerank_top_k, total_target_hits``."""
    specs = F.broadcast(_spec_frame(spark, schema).select(F.col("name").alias("field"), "attribute", "fast_search"))
    ranks = F.broadcast(spark.createDataFrame([(p.name, p.rerank_count) for p in schema.rank_profiles], "ranking string, rerank_count long").withColumn("known", F.lit(True)))
    q = queries.join(ranks, "ranking", "left")
    k, most, hits = F.col("rerank_top_k"), F.col("rerank_count"), F.col("total_target_hits")
    whole = _rows(
        q,
        "query",
        "query_id",
        [
            F.when(F.col("known").isNull(), diagnostic("E_QUERY_RANK_PROFILE_MISSING", F.lit("query.ranking"), "no such rank profile")),
            F.when(k.isNotNull() & (most.isNull() | (k > most)), diagnostic("E_RERANK_TOPK_EXCEEDS_PROFILE", F.lit("query.rerank_top_k"), "more than the profile reranks")),
            F.when(k.isNotNull() & (hits < k), diagnostic("E_RERANK_TOPK_EXCEEDS_PROFILE", F.lit("query.total_target_hits"), "fewer hits than are reranked")),
        ],
    )
    f = queries.select("query_id", F.posexplode("filters").alias("i", "f")).select("query_id", "i", "f.field", "f.operator").join(specs, "field", "left")
    at = F.format_string("query.filters[%d].field", F.col("i").cast("long"))
    slow = F.col("operator").isin("prefix", "fuzzy") & ~F.col("fast_search")
    filters = _rows(f, "query", "query_id", [F.when(F.col("attribute").isNull(), diagnostic("E_QUERY_FIELD_MISSING", at, "no such field")), F.when(~F.col("attribute") | slow, diagnostic("E_FILTER_FIELD_NOT_ATTRIBUTE", at, "field can't be filtered so"))])
    lanes = queries.select("query_id", F.posexplode("lanes").alias("i", "lane"))
    off = _rows(lanes, "query", "query_id", [F.when(~F.col("lane").isin(*LANES), diagnostic("E_QUERY_USES_DISABLED_LANE", F.format_string("query.lanes[%d]", F.col("i").cast("long")), "lane is not enabled"))])
    return whole.unionByName(filters).unionByName(off)


def feed_diagnostics(feed: DataFrame, spark: SparkSession, schema: SchemaSpec, json: str = "json", index: str = "idx", size: int = 256) -> DataFrame:
    """Problems of feed operations ``{put, fields}``: fields absent, of another type, or unknown (a warning).

    A row's fields are a map, and all its problems are found in it at once: rows are neither joined nor shuffled.
    """
    ops = feed.select(F.col(index).cast("long").alias("idx"), F.expr(f"try_variant_get(try_parse_json({json}), '$.fields', 'map<string,variant>')").alias("fields"))
    at = F.format_string("feed[%d].fields", F.col("idx"))
    kinds = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.name, f.type)]) if schema.fields else F.lit(None).cast("map<string,string>")
    number = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    def problem(x: Column) -> Column:
        t, kind, val = x["t"], x["kind"], x["val"]
        items = F.call_function("try_variant_get", val, F.lit("$"), F.lit("array<variant>"))
        every = lambda test: F.coalesce(F.forall(items, test), F.lit(False))
        is_array = t.startswith("ARRAY")
        valid = (
            F.when(kind == "string", t == "STRING")
            .when(kind == "int", t == "BIGINT")
            .when(kind == "bool", t == "BOOLEAN")
            .when(kind == "array<string>", is_array & every(lambda i: F.schema_of_variant(i) == "STRING"))
            .when(kind == "array<int>", is_array & every(lambda i: F.schema_of_variant(i) == "BIGINT"))
            .when(kind.startswith("tensor"), is_array & (F.size(items) == size) & every(number))
            .otherwise(True)
        )
        path = F.format_string("feed[%d].fields.%s", F.col("idx"), x["name"])
        unknown = diagnostic("W_UNKNOWN_FEED_FIELD", path, "not in the schema", "warning")
        return F.when(kind.isNull(), unknown).when(~valid, diagnostic("E_FEED_TYPE_MISMATCH", path, "type differs"))

    entry = lambda e: F.struct(e["key"].alias("name"), e["value"].alias("val"), F.schema_of_variant(e["value"]).alias("t"), kinds[e["key"]].alias("kind"))
    seen = F.transform(F.transform(F.map_entries("fields"), entry), problem)
    names = F.array(*[F.lit(f.name) for f in schema.fields if f.required]).cast("array<string>")
    lost = F.transform(F.filter(names, lambda n: ~F.map_contains_key("fields", n)), lambda n: diagnostic("E_REQUIRED_FIELD_EMPTY", F.format_string("feed[%d].fields.%s", F.col("idx"), n), "field is absent"))
    found = F.when(F.col("fields").isNull(), F.array(diagnostic("E_FEED_FIELDS_NOT_OBJECT", at, "fields must be an object"))).otherwise(F.filter(F.concat(seen, lost), lambda d: d.isNotNull()))
    return ops.select(F.lit("feed").alias("stage"), "idx", F.explode(found).alias("d")).select("stage", "idx", "d.*")


def sections_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sections, diagnostics)`` of JSON lines ``path, line_no, json``.

    Sections count from zero among their file's lines that parse.  Lines that don't are
    E_JSONL_PARSE_FAILED by their number, other values than objects E_SECTION_PARSE_FAILED, and
    objects without a required field E_REQUIRED_FIELD_EMPTY; only whole ones are sections.
    """
    shape = F.schema_of_variant(F.try_parse_json("json"))
    seen = lines.withColumn("_shape", shape)
    broken = seen.where("_shape is null").select(F.lit("sections").alias("stage"), F.col("line_no").alias("idx"), F.explode(F.array(diagnostic("E_JSONL_PARSE_FAILED", F.format_string("sections:%d", F.col("line_no") + 1), "not JSON"))).alias("d"))
    # Counted in blocks of lines, after those of the blocks before, so that no task holds a whole file.
    values = seen.where("_shape is not null").withColumn("_block", F.floor(F.col("line_no") / BLOCK_LINES))
    earlier = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = values.groupBy("path", "_block").agg(F.count("*").alias("_n")).select("path", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(W.partitionBy("path", "_block").orderBy("line_no")) - 1
    values = values.withColumn("_here", here).join(blocks, ["path", "_block"]).withColumn("idx", (F.col("_before") + F.col("_here")).cast("long"))
    read = normalise(values.select("path", "line_no", "idx", "json", F.col("_shape").startswith("OBJECT").alias("_object")))
    at = F.format_string("sections[%d]", F.col("idx"))
    lost = F.when(~F.col("_object"), diagnostic("E_SECTION_PARSE_FAILED", at, "not an object")).when(F.col("error").isNotNull(), diagnostic("E_REQUIRED_FIELD_EMPTY", F.concat(at, F.lit("."), "error"), F.concat("error", F.lit(" is missing or empty"))))
    bad = read.where(~F.col("_object") | F.col("error").isNotNull()).select(F.lit("sections").alias("stage"), "idx", lost.alias("d"))
    return read.where("_object and error is null").drop("_object", "error"), broken.unionByName(bad).select("stage", "idx", "d.*")


#: The stages of a report, in order.
STAGES = ("schema", "sections", "feed", "query")


def united(*found: DataFrame) -> DataFrame:
    """Diagnostics of all stages with ``stage_no``, their place in the report."""
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("stage_no", F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")))


def _outcome(errors: Column) -> list[Column]:
    return [(errors > 0).alias("has_errors"), F.when(errors > 0, 1).otherwise(0).alias("exit_code")]


def stage_counts(diagnostics: DataFrame) -> DataFrame:
    """``stage_no, stage, errors, warnings, has_errors, exit_code`` of united diagnostics: counts by stage, the outcome of all; they are gone through once."""
    counts = diagnostics.groupBy("stage_no", "stage").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    # A row for each stage at most.
    return counts.select("*", *_outcome(F.sum("errors").over(W.partitionBy())))


def report(diagnostics: DataFrame, schema: str, feed_preview_count: int = 0) -> DataFrame:
    """The report's head as one row: ``report`` (JSON), ``has_errors``, ``exit_code``."""
    errors = F.count_if(F.col("severity") == "error")
    d = diagnostics.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    head = F.struct(F.lit(schema).alias("schema"), (F.col("errors") > 0).alias("has_errors"), "errors", "warnings", F.lit(feed_preview_count).alias("feed_preview_count"))
    return d.select(F.to_json(head).alias("report"), *_outcome(F.col("errors")))


def write_report(diagnostics: DataFrame, folder: str, schema: str, feed_preview_count: int = 0) -> int:
    """Write the head and, in stage order, all diagnostics as JSON lines; returns the exit code."""
    head = report(diagnostics, schema, feed_preview_count).first()
    spark = diagnostics.sparkSession
    spark.createDataFrame([(head.report,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/report")
    whole = diagnostics if "stage_no" in diagnostics.columns else united(diagnostics)
    whole.orderBy("stage_no", "idx", "path").select(F.to_json(F.struct(*[c for c in whole.columns if c != "stage_no"])).alias("value")).write.mode("errorifexists").text(f"{folder}/diagnostics")
    return head.exit_code


def has_errors(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_errors"))


def first_errors(diagnostics: DataFrame, n: int = 10) -> DataFrame:
    """The report's head: ``n`` errors in stage order."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return diagnostics.where("severity = 'error'").orderBy(order, "idx", "path").limit(n)


def convert(spark: SparkSession, records: DataFrame, out: str, json: str = "json") -> dict[str, int]:
    """Write the feed of all records, or nothing if any is malformed or invalid; returns the counts."""
    parsed = normalise(records.where(F.length(F.trim(json)) > 0).withColumn("_ok", F.coalesce(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), F.lit(False))), json)
    bad = F.col("error").isNotNull() | contracts.section().isNotNull()
    n = parsed.agg(F.count("*").alias("read"), F.count_if(~F.col("_ok")).alias("malformed"), F.count_if(F.col("_ok") & bad).alias("invalid")).first()
    counts = {"read": n.read, "malformed": n.malformed, "invalid": n.invalid, "written": 0}
    if not n.malformed and not n.invalid:
        put(parsed).select(F.to_json(F.struct("put", "fields")).alias("value")).write.mode("errorifexists").text(out)
        counts["written"] = n.read
    return counts
