"""The registered queries over the driver's tables and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import json_schema
from veristrata.functions import text as T
from veristrata.operators import audit, chunking, context, contracts, evidence, feed, layout, projection
from veristrata.plans import completion, output
from veristrata.sources import files, scratch

PROFILE = chunking.Profile(parent_min=60, parent_max=120, passage_max=40, overlap=8, prefix_max=12)
WS = T.SPACE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores (one small file) is dealt out before heavy work by the row; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- shared SQL --------------------------------------------------------------------


def _clean_sql(c: str) -> str:
    out = f"regexp_replace({c}, '^\\x{{FEFF}}+', '')"
    for entity, plain in T.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    out = f"translate({out}, ' {T.DASHES}', ' {'-' * len(T.DASHES)}')"
    out = f"regexp_replace({out}, '\\r\\n?', chr(10), 'g')"
    out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: trim(regexp_replace(l, '{WS}+', ' ', 'g'))), chr(10))"
    return f"regexp_replace(regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


def _slug_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda t: t <> '')"


# ---- text --------------------------------------------------------------------------


def _cleaned(df: DataFrame, key: str, source: str) -> DataFrame:
    c = T.clean(F.col(source))
    d = df.select(key, F.col(source).alias("_o"), c.alias("_c"))
    return d.select(key, F.length("_c").cast("long").alias("clean_len"), T.full_lines(F.col("_c")).alias("line_count"), (F.col("_c") != F.col("_o")).alias("changed"), F.sha2("_c", 256).alias("clean_sha256"))


def _cleaned_sql(key: str, source: str, name: str) -> str:
    return f"SELECT {key}, length(c)::BIGINT AS clean_len, len(list_filter(string_split(c, chr(10)), lambda l: l <> ''))::BIGINT AS line_count, c <> o AS changed, sha256(c) AS clean_sha256 FROM (SELECT {key}, {source} AS o, {_clean_sql(source)} AS c FROM {name})"


def clean_text_documents(spark, d):
    return _cleaned(dealt(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def clean_text_pages(spark, d):
    return _cleaned(dealt(table(spark, d, "pages").select("page_id", "html")), "page_id", "html")


def search_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(T.search_tokens(F.col("url"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


SEARCH_TOKENS = "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY p) - 1)::BIGINT AS pos, token FROM (SELECT page_id, token, min(i) AS p FROM (SELECT page_id, unnest(ts) AS token, unnest(range(len(ts))) AS i FROM (SELECT page_id, regexp_extract_all(lower(url), '[a-z0-9]+') AS ts FROM pages)) GROUP BY page_id, token)"


def stable_ids(spark, d):
    name = F.when(F.col("p_partkey") == 1, "隐私法").otherwise(F.col("p_name"))
    p = table(spark, d, "part").select(F.col("p_partkey"), name.alias("n"))
    return p.select("p_partkey", T.slug(F.col("n")).alias("slug"), T.chunk_id(F.col("n"), "passage", F.col("p_partkey")).alias("chunk_id"), F.sha2("n", 256).alias("hash"))


STABLE_IDS = f"SELECT p_partkey, {_slug_sql('n')} AS slug, CASE WHEN {_slug_sql('n')} = '' THEN 'hash-' || substr(sha256(n), 1, 12) ELSE {_slug_sql('n')} END || '::passage::' || CASE WHEN p_partkey < 10000 THEN lpad(p_partkey::VARCHAR, 4, '0') ELSE p_partkey::VARCHAR END AS chunk_id, sha256(n) AS hash FROM (SELECT p_partkey, CASE WHEN p_partkey = 1 THEN '隐私法' ELSE p_name END AS n FROM part)"


def dates_and_authority(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Act", "Contract", "guideline", "Case note", "judgment", "memo")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    source = F.element_at(F.array(F.lit("Regulator"), F.lit("court"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", T.date_number(day).alias("day_number"), T.authority_type(kind, source).alias("authority_type"), T.authority_rank(kind, source).alias("authority_rank"), T.last_segment(F.concat(F.lit("id:a:b::"), F.col("o_orderkey").cast("string"))).alias("bare_id"))


DATES = """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d')::BIGINT AS day_number,
  lower((['Act', 'Contract', 'guideline', 'Case note', 'judgment', 'memo'])[(o_orderkey % 6 + 1)::INT]) AS k, lower((['Regulator', 'court', 'other'])[(o_orderkey % 3 + 1)::INT]) AS s FROM orders),
a AS (SELECT *, CASE WHEN contains(k, 'act') OR contains(k, 'legislation') THEN 'legislation' WHEN contains(s, 'oaic') OR contains(s, 'regulator') OR contains(k, 'guideline') THEN 'regulator_guidance' WHEN contains(k, 'case') OR contains(k, 'judgment') THEN 'case_law' ELSE 'other' END AS authority_type FROM o)
SELECT o_orderkey, day_number, authority_type, CASE authority_type WHEN 'legislation' THEN 90 WHEN 'case_law' THEN 80 WHEN 'regulator_guidance' THEN 70 ELSE 10 END::BIGINT AS authority_rank, o_orderkey::VARCHAR AS bare_id FROM a
"""

# ---- chunking ----------------------------------------------------------------------


def _blocks(spark, d) -> DataFrame:
    lines = dealt(table(spark, d, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("block_ord", "text"))
    path = F.array(F.col("lang"), F.concat(F.lit("s"), F.floor(F.col("block_ord") / 10).cast("string")))
    return lines.select("doc_id", "block_ord", path.alias("section_path"), "text")


_PASSAGES = f"""
b AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS block_ord FROM documents),
w AS (SELECT doc_id, lang, block_ord, {_tokens_sql("t")} AS ts FROM b),
c AS (SELECT *, coalesce(sum(length(array_to_string(ts, ' ')) + 1) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w WHERE len(ts) > 0),
k AS (SELECT *, unnest(generate_series(0, greatest(0, ceil((len(ts) - 40) / 32.0)::INT))) AS k FROM c),
g AS (SELECT *, array_to_string(ts[k * 32 + 1:k * 32 + 40], ' ') AS text, (base + CASE WHEN k > 0 THEN length(array_to_string(ts[1:k * 32], ' ')) + 1 ELSE 0 END)::BIGINT AS char_start, len(ts[k * 32 + 1:k * 32 + 40])::BIGINT AS token_count FROM k),
p AS (SELECT doc_id, block_ord, lang || '>s' || (block_ord // 10) AS sp, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY block_ord, k) - 1)::BIGINT AS chunk_index, char_start, char_start + length(text) AS char_end, token_count, text FROM g)
"""


def chunk_passages(spark, d):
    p = chunking.passages(_blocks(spark, d), PROFILE)
    return p.select("doc_id", "chunk_index", F.col("block_ord").cast("long").alias("block_ord"), "char_start", "char_end", "token_count", F.sha2("text", 256).alias("text_hash"))


CHUNK_PASSAGES = f"WITH {_PASSAGES} SELECT doc_id, chunk_index, block_ord::BIGINT AS block_ord, char_start, char_end::BIGINT AS char_end, token_count, sha256(text) AS text_hash FROM p"


def chunk_parents(spark, d):
    p = chunking.parents(chunking.with_parents(chunking.passages(_blocks(spark, d), PROFILE), PROFILE))
    return p.select("doc_id", "parent_index", "n_passages", "token_count", "char_start", "char_end", F.sha2("text", 256).alias("text_hash"))


CHUNK_PARENTS = f"""
WITH RECURSIVE {_PASSAGES},
n AS MATERIALIZED (SELECT *, lag(sp) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM p),
r AS (
  SELECT doc_id, chunk_index, 0::BIGINT AS parent_index, token_count AS t FROM n WHERE chunk_index = 0
  UNION ALL
  SELECT n.doc_id, n.chunk_index, r.parent_index + CASE WHEN n.before <> n.sp OR r.t >= 60 OR r.t + n.token_count > 120 THEN 1 ELSE 0 END,
    CASE WHEN n.before <> n.sp OR r.t >= 60 OR r.t + n.token_count > 120 THEN n.token_count ELSE r.t + n.token_count END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.chunk_index = r.chunk_index + 1
)
SELECT doc_id, parent_index, count(*) AS n_passages, sum(n.token_count)::BIGINT AS token_count, min_by(char_start, chunk_index) AS char_start, max_by(char_end, chunk_index)::BIGINT AS char_end, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS text_hash
FROM r JOIN n USING (doc_id, chunk_index) GROUP BY doc_id, parent_index
"""


def rerank_text(spark, d):
    p = chunking.passages(_blocks(spark, d), PROFILE)
    citation = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" of the collected writings"))
    return p.select("doc_id", "chunk_index", F.sha2(chunking.rerank_text(citation, F.col("section_path"), F.col("text"), PROFILE), 256).alias("rerank_hash"))


RERANK = f"WITH {_PASSAGES} SELECT doc_id, chunk_index, sha256(array_to_string((string_split('Doc ' || doc_id || ' of the collected writings. ' || lang || ' > s' || (block_ord // 10), ' '))[1:12], ' ') || '. ' || text) AS rerank_hash FROM p"

# ---- evidence ----------------------------------------------------------------------


def cite_exact(spark, d):
    docs, items = dealt(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark")
    found = evidence.exact_anywhere(items, docs)
    best = found.groupBy("item_id").agg(F.min(F.struct("doc_id", "line_start", "pos")).alias("b"), F.count("*").alias("n_docs"))
    out = items.select("item_id").join(best, "item_id", "left")
    return out.select("item_id", F.col("b.doc_id").alias("doc_id"), F.coalesce("b.line_start", F.lit(1)).cast("long").alias("line_start"), F.coalesce(F.col("b.pos") - 1, F.lit(0)).cast("long").alias("char_offset"), F.when(F.col("b").isNotNull(), 1.0).otherwise(0.0).alias("match_score"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


_CITE = "f AS (SELECT b.item_id, d.doc_id, strpos(d.text, b.text) AS pos, d.text FROM benchmark b JOIN documents d ON contains(d.text, b.text)), g AS (SELECT *, length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) + 1 AS line_start FROM f)"
CITE_EXACT = f"WITH {_CITE}, m AS (SELECT item_id, min(doc_id) AS doc_id, min_by(line_start, doc_id) AS line_start, min_by(pos, doc_id) AS pos, count(*) AS n FROM g GROUP BY item_id) SELECT b.item_id, m.doc_id, coalesce(m.line_start, 1)::BIGINT AS line_start, coalesce(m.pos - 1, 0)::BIGINT AS char_offset, CASE WHEN m.doc_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS match_score, coalesce(m.n, 0)::BIGINT AS n_docs FROM benchmark b LEFT JOIN m USING (item_id)"


def cite_exact_summary(spark, d):
    c = cite_exact(spark, d).withColumnRenamed("match_score", "score")
    source = table(spark, d, "documents").select("doc_id", "source")
    return audit.counts(c.join(source, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("none"))), "source")


CITE_SUMMARY = f"WITH c AS ({CITE_EXACT}) SELECT coalesce(d.source, 'none') AS source, count(*) AS fields, count(*) FILTER (match_score > 0) AS cited, count(*) FILTER (match_score < 0.85) AS weak FROM c LEFT JOIN documents d USING (doc_id) GROUP BY 1"


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    """Sections are turns in ASCII (the oracle's similarity counts bytes); a conversation's leaf is a stretch of its last turn, altered."""
    c = table(spark, d, "conversations")
    sections = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_ord"), (F.col("turn") + 5).alias("line_start"), F.regexp_replace("text", "[^\\x00-\\x7F]", "?").alias("text"))
    last = sections.groupBy("doc_id").agg(F.max_by("text", "section_ord").alias("t"))
    quote = F.translate(F.substring("t", 3, 40), "aeo", "xzq")
    return sections, last.select("doc_id", F.lit("quote").alias("path"), quote.alias("value"))


def cite_fuzzy(spark, d):
    sections, leaves = _turns(spark, d)
    c = evidence.cite(leaves, sections)
    return c.select("doc_id", F.col("section_ord").cast("long").alias("section_ord"), "line_start", F.length("quote").cast("long").alias("quote_len"), F.round("score", 4).alias("score"))


CITE_FUZZY = rf"""
WITH s AS (SELECT conv_id AS doc_id, turn AS section_ord, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM conversations),
l AS (SELECT doc_id, translate(substr(max_by(text, section_ord), 3, 40), 'aeo', 'xzq') AS v FROM s GROUP BY doc_id),
leaf AS (SELECT * FROM l WHERE v IS NOT NULL AND regexp_replace(v, '{WS}+', '', 'g') <> ''),
e AS (SELECT doc_id, v, min(section_ord) AS section_ord FROM leaf JOIN s USING (doc_id) WHERE contains(text, v) GROUP BY doc_id, v),
r AS (SELECT * FROM leaf WHERE doc_id NOT IN (SELECT doc_id FROM e)),
j AS (SELECT r.doc_id, r.v, s.section_ord, s.text, length(r.v) AS n, length(s.text) AS size FROM r JOIN s USING (doc_id) WHERE length(s.text) > 0),
h AS (SELECT *, list_filter(range(size - length(substr(v, 1, 5)) + 1), lambda i: substr(text, i + 1, length(substr(v, 1, 5))) = substr(v, 1, 5))[1:8] AS hits FROM j),
w AS (SELECT *, greatest(1, n * 4 // 5) AS lo, least(size, ceil(n * 6 / 5.0)::BIGINT) AS hi, list_concat(list_concat([0], CASE WHEN trim(substr(v, 1, 5)) = '' THEN [] ELSE hits END), range(greatest(8, size // 8), size, greatest(8, size // 8))) AS starts FROM h),
p AS (SELECT *, unnest(starts) AS s0, unnest(range(len(starts))) AS o FROM w),
q AS (SELECT doc_id, v, section_ord, o, ln, substr(text, s0 + 1, ln) AS win FROM (SELECT *, unnest(generate_series(lo, hi, greatest(1, (hi - lo) // 2))) AS ln FROM p) WHERE s0 < size),
z AS (SELECT *, jaro_winkler_similarity(v, win) AS sc FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY sc DESC, o, ln) AS rn FROM z),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, section_ord) AS best FROM t WHERE rn = 1 AND trim(win) <> '')
SELECT leaf.doc_id, coalesce(e.section_ord, u.section_ord)::BIGINT AS section_ord, coalesce(e.section_ord + 5, u.section_ord + 5, 1)::BIGINT AS line_start, length(coalesce(e.v, u.win, leaf.v))::BIGINT AS quote_len, round(CASE WHEN e.doc_id IS NOT NULL THEN 1.0 ELSE coalesce(u.sc, 0.0) END, 4)::DOUBLE AS score
FROM leaf LEFT JOIN e USING (doc_id) LEFT JOIN (SELECT * FROM u WHERE best = 1) u ON u.doc_id = leaf.doc_id
"""


def evidence_gates(spark, d):
    c = cite_exact(spark, d).select(F.col("item_id"), (F.col("item_id") % 10).alias("result_id"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.col("match_score").alias("score"))
    typed = evidence.gate_any_unsupported(c, "result_id")
    lost = evidence.gate_required(c.select("result_id", "path"), c, "result_id").groupBy("result_id").agg(F.count("*").alias("n_missing"))
    return typed.join(lost, "result_id", "left").select("result_id", "error_code", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"))


GATES = f"WITH c AS ({CITE_EXACT}) SELECT item_id % 10 AS result_id, CASE WHEN min(match_score) = 0 THEN 'EVIDENCE_MISSING' END AS error_code, count(*) FILTER (match_score < 0.85) AS n_missing FROM c GROUP BY 1"


def prov_audit(spark, d):
    c = cite_exact(spark, d)
    cites = c.select((F.col("item_id") % 10).alias("result_id"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.lit("q").alias("quote"), F.col("match_score").alias("score"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "line_start", F.col("line_start").alias("line_end"), "char_offset")
    made = cites.select("result_id").distinct().select("result_id", F.lit("m").alias("model"), F.lit("1").alias("model_version"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("extracted_at"))
    docs = audit.prov_documents(cites, made)
    score = F.expr("aggregate(from_json(get_json_object(audit, '$[\\'prov:wasDerivedFrom\\']'), 'array<map<string,string>>'), 1D, (a, x) -> least(a, cast(x['evidence:matchScore'] as double)))")
    n = F.expr("json_array_length(get_json_object(audit, '$[\\'prov:wasDerivedFrom\\']'))")
    return docs.select("result_id", n.cast("long").alias("n_derived"), score.alias("min_score"))


PROV = f"WITH c AS ({CITE_EXACT}) SELECT item_id % 10 AS result_id, count(*) AS n_derived, min(match_score) AS min_score FROM c GROUP BY 1"

# ---- vectors, records, feeds -------------------------------------------------------


def vector_preflight(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")))
    sizes = e.select("vec_id", "v", F.explode(F.array(F.lit(64), F.lit(256))).alias("expected_dim"))
    code = F.when(F.col("expected_dim") == 64, feed.vector_problem(F.col("v"), 64)).otherwise(feed.vector_problem(F.col("v"), 256))
    return sizes.select("vec_id", F.col("expected_dim").cast("long").alias("expected_dim"), code.alias("code"), F.round(feed.norm(F.col("v")), 4).alias("norm"))


VECTORS = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: (x * 2)::FLOAT) ELSE embedding END AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM e)
SELECT vec_id, dim::BIGINT AS expected_dim, CASE WHEN len(v) <> dim THEN 'E_DENSE_VECTOR_DIMENSION_MISMATCH' WHEN norm < 0.99 OR norm > 1.01 THEN 'E_DENSE_VECTOR_NORM_OUT_OF_RANGE' END AS code, round(norm, 4) AS norm FROM n, (VALUES (64), (256)) t(dim)
"""


def duplicate_ids(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    before = F.lag("doc_id").over(W.partitionBy("key").orderBy("doc_id"))
    return s.select("doc_id", before.alias("prev_doc_id")).where("prev_doc_id is not null")


DUPLICATES = "SELECT * FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS prev_doc_id FROM documents) WHERE prev_doc_id IS NOT NULL"


def _records(spark, d) -> DataFrame:
    """JSON section records of the orders, with alias keys and faults by key."""
    k = F.col("o_orderkey")
    cell = F.when(k % 46 == 0, "0.5").when(k % 62 == 0, "NaN").otherwise("0.25")
    row = F.struct(
        F.concat(F.lit("o"), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string")).alias("doc_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent_doc_id"),
        F.lit("v1").alias("version_id"),
        F.when(k % 13 == 0, F.lit(0)).otherwise(k).alias("section_ordinal"),
        F.when(k % 11 != 0, k.cast("string")).otherwise(" ").alias("section_number"),
        F.col("o_orderpriority").alias("section_heading"),
        F.concat(F.lit(" Order "), k.cast("string"), F.lit(" ")).alias("citation"),
        F.when(k % 17 != 0, F.col("o_orderstatus")).alias("title"),
        F.lit("cth").alias("jurisdiction"),
        F.when(k % 2 == 0, "Act").alias("doc_type"),
        F.when(k % 2 == 1, "guideline").alias("type"),
        F.lit("register").alias("source"),
        F.when(k % 3 == 0, "Current").when(k % 3 == 1, "repealed").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(k % 5 == 0, "a &amp; b").otherwise("plain  text").alias("body"),
        F.when(k % 2 == 0, F.array_repeat(cell, F.when(k % 38 == 0, 3).otherwise(16))).alias("dense_embedding"),
    )
    orders = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate"))
    return orders.select(k, F.to_json(row).alias("json"))


_RECORDS = """
rec AS (SELECT o_orderkey AS k, 'o' || (o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END) AS doc_id, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_orderkey END AS ord,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey::VARCHAR END AS num, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Act' ELSE 'guideline' END AS doc_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'Current' WHEN 1 THEN 'repealed' ELSE 'unknown' END AS status, strftime(o_orderdate, '%Y%m%d')::BIGINT AS days, CASE WHEN o_orderkey % 5 = 0 THEN 'a & b' ELSE 'plain text' END AS body, o_orderpriority, o_custkey,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 46 = 0 THEN '0.5' WHEN o_orderkey % 62 = 0 THEN 'NaN' ELSE '0.25' END END AS cell, CASE WHEN o_orderkey % 38 = 0 THEN 3 ELSE 16 END AS dims FROM orders)
"""


def section_normalise(spark, d):
    n = feed.normalise(_records(spark, d))
    return n.select("o_orderkey", "doc_id", "doc_type", "authority_type", "authority_rank", "instrument_status", "is_current", "version_date_days", "citation", "body_text", "locator_confidence", "error")


NORMALISE = f"WITH {_RECORDS} SELECT k AS o_orderkey, doc_id, doc_type, CASE WHEN doc_type = 'Act' THEN 'legislation' ELSE 'regulator_guidance' END AS authority_type, CASE WHEN doc_type = 'Act' THEN 90 ELSE 70 END::BIGINT AS authority_rank, status AS instrument_status, lower(status) = 'current' AS is_current, days AS version_date_days, 'Order ' || k AS citation, body AS body_text, 'unavailable' AS locator_confidence, CASE WHEN num IS NULL THEN 'section_number' WHEN title IS NULL THEN 'title' END AS error FROM rec"


def section_preflight(spark, d):
    s = feed.normalise(_records(spark, d)).withColumn("idx", F.col("o_orderkey"))
    return feed.section_diagnostics(s, size=16).select("idx", "code", "path")


PREFLIGHT = f"""
WITH {_RECORDS}, l AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM rec)
SELECT k AS idx, 'E_REQUIRED_FIELD_EMPTY' AS code, 'sections[' || k || '].section_number' AS path FROM l WHERE num IS NULL
UNION ALL SELECT k, 'E_REQUIRED_FIELD_EMPTY', 'sections[' || k || '].title' FROM l WHERE title IS NULL
UNION ALL SELECT k, 'E_FEED_TYPE_MISMATCH', 'sections[' || k || '].section_ordinal' FROM l WHERE ord <= 0
UNION ALL SELECT k, 'E_DUPLICATE_DOCUMENT_ID', 'sections[' || k || '].doc_id' FROM l WHERE before IS NOT NULL
UNION ALL SELECT k, CASE WHEN dims <> 16 THEN 'E_DENSE_VECTOR_DIMENSION_MISMATCH' WHEN cell = 'NaN' THEN 'E_DENSE_VECTOR_NON_FINITE' ELSE 'E_DENSE_VECTOR_NORM_OUT_OF_RANGE' END, 'sections[' || k || '].dense_embedding' FROM l WHERE cell IS NOT NULL AND (dims <> 16 OR cell <> '0.25')
"""


def feed_put(spark, d):
    p = feed.put(feed.normalise(_records(spark, d)))
    j = p.select("put", F.to_json("fields").alias("j"))
    return j.select("put", F.size(F.json_object_keys("j")).cast("long").alias("n_fields"), F.sha2("j", 256).alias("fields_hash"))


#: All fields of a feed row in their order, as JSON.
FEED_PUT = f"""
WITH {_RECORDS}, f AS (SELECT *, doc_type = 'Act' AS act, CASE WHEN cell IS NULL THEN '' ELSE ',"dense_embedding_v1_256_native":[' || array_to_string(list_transform(range(dims), lambda i: CASE WHEN cell = 'NaN' THEN '"NaN"' ELSE cell END), ',') || ']' END AS vector,
  '["' || array_to_string(regexp_extract_all(lower(o_orderpriority), '[a-z0-9]+'), '","') || '"]' AS heading FROM rec WHERE num IS NOT NULL AND title IS NOT NULL AND ord > 0),
j AS (SELECT doc_id, cell, '{{"doc_id":"' || doc_id || '","parent_doc_id":"c' || o_custkey || '","version_id":"v1","chunk_type":"section","section_ordinal":' || ord || ',"section_number":"' || num || '","section_number_attr":"' || num || '","section_tokens":["' || num
  || '"],"section_heading":"' || o_orderpriority || '","heading_tokens":' || heading || ',"part_label":"","division_label":"","subdivision_label":"","citation":"Order ' || k || '","citation_attr":"order ' || k || '","citation_tokens":["order","' || k
  || '"],"title":"' || title || '","title_tokens":["' || lower(title) || '"],"jurisdiction":"cth","doc_type":"' || doc_type || '","source":"register","authority_type":"' || CASE WHEN act THEN 'legislation' ELSE 'regulator_guidance' END || '","authority_rank":' || CASE WHEN act THEN 90 ELSE 70 END
  || ',"instrument_status":"' || status || '","is_current":' || CASE WHEN status = 'Current' THEN 1 ELSE 0 END || ',"decision_date":"' || substr(days::VARCHAR, 1, 4) || '-' || substr(days::VARCHAR, 5, 2) || '-' || substr(days::VARCHAR, 7, 2) || '","url":"","body_text":"' || body
  || '","locator_confidence":"unavailable","version_date_days":' || days || vector || '}}' AS j FROM f)
SELECT 'id:legal:legal_doc::' || doc_id AS put, (30 + CASE WHEN cell IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_fields, sha256(j) AS fields_hash FROM j
"""

FEED_SCHEMA = feed.SchemaSpec(
    "orders",
    (
        feed.FieldSpec("doc_id", "string", attribute=True, required=True),
        feed.FieldSpec("title", "string", index=True, bm25=True, summary=True, required=True),
        feed.FieldSpec("rank", "int", attribute=True, fast_search=True),
        feed.FieldSpec("tokens", "array<string>", index=True),
        feed.FieldSpec("pages", "array<int>", attribute=True),
        feed.FieldSpec("current", "bool", attribute=True),
    ),
    ("title",),
    (feed.RankProfile("bm25_recall", ("title",)), feed.RankProfile("reranked", ("title",), 200)),
)


def _feed_found(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    doc = F.concat(F.lit('{"doc_id":"o'), k.cast("string"), F.lit('"'), F.when(k % 7 != 0, ',"title":"t"').otherwise(""), F.lit(',"rank":'), F.when(k % 5 == 0, '"high"').when(k % 5 == 1, "1.5").otherwise("3"))
    doc = F.concat(doc, F.lit(',"tokens":'), F.when(k % 3 == 0, '["a",1]').otherwise('["a"]'), F.lit(',"pages":'), F.when(k % 4 == 0, "[1,2.5]").otherwise("[1,2]"), F.when(k % 6 == 0, ',"extra":null').otherwise(""), F.lit(',"current":true}'))
    rows = dealt(table(spark, d, "orders").select("o_orderkey")).select(k.alias("idx"), F.concat(F.lit('{"put":"p","fields":'), F.when(k % 19 == 0, "[1]").otherwise(doc), F.lit("}")).alias("json"))
    return feed.feed_diagnostics(rows, spark, FEED_SCHEMA)


def feed_preflight(spark, d):
    return _feed_found(spark, d).select("idx", "code", "severity", "path")


FEED_PREFLIGHT = """
WITH o AS (SELECT o_orderkey AS k FROM orders), g AS (SELECT k FROM o WHERE k % 19 <> 0)
SELECT k AS idx, 'E_FEED_FIELDS_NOT_OBJECT' AS code, 'error' AS severity, 'feed[' || k || '].fields' AS path FROM o WHERE k % 19 = 0
UNION ALL SELECT k, 'E_REQUIRED_FIELD_EMPTY', 'error', 'feed[' || k || '].fields.title' FROM g WHERE k % 7 = 0
UNION ALL SELECT k, 'E_FEED_TYPE_MISMATCH', 'error', 'feed[' || k || '].fields.rank' FROM g WHERE k % 5 < 2
UNION ALL SELECT k, 'E_FEED_TYPE_MISMATCH', 'error', 'feed[' || k || '].fields.tokens' FROM g WHERE k % 3 = 0
UNION ALL SELECT k, 'E_FEED_TYPE_MISMATCH', 'error', 'feed[' || k || '].fields.pages' FROM g WHERE k % 4 = 0
UNION ALL SELECT k, 'W_UNKNOWN_FEED_FIELD', 'warning', 'feed[' || k || '].fields.extra' FROM g WHERE k % 6 = 0
"""


def _other_schema() -> feed.SchemaSpec:
    f = {x.name: x for x in FEED_SCHEMA.fields}
    return feed.SchemaSpec("orders2", (f["doc_id"], feed.FieldSpec("title", "string", bm25=True), feed.FieldSpec("rank", "long", fast_search=True), f["tokens"], f["pages"]), (), (feed.RankProfile("bm25_recall", ("body",)),))


def schema_compare(spark, d):
    return feed.compare_schemas(spark, FEED_SCHEMA, _other_schema()).select("code", "path")


SCHEMA_COMPARE = """
SELECT * FROM (VALUES ('E_BM25_FIELD_NOT_INDEXED', 'schema.fields.title'), ('E_FAST_SEARCH_NOT_ATTRIBUTE', 'schema.fields.rank'), ('E_RANK_FIELD_MISSING', 'schema.rank_profiles.bm25_recall.body'), ('E_SCHEMA_NAME', 'schema.name'), ('E_SCHEMA_FIELDSET', 'schema.fieldset.title'),
 ('E_RANK_PROFILE_FIELD', 'schema.rank_profiles.bm25_recall.title'), ('E_RANK_PROFILE_MISSING', 'schema.rank_profiles.reranked'), ('E_SCHEMA_FIELD_ROLE', 'schema.fields.title.index'), ('E_SCHEMA_FIELD_ROLE', 'schema.fields.title.summary'), ('E_SCHEMA_FIELD_TYPE', 'schema.fields.rank'),
 ('E_SCHEMA_FIELD_ROLE', 'schema.fields.rank.attribute'), ('E_SCHEMA_FIELD_MISSING', 'schema.fields.current')) t(code, path)
"""


def _query_found(spark, d) -> DataFrame:
    c = dealt(table(spark, d, "customer").select("c_custkey"))
    k = F.col("c_custkey")
    filters = F.array(F.struct(F.when(k % 3 == 0, "doc_id").when(k % 3 == 1, "title").otherwise("nothing").alias("field"), F.when(k % 2 == 0, "equals").otherwise("prefix").alias("operator")))
    lanes = F.array(F.lit("bm25"), F.when(k % 5 == 0, "sparse").otherwise("dense"))
    q = c.select(k.alias("query_id"), F.when(k % 7 == 0, "none").when(k % 7 < 4, "reranked").otherwise("bm25_recall").alias("ranking"), filters.alias("filters"), lanes.alias("lanes"), F.when(k % 4 != 0, (k % 4) * 80).cast("long").alias("rerank_top_k"), F.lit(100).cast("long").alias("total_target_hits"))
    return feed.query_diagnostics(q, spark, FEED_SCHEMA)


def query_preflight(spark, d):
    return _query_found(spark, d).select(F.col("idx").alias("query_id"), "code", "path")


QUERY_PREFLIGHT = """
WITH q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 4) * 80 END AS top, c_custkey % 7 AS r FROM customer)
SELECT k AS query_id, 'E_QUERY_RANK_PROFILE_MISSING' AS code, 'query.ranking' AS path FROM q WHERE r = 0
UNION ALL SELECT k, 'E_RERANK_TOPK_EXCEEDS_PROFILE', 'query.rerank_top_k' FROM q WHERE top IS NOT NULL AND (r = 0 OR r >= 4 OR top > 200)
UNION ALL SELECT k, 'E_RERANK_TOPK_EXCEEDS_PROFILE', 'query.total_target_hits' FROM q WHERE top > 100
UNION ALL SELECT k, 'E_QUERY_FIELD_MISSING', 'query.filters[0].field' FROM q WHERE k % 3 = 2
UNION ALL SELECT k, 'E_FILTER_FIELD_NOT_ATTRIBUTE', 'query.filters[0].field' FROM q WHERE k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 1)
UNION ALL SELECT k, 'E_QUERY_USES_DISABLED_LANE', 'query.lanes[1]' FROM q WHERE k % 5 = 0
"""

# ---- projection, schemas, constraints ----------------------------------------------


def fts_record(spark, d):
    e = table(spark, d, "events")
    rec = e.select("event_id", F.struct(F.col("event_type").alias("kind"), F.array(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("words")).alias("event"), F.from_json("props", "k bigint").alias("props"))
    p = projection.project(rec, [projection.Mapping("body", "event.words", "full_text", True), projection.Mapping("kind", "event.kind", "filter"), projection.Mapping("k", "props.k", "metadata"), projection.Mapping("gone", "props.absent", "metadata")])
    return p.select("event_id", F.col("full_text")["body"].alias("full_text"), F.col("filter")["kind"].alias("filter_kind"), F.col("metadata"), "error")


FTS_RECORD = """SELECT event_id, event_type || ' ' || user_id AS full_text, event_type AS filter_kind, '{"gone":[],"k":' || CASE WHEN json_extract_string(props, '$.k') IS NULL THEN '[]' ELSE '"' || json_extract_string(props, '$.k') || '"' END || '}' AS metadata, NULL::VARCHAR AS error FROM events"""


def fts_collection(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("how")))).alias("items"))
    p = projection.project_items(lines, "l_orderkey", "items", [projection.Mapping("how", "how", "full_text", True), projection.Mapping("part", "part", "sort")])
    return p.select("object_id", F.col("full_text")["how"].alias("how"), F.col("sort")["part"].alias("part"))


FTS_COLLECTION = "SELECT l_orderkey || '::' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1)::VARCHAR, 4, '0') AS object_id, l_returnflag || ' ' || l_linestatus AS how, l_partkey::VARCHAR AS part FROM lineitem"

ORDER_SCHEMA = {
    "type": "object",
    "properties": {
        "key": {"type": "integer", "minimum": 10},
        "status": {"type": "string", "enum": ["O", "F"]},
        "price": {"type": "number", "exclusiveMaximum": 300000},
        "priority": {"type": ["string", "null"], "pattern": "^[1-5]-", "maxLength": 8},
        "tags": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/tag"}},
        "rate": {"enum": [1.5, 2, "x"]},
        "word": {"pattern": "^\\p{L}+$"},
        "most": {"type": "number", "maximum": 10},
    },
    "required": ["key", "status", "tags"],
    "additionalProperties": False,
    "$defs": {"tag": {"anyOf": [{"type": "string", "minLength": 2}, {"type": "integer"}]}},
}


def json_schema_errors(spark, d):
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    k = F.col("o_orderkey")
    doc = F.concat(
        F.lit('{"key":'), F.when(k % 9 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")), F.when(k % 8 != 0, F.concat(F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"'))).otherwise(""),
        F.lit(',"price":'), F.format_string("%.2f", "o_totalprice"), F.lit(',"priority":'), F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))),
        F.lit(',"tags":'), F.when(k % 6 == 0, "[]").when(k % 6 == 1, '["ab","c"]').otherwise('["ab",3]'), F.when(k % 10 == 0, ',"more":1').otherwise(""),
        F.when(k % 12 == 0, ',"rate":1.5').when(k % 12 == 1, ',"rate":2').when(k % 12 == 2, ',"rate":2.5').otherwise(""), F.when(k % 14 == 0, ',"word":"é"').when(k % 14 == 1, ',"word":"1"').otherwise(""),
        F.when(k % 16 == 0, ',"most":1e30').when(k % 16 == 1, ',"most":10.0').when(k % 16 == 2, ',"most":123456789012345678901234567890').otherwise(""), F.when(k % 33 == 0, ',"key":1').otherwise(""), F.lit("}"),
    )
    errors = json_schema.validate(doc, ORDER_SCHEMA)
    return o.select("o_orderkey", errors.alias("e")).select("o_orderkey", F.size("e").cast("long").alias("n_errors"), F.array_join(F.array_sort("e"), "; ").alias("errors_text"))


JSON_SCHEMA_ERRORS = r"""
WITH e AS (SELECT o_orderkey, list_filter([
  CASE WHEN o_orderkey % 9 = 0 THEN '$.key expected integer but got number' WHEN o_orderkey < 10 THEN '$.key violates minimum 10' END,
  CASE WHEN o_orderkey % 8 = 0 THEN '$.status required field missing' WHEN o_orderstatus NOT IN ('O', 'F') THEN '$.status is not one of the allowed values' END,
  CASE WHEN round(o_totalprice, 2) >= 300000 THEN '$.price violates exclusiveMaximum 300000' END,
  CASE WHEN o_orderkey % 7 <> 0 AND length(o_orderpriority) > 8 THEN '$.priority violates maxLength 8' END,
  CASE WHEN o_orderkey % 7 <> 0 AND NOT regexp_matches(o_orderpriority, '^[1-5]-') THEN '$.priority violates pattern ^[1-5]-' END,
  CASE WHEN o_orderkey % 6 = 0 THEN '$.tags violates minItems 1' WHEN o_orderkey % 6 = 1 THEN '$.tags[1] did not match anyOf' END,
  CASE WHEN o_orderkey % 12 = 2 THEN '$.rate is not one of the allowed values' END, CASE WHEN o_orderkey % 14 = 1 THEN '$.word violates pattern ^\p{L}+$' END, CASE WHEN o_orderkey % 16 IN (0, 2) THEN '$.most violates maximum 10' END,
  CASE WHEN o_orderkey % 10 = 0 THEN '$.more additional property is not allowed' END], lambda x: x IS NOT NULL) AS e FROM orders),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 33 <> 0 THEN e END AS e FROM e)
SELECT o_orderkey, len(e)::BIGINT AS n_errors, array_to_string(list_sort(e), '; ') AS errors_text FROM p
"""


def field_constraints(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = audit.first_constraint(o, [(F.col("o_totalprice") > 1000, "price too low"), (F.col("o_orderstatus") != "P", "status is open")], [(F.col("c_acctbal") + F.col("o_totalprice") > 5000, "not covered")])
    return r.select("o_orderkey", F.col("constraint_error").alias("first_failure"))


CONSTRAINTS = "SELECT o_orderkey, CASE WHEN NOT o_totalprice > 1000 THEN 'price too low' WHEN o_orderstatus = 'P' THEN 'status is open' WHEN NOT c_acctbal + o_totalprice > 5000 THEN 'not covered' END AS first_failure FROM orders JOIN customer ON o_custkey = c_custkey"


def leaf_flatten(spark, d):
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("mode"))))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    r = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("head"), F.array("o_orderpriority", F.lit(" ")).alias("tags"), "lines").alias("v"))
    return projection.flatten_struct(r, "o_orderkey", "v")


LEAVES = """
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS i, l_linenumber, l_returnflag FROM lineitem)
SELECT o_orderkey, 'head.status' AS path, o_orderstatus AS value FROM orders WHERE o_orderkey IN (SELECT k FROM l)
UNION ALL SELECT o_orderkey, 'tags[0]', o_orderpriority FROM orders WHERE o_orderkey IN (SELECT k FROM l)
UNION ALL SELECT k, 'lines[' || i || '].n', l_linenumber::VARCHAR FROM l
UNION ALL SELECT k, 'lines[' || i || '].mode', l_returnflag FROM l
"""

# ---- context, layout, counts -------------------------------------------------------


def _sections(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("section_ord"), F.coalesce("text", F.lit("")).alias("text"))


def context_prefix(spark, d):
    c = context.prefix_window(_sections(spark, d), 600, by="conv_id")
    return c.select("conv_id", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("ctx_hash"))


CONTEXT_PREFIX = "SELECT conv_id, length(c)::BIGINT AS n_chars, sha256(c) AS ctx_hash FROM (SELECT conv_id, substr(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')), 1, 600) AS c FROM conversations GROUP BY conv_id)"
PATTERNS = ["tion", "ÜBER"]


def context_priority(spark, d):
    c = context.priority_truncate(_sections(spark, d), 700, PATTERNS, by="conv_id")
    return c.select("conv_id", "n_picked", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("ctx_hash"), "over_budget")


CONTEXT_PRIORITY = """
WITH RECURSIVE s AS (SELECT conv_id, coalesce(text, '') AS t, contains(lower(coalesce(text, '')), 'tion') OR contains(lower(coalesce(text, '')), 'über') AS hit, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS i FROM conversations),
a AS MATERIALIZED (SELECT conv_id, sum(n + 2) - 2 AS total, greatest(0, coalesce(sum(n + 2) FILTER (hit), 0) - 2) AS need, bool_or(hit) AS anyhit FROM s GROUP BY conv_id),
r AS (
  SELECT conv_id, 0::BIGINT AS i, need::BIGINT AS used, anyhit, FALSE AS pick FROM a
  UNION ALL
  SELECT r.conv_id, s.i, r.used + CASE WHEN NOT s.hit AND r.used + s.n + CASE WHEN r.anyhit THEN 2 ELSE 0 END <= 700 THEN s.n + CASE WHEN r.anyhit THEN 2 ELSE 0 END ELSE 0 END,
    r.anyhit OR (NOT s.hit AND r.used + s.n + CASE WHEN r.anyhit THEN 2 ELSE 0 END <= 700), s.hit OR r.used + s.n + CASE WHEN r.anyhit THEN 2 ELSE 0 END <= 700
  FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1
),
k AS (SELECT s.conv_id, s.i, s.t, a.total > 700 AND a.need > 700 AS over_budget, CASE WHEN a.total <= 700 THEN TRUE WHEN a.need > 700 THEN s.hit ELSE r.pick END AS pick FROM s JOIN a USING (conv_id) JOIN r ON r.conv_id = s.conv_id AND r.i = s.i)
SELECT conv_id, count(*) FILTER (pick) AS n_picked, length(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (pick), ''))::BIGINT AS n_chars, sha256(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (pick), '')) AS ctx_hash, bool_or(over_budget) AS over_budget FROM k GROUP BY conv_id
"""


def doc_stats(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("t"))
    s = lines.select("source", F.when(F.contains("t", F.lit(" | ")), "table").otherwise("text").alias("type"), F.lit(None).cast("struct<x0:double>").alias("bbox"))
    return layout.document_stats(s, "source")


DOC_STATS = "SELECT source, count(*) AS sections, count(*) FILTER (NOT contains(t, ' | ')) AS text, count(*) FILTER (contains(t, ' | ')) AS tables, 0::BIGINT AS figures, 0::BIGINT AS with_bbox FROM (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY source"


def block_classify(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    said = F.when(F.col("line_no") % 9 == 0, F.concat(F.lit("- "), F.col("t"))).when(F.col("line_no") % 9 == 1, F.concat(F.lit(" 12) "), F.col("t"))).when(F.col("line_no") % 9 == 2, T.upper_by_letter(F.col("t"))).otherwise(F.col("t"))
    height = F.when(F.col("line_no") % 9 == 3, 12.0).otherwise(10.0)
    # A column of its own, computed once a line.
    lines = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), said.alias("said"), height.alias("height"))
    return lines.select("doc_id", "line_no", layout.classified(F.col("said"), F.col("height"), F.lit(10.0), T.upper_by_letter).alias("kind"))


BLOCK_CLASSIFY = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
s AS (SELECT doc_id, n, CASE n % 9 WHEN 0 THEN '- ' || t WHEN 1 THEN ' 12) ' || t WHEN 2 THEN upper(t) ELSE t END AS x FROM l),
b AS (SELECT *, regexp_replace(x, '^[\t\n\x0B\f\r ]+', '') AS y, regexp_replace(x, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS h FROM s)
SELECT doc_id, n::BIGINT AS line_no, CASE WHEN y = '' THEN 'OTHER' WHEN substr(y, 1, 1) IN ('•', '▪', '*', '-', '·') OR regexp_matches(x, '^[\t\n\x0B\f\r ]*[0-9]+[.)][\t\n\x0B\f\r ]+') THEN 'LIST' WHEN n % 9 = 3 THEN 'HEADING'
  WHEN length(h) BETWEEN 5 AND 60 AND h = upper(h) AND regexp_matches(h, '\pL') AND length(regexp_replace(h, '[^\p{Nd}]', '', 'g')) / length(h) < 0.3 THEN 'HEADING' ELSE 'BODY' END AS kind FROM b
"""


def block_group(spark, d):
    """A glyph per word of the conversations: a line of six words, every third line lower than the spacing."""
    w = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    line = F.floor(F.col("seq") / 6)
    g = w.select("doc_id", "page", "seq", F.concat("word", F.lit(" ")).alias("u"), ((F.col("seq") % 6) * 10).cast("float").alias("x"), (20 + line * 12 + F.floor(line / 3) * 18).cast("float").alias("y"), F.lit(9.0).cast("float").alias("w"), F.lit(10.0).cast("float").alias("h"))
    b = layout.blocks(g)
    return b.select("doc_id", "page", "block_no", F.length("text").cast("long").alias("n_chars"), "line_start", F.round("avg_height", 4).alias("avg_height"))


BLOCK_GROUP = r"""
WITH w AS (SELECT conv_id AS doc_id, turn AS page, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS seq FROM conversations),
g AS (SELECT doc_id, page, seq, word || ' ' AS u, seq // 18 AS b, NOT regexp_matches(word || ' ', '^[\t\n\x0B\f\r ]*$') AS ink FROM w),
f AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY b) AS block_no FROM g WHERE ink),
e AS (SELECT doc_id, page, block_no, b, min(seq) AS s0, max(seq) AS s1 FROM f GROUP BY ALL),
t AS (SELECT e.doc_id, e.page, e.block_no, regexp_replace(string_agg(g.u, '' ORDER BY g.seq), '[\t\n\x0B\f\r ]+$', '') AS text FROM e JOIN g ON g.doc_id = e.doc_id AND g.page = e.page AND g.seq BETWEEN e.s0 AND e.s1 GROUP BY 1, 2, 3)
SELECT doc_id, page, block_no::BIGINT AS block_no, length(text)::BIGINT AS n_chars, (1 + coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY doc_id, page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line_start, 10.0::DOUBLE AS avg_height FROM t
"""


def bbox_normalise(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda i: F.abs(F.col("embedding")[i].cast("double")) * 1000
    b = layout.flipped_box(at(0), at(1), at(2), at(3), F.lit(400.0), F.lit(800.0))
    r = e.select("vec_id", b.alias("b")).where("b is not null")
    return r.select("vec_id", *[F.round(f"b.{n}", 4).alias(n) for n in ("x0", "y0", "x1", "y1")])


BBOX = """
WITH e AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 1000 AS l, abs(embedding[2]::DOUBLE) * 1000 AS b, abs(embedding[3]::DOUBLE) * 1000 AS r, abs(embedding[4]::DOUBLE) * 1000 AS t FROM embeddings),
c AS (SELECT vec_id, greatest(0, least(1000, l / 400 * 1000)) AS x0, greatest(0, least(1000, (800 - t) / 800 * 1000)) AS y0, greatest(0, least(1000, r / 400 * 1000)) AS x1, greatest(0, least(1000, (800 - b) / 800 * 1000)) AS y1 FROM e WHERE r > l AND t > b)
SELECT vec_id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM c WHERE x1 > x0 AND y1 > y0
"""


def registry_coverage(spark, d):
    n = table(spark, d, "nation")
    status = F.when(F.col("n_nationkey") % 3 == 0, "supported").otherwise("planned").alias("coverageStatus")
    a = n.where("n_nationkey <> 4").select(F.col("n_name").alias("sourceFamily"), status)
    b = n.where("n_nationkey <> 7").select(F.col("n_name").alias("sourceFamily"), F.when(F.col("n_nationkey") == 9, "planned").otherwise(F.when(F.col("n_nationkey") % 3 == 0, "supported").otherwise("planned")).alias("coverageStatus"))
    return files.registry_coverage(a, b)


REGISTRY = """
WITH n AS (SELECT n_name AS family, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'supported' ELSE 'planned' END AS s FROM nation),
a AS (SELECT family, CASE WHEN k <> 4 THEN s END AS registry_status, CASE WHEN k = 9 THEN 'planned' WHEN k <> 7 THEN s END AS coverage_status FROM n)
SELECT *, CASE WHEN coverage_status IS NULL THEN 'missing in coverage' WHEN registry_status IS NULL THEN 'missing in registry' WHEN registry_status <> coverage_status THEN 'status differs' END AS error FROM a
"""


def contract_errors(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    c = p.select(k, F.lit("c").alias("chunk_id"), F.when(k % 9 != 0, F.lit("d")).alias("doc_id"), F.when(k % 7 != 0, F.col("p_name")).otherwise("  ").alias("text"), F.lit("r").alias("rerank_text"), F.lit(5).alias("char_start"), F.when(k % 5 == 0, 4).otherwise(5).alias("char_end"), (k % 3).alias("token_count"))
    return c.select("p_partkey", contracts.chunk().alias("error"))


CONTRACTS = "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'doc_id is required' WHEN p_partkey % 7 = 0 THEN 'text is required' WHEN p_partkey % 5 = 0 THEN 'char_range is out of range' WHEN p_partkey % 3 = 0 THEN 'token_count must be positive' END AS error FROM part"


def completion_retry(spark, d):
    """Canned answers: some good at once, some after a repair, some never, some refused by the provider."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("r"), (F.col("c_custkey") % 4).cast("string")).alias("prompt"))

    def provider(prompt: str, attempt: int) -> str:
        if prompt.startswith("r3"):
            raise completion.ProviderError("PROVIDER_AUTH_FAILED", "refused", 401)
        return completion.canned({"r0": ['{"a": 1}'], "r1": ["no json", '{"a": 1}'], "r2": ['{"a": "x"}']})(prompt, attempt)

    out = completion.complete(c, provider, {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}, max_retries=2)
    return out.select("request_id", F.col("attempts").cast("long").alias("attempts"), "error_code")


COMPLETION = "SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS attempts, CASE c_custkey % 4 WHEN 2 THEN 'EXTRACTION_SCHEMA_VALIDATION_FAILED' WHEN 3 THEN 'PROVIDER_AUTH_FAILED' END AS error_code FROM customer"


def audit_events(spark, d):
    e = output.audit_events(completion_retry(spark, d), "canned")
    return e.select("request_id", "type", F.col("attributes")["retries"].alias("retries"), F.col("attributes")["errorCode"].alias("error_code"))


AUDIT_EVENTS = f"SELECT request_id, CASE WHEN error_code IS NULL THEN 'extraction.success' ELSE 'extraction.failed' END AS type, CASE WHEN error_code IS NULL THEN (attempts - 1)::VARCHAR END AS retries, error_code FROM ({COMPLETION})"

# ---- files, reports, outputs -------------------------------------------------------


def csv_files(spark, d):
    """The nations written as a CSV file for each region and read again as documents."""
    path = scratch.new_path(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").csv(path)
    rows = files.read_documents(spark, path).select("type", "page", F.explode("rows").alias("r"))
    return rows.select("type", F.col("page").cast("long").alias("page"), F.col("r")[0].alias("nation_key"), F.col("r")[1].alias("name"))


CSV_FILES = "SELECT 'table' AS type, 1::BIGINT AS page, n_nationkey::VARCHAR AS nation_key, n_name AS name FROM nation"


def pdf_files(spark, d):
    """A PDF file for each nation, its name over its suppliers' names, read from its bytes: blocks, lines, offsets, kinds, boxes."""
    path = scratch.new_path(spark, "pdf")
    named = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    said = named.groupBy("n_nationkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(F.lit("("), x["s_name"], F.lit(" ) Tj T*"))), "\n").alias("lines"))
    said.select("n_nationkey", F.concat(F.lit(PDF_HEAD), "n_name", F.lit(") Tj /F1 10 Tf 12 TL 0 -40 Td\n"), "lines", F.lit(PDF_TAIL)).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    rows = files.read_pdfs(spark, path, "*.txt")
    box = F.concat_ws(",", *[F.round(F.col("bbox")[c]).cast("long").cast("string") for c in ("x0", "y0")])
    key = F.regexp_extract("path", "n_nationkey=(\\d+)", 1).cast("long")
    return rows.select(key.alias("nation"), *[F.col(c).cast("long").alias(c) for c in ("page_count", "section_ord", "page", "line_start", "line_end", "char_offset")], "kind", "text", box.alias("corner"), "error_code")


PDF_HEAD = """%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 500 100000] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> /Contents 5 0 R >> endobj
4 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj
5 0 obj << >> stream
BT /F1 18 Tf 50 90000 Td ("""
PDF_TAIL = "ET\nendstream endobj\ntrailer << /Root 1 0 R >>"
PDF_FILES = """
WITH b AS (SELECT n_nationkey AS nation, n_name, string_agg(s_name, ' ' ORDER BY s_suppkey) AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT nation, 1::BIGINT AS page_count, i::BIGINT AS section_ord, 1::BIGINT AS page, i + 1::BIGINT AS line_start, i + 1::BIGINT AS line_end, CASE i WHEN 0 THEN 0 ELSE length(n_name) END::BIGINT AS char_offset,
  CASE i WHEN 0 THEN 'HEADING' ELSE 'BODY' END AS kind, CASE i WHEN 0 THEN n_name ELSE names END AS text, '100,100' AS corner, NULL::VARCHAR AS error_code
FROM b, (VALUES (0::BIGINT), (1::BIGINT)) AS v(i)
"""


def jsonl_sections(spark, d):
    """Section records as JSON lines, some broken or no objects: sections and diagnostics counted."""
    path = scratch.new_path(spark, "jsonl")
    k = F.col("o_orderkey")
    _records(spark, d).select(F.when(k % 41 == 0, "{").when(k % 43 == 0, "[1]").otherwise(F.col("json")).alias("value")).write.text(path)
    sections, found = feed.sections_of(files.read_json_lines(spark, path))
    counted = found.groupBy("code", F.regexp_replace("path", "^.*[.]|^sections.*$", "").alias("field")).agg(F.count("*").alias("n"))
    return counted.unionByName(sections.agg(F.lit("section").alias("code"), F.lit("").alias("field"), F.count("*").alias("n")))


JSONL_SECTIONS = f"""
WITH {_RECORDS}, c AS (SELECT CASE WHEN k % 41 = 0 THEN 'E_JSONL_PARSE_FAILED' WHEN k % 43 = 0 THEN 'E_SECTION_PARSE_FAILED' WHEN num IS NULL OR title IS NULL THEN 'E_REQUIRED_FIELD_EMPTY' ELSE 'section' END AS code, CASE WHEN k % 41 = 0 OR k % 43 = 0 THEN '' WHEN num IS NULL THEN 'section_number' WHEN title IS NULL THEN 'title' ELSE '' END AS field FROM rec)
SELECT code, field, count(*) AS n FROM c GROUP BY ALL
"""


def preflight_report(spark, d):
    """Diagnostics of all four stages as one report: counts by stage and the outcome."""
    rows = [feed.compare_schemas(spark, FEED_SCHEMA, _other_schema()), feed.section_diagnostics(feed.normalise(_records(spark, d)).withColumn("idx", F.col("o_orderkey")), size=16), _feed_found(spark, d), _query_found(spark, d)]
    counts = feed.stage_counts(feed.united(*rows))
    return counts.select(F.col("stage_no").cast("long").alias("stage_no"), "stage", "errors", "warnings", "has_errors", F.col("exit_code").cast("long").alias("exit_code"))


def first_errors(spark, d):
    found = _feed_found(spark, d)
    return feed.first_errors(found).select("idx", "code", "path").crossJoin(F.broadcast(feed.has_errors(found)))


FIRST_ERRORS = f"SELECT idx, code, path, TRUE AS has_errors FROM ({FEED_PREFLIGHT}) WHERE severity = 'error' ORDER BY idx, path LIMIT 10"
REPORT = f"""
SELECT k::BIGINT AS stage_no, stage, errors, warnings, TRUE AS has_errors, 1::BIGINT AS exit_code FROM (
  SELECT 1 AS k, 'schema' AS stage, count(*) AS errors, 0::BIGINT AS warnings FROM ({SCHEMA_COMPARE})
  UNION ALL SELECT 2, 'sections', count(*), 0 FROM ({PREFLIGHT})
  UNION ALL SELECT 3, 'feed', count(*) FILTER (severity = 'error'), count(*) FILTER (severity = 'warning') FROM ({FEED_PREFLIGHT})
  UNION ALL SELECT 4, 'query', count(*), 0 FROM ({QUERY_PREFLIGHT}))
"""


def parsed_documents(spark, d):
    """Benchmark items as parsed documents of a text, a table and a figure."""
    b = table(spark, d, "benchmark")
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("section_ord"), F.lit(t).alias("type")) for i, t in enumerate(("text", "table", "figure"))])).alias("s")
    s = b.select(F.col("item_id").alias("doc_id"), "text", kinds).select("doc_id", "text", "s.*")
    box = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(1.5).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.0).alias("y1")))
    s = s.select("*", F.concat(F.lit("b"), "doc_id", F.lit(".txt")).alias("source_filename"), F.lit(1).alias("page_count"), F.lit("BODY").alias("kind"), F.array(F.array("text", F.lit("x"))).alias("rows"), F.lit("a figure").alias("caption"), box.alias("bbox"))
    s = s.withColumns({n: F.lit(None).cast("int") for n in ("page_start", "page_end", "line_end", "char_offset")} | {"line_start": F.col("section_ord") + 1})
    return output.parsed_json(s).select("doc_id", F.length("json").cast("long").alias("n_chars"), F.sha2("json", 256).alias("json_hash"))


PARSED = """
WITH j AS (SELECT item_id AS doc_id, '{"docId":"' || item_id || '","metadata":{"sourceFilename":"b' || item_id || '.txt","pageCount":1},"sections":[{"type":"text","location":{"pageStart":1,"pageEnd":1,"lineStart":1,"lineEnd":1,"charOffset":0},"kind":"BODY","text":' || to_json(text)::VARCHAR
  || CASE WHEN item_id % 2 = 0 THEN ',"boundingBox":{"x0":1.5,"y0":2.0,"x1":3.0,"y1":4.0}' ELSE '' END || '},{"type":"table","location":{"pageStart":1,"pageEnd":1,"lineStart":2,"lineEnd":1,"charOffset":0},"rows":[[' || to_json(text)::VARCHAR || ',"x"]]},{"type":"figure","location":{"pageStart":1,"pageEnd":1,"lineStart":3,"lineEnd":1,"charOffset":0},"caption":"a figure"}]}' AS j FROM benchmark)
SELECT doc_id, length(j)::BIGINT AS n_chars, sha256(j) AS json_hash FROM j
"""


def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    read = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id"), F.size(F.split("text", "\n")).cast("long").alias("n_sections"), F.when(F.col("doc_id") % 9 == 0, "CSV_PARSE_FAILED").alias("error_code"), "source")
    return output.corpus_stats(read, ["source"])


CORPUS_STATS = """
WITH r AS (SELECT source, sha256(coalesce(text, '')) AS id, len(string_split(text, chr(10)))::BIGINT AS n, doc_id % 9 <> 0 AS good FROM documents),
s AS (SELECT source, count(*) FILTER (c > 1) AS shared_ids FROM (SELECT source, id, count(*) AS c FROM r GROUP BY ALL) GROUP BY source)
SELECT source, count(*) AS files, count(*) FILTER (good) AS passed, count(*) FILTER (good) / count(*) AS pass_rate, min(n) FILTER (good) AS least, median(n) FILTER (good)::DOUBLE AS median, max(n) FILTER (good) AS most, any_value(shared_ids) AS shared_ids FROM r JOIN s USING (source) GROUP BY source
"""


def page_kinds(spark, d):
    b = block_classify(spark, d).select("doc_id", F.floor(F.col("line_no") / 10).cast("long").alias("page"), "kind")
    return layout.page_kinds(b)


PAGE_KINDS = f"SELECT doc_id, line_no // 10 AS page, kind, count(*) AS n_blocks FROM ({BLOCK_CLASSIFY}) GROUP BY ALL"


def item_paths(spark, d):
    """Line items two arrays deep, projected each by a dotted path."""
    one = F.struct(F.array(F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("parts"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", one.alias("one")))), lambda x: x["one"])
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.struct(lines.alias("lines")).alias("order"))
    p = projection.project_items(orders, "l_orderkey", "order.lines.parts", [projection.Mapping("part", "part", "sort", True), projection.Mapping("flag", "flag", "filter")])
    return p.select("object_id", F.col("sort")["part"].alias("part"), F.col("filter")["flag"].alias("flag"), "error")


ITEM_PATHS = "SELECT l_orderkey || '::' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1)::VARCHAR, 4, '0') AS object_id, l_partkey::VARCHAR AS part, l_returnflag AS flag, NULL::VARCHAR AS error FROM lineitem"


def confidence_map(spark, d):
    c = cite_exact(spark, d).select((F.col("item_id") % 10).alias("result_id"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.col("match_score").alias("score"))
    return audit.confidence(c).select("result_id", F.explode("confidence").alias("path", "c")).select("result_id", "path", "c.score", "c.rationale")


CONFIDENCE = f"SELECT item_id % 10 AS result_id, 'f' || item_id AS path, match_score AS score, CASE WHEN match_score >= 1 THEN 'quoted verbatim' ELSE 'no supporting passage' END AS rationale FROM ({CITE_EXACT})"


def citation_filter(spark, d):
    c = cite_exact(spark, d).select("item_id", F.concat(F.lit("f"), (F.col("item_id") % 5).cast("string")).alias("path"), "match_score")
    return evidence.kept_citations(c, ("f1", "f3"))


CITATION_FILTER = f"SELECT item_id, 'f' || (item_id % 5) AS path, match_score FROM ({CITE_EXACT}) WHERE item_id % 5 IN (1, 3)"


def prov_text(spark, d):
    """Whole audit documents, signed by a digest."""
    c = cite_exact(spark, d)
    cites = c.select((F.col("item_id") % 10).alias("result_id"), F.format_string("f%06d", "item_id").alias("path"), F.lit("q").alias("quote"), F.col("match_score").alias("score"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), "line_start", F.col("line_start").alias("line_end"), "char_offset")
    made = cites.select("result_id").distinct().select("result_id", F.lit("m").alias("model"), F.lit("1").alias("model_version"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("extracted_at"))
    return audit.signed(audit.prov_documents(cites, made), lambda text: F.sha2(text, 256)).select("result_id", F.col("audit").alias("signature"))


PROV_TEXT = f"""
WITH c AS (SELECT *, item_id % 10 AS result_id, '{{"@type":"prov:Entity","evidence:fieldPath":"f' || lpad(item_id::VARCHAR, 6, '0') || '","prov:value":"q","evidence:matchScore":' || match_score || ',"evidence:sourceLocation":{{"pageStart":1,"pageEnd":1,"lineStart":' || line_start || ',"lineEnd":' || line_start || ',"charOffset":' || char_offset || '}}}}' AS j FROM ({CITE_EXACT}))
SELECT result_id, sha256('{{"@context":{{"prov":"http://www.w3.org/ns/prov#"}},"@type":"prov:Entity","prov:wasGeneratedBy":{{"@type":"prov:Activity","prov:startedAtTime":"2024-01-01T00:00:00Z","prov:wasAssociatedWith":{{"@type":"prov:SoftwareAgent","rdfs:label":"m","prov:version":"1"}}}},"prov:wasDerivedFrom":[' || string_agg(j, ',' ORDER BY item_id) || ']}}') AS signature FROM c GROUP BY result_id
"""


def layout_boxes(spark, d):
    """The box of each turn's words, laid out as in block_group on pages of 100 by 4000."""
    w = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    line = F.floor(F.col("seq") / 6)
    g = w.select("doc_id", "page", "seq", F.concat("word", F.lit(" ")).alias("u"), ((F.col("seq") % 6) * 10).cast("double").alias("x"), (20 + line * 12).cast("double").alias("y"), F.lit(9.0).alias("w"), F.lit(10.0).alias("h"), F.lit(100.0).alias("page_width"), F.lit(4000.0).alias("page_height"))
    b = layout.layout_boxes(g, ["doc_id", "page"])
    return b.select("doc_id", "page", *[F.round(f"bbox.{n}", 4).alias(n) for n in ("x0", "y0", "x1", "y1")])


LAYOUT_BOXES = r"""
WITH w AS (SELECT conv_id AS doc_id, turn AS page, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS seq FROM conversations),
g AS (SELECT doc_id, page, (seq % 6) * 10 AS x, 20 + (seq // 6) * 12 AS y FROM w WHERE NOT regexp_matches(word || ' ', '^[\t\n\x0B\f\r ]*$')),
b AS (SELECT doc_id, page, least(1000, min(x) * 10.0) AS x0, least(1000, (min(y) - 16.7) / 4) AS y0, least(1000, (max(x) + 9) * 10.0) AS x1, least(1000, (max(y) + 3.1) / 4) AS y1 FROM g GROUP BY doc_id, page)
SELECT doc_id, page, CASE WHEN ok THEN round(x0::DOUBLE, 4) END AS x0, CASE WHEN ok THEN round(y0::DOUBLE, 4) END AS y0, CASE WHEN ok THEN round(x1::DOUBLE, 4) END AS x1, CASE WHEN ok THEN round(y1::DOUBLE, 4) END AS y1 FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM b)
"""


def rendered_sections(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    kind = F.when(F.col("turn") % 3 == 0, "text").when(F.col("turn") % 3 == 1, "table").otherwise("figure")
    r = context.rendered(kind, F.col("t"), F.array(F.array("role", "t"), F.array(F.lit("x"))), F.col("t"))
    return c.select("conv_id", "turn", F.sha2(r, 256).alias("rendered_hash"))


RENDERED = "SELECT conv_id, turn, sha256(CASE turn % 3 WHEN 0 THEN t WHEN 1 THEN coalesce(role, '') || ' | ' || t || chr(10) || 'x' ELSE '[Figure: ' || t || ']' END) AS rendered_hash FROM (SELECT *, coalesce(text, '') AS t FROM conversations)"


def ranking_fields(spark, d):
    k = F.col("c_custkey")
    rank = F.concat(F.lit("bm25(title) + 2 * bm25( body"), (k % 4).cast("string"), F.lit(" ) + bm25(title)"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.bm25_fields(rank), ",").alias("fields"))


RANKING_FIELDS = "SELECT c_custkey, 'title,body' || (c_custkey % 4) AS fields FROM customer"


def contract_records(spark, d):
    """Corpus sources, clean texts, search qualities and documents against their contracts."""
    k = F.col("p_partkey")
    at = lambda n, good: F.when(k % n != 0, F.lit(good))
    p = table(spark, d, "part").select(
        k, at(7, "f").alias("source_family"), F.lit("n").alias("display_name"), F.lit("cth").alias("jurisdiction"), at(11, "u").alias("canonical_url"), F.when(k % 2 == 0, "supported").otherwise("planned").alias("coverage_status"), F.when(k % 3 == 0, "unspecified").otherwise("p").alias("parser"),
        at(5, "t").alias("text"), (k % 4).alias("line_count"), (k % 3).alias("attempt"), F.lit(5).alias("top_k"), F.when(k % 13 == 0, 1.5).otherwise(0.5).alias("top_score"), F.lit(0.1).alias("coverage"), at(17, "why").alias("reason"),
        F.lit("d").alias("doc_id"), F.lit("v").alias("version_id"), at(19, "c").alias("citation"), F.lit("t").alias("title"), F.lit("Act").alias("doc_type"), at(23, "s").alias("source"),
    )
    return p.select("p_partkey", contracts.corpus_source().alias("source_error"), contracts.clean_text_record().alias("text_error"), contracts.search_quality().alias("quality_error"), contracts.document().alias("document_error"))


CONTRACT_RECORDS = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'source_family is required' WHEN p_partkey % 11 = 0 THEN 'canonical_url is required' WHEN p_partkey % 6 = 0 THEN 'parser is required' END AS source_error,
  CASE WHEN p_partkey % 5 = 0 THEN 'text is required' WHEN p_partkey % 4 = 0 THEN 'line_count must be positive' END AS text_error,
  CASE WHEN p_partkey % 3 = 0 THEN 'attempt must be positive' WHEN p_partkey % 13 = 0 THEN 'top_score is out of range' WHEN p_partkey % 17 = 0 THEN 'reason is required' END AS quality_error,
  CASE WHEN p_partkey % 19 = 0 THEN 'citation is required' WHEN p_partkey % 23 = 0 THEN 'source is required' END AS document_error FROM part
"""

# ------------------------------------------------------------------------------------

_ALL = {
    "cite_exact": (cite_exact, CITE_EXACT),
    "cite_exact_summary": (cite_exact_summary, CITE_SUMMARY),
    "cite_fuzzy": (cite_fuzzy, CITE_FUZZY),
    "evidence_gates": (evidence_gates, GATES),
    "prov_audit": (prov_audit, PROV),
    "clean_text_documents": (clean_text_documents, _cleaned_sql("doc_id", "text", "documents")),
    "clean_text_pages": (clean_text_pages, _cleaned_sql("page_id", "html", "pages")),
    "search_tokens": (search_tokens, SEARCH_TOKENS),
    "stable_ids": (stable_ids, STABLE_IDS),
    "dates_and_authority": (dates_and_authority, DATES),
    "chunk_passages": (chunk_passages, CHUNK_PASSAGES),
    "chunk_parents": (chunk_parents, CHUNK_PARENTS),
    "rerank_text": (rerank_text, RERANK),
    "vector_preflight": (vector_preflight, VECTORS),
    "duplicate_ids": (duplicate_ids, DUPLICATES),
    "section_normalise": (section_normalise, NORMALISE),
    "section_preflight": (section_preflight, PREFLIGHT),
    "feed_put": (feed_put, FEED_PUT),
    "feed_preflight": (feed_preflight, FEED_PREFLIGHT),
    "schema_compare": (schema_compare, SCHEMA_COMPARE),
    "query_preflight": (query_preflight, QUERY_PREFLIGHT),
    "fts_record": (fts_record, FTS_RECORD),
    "fts_collection": (fts_collection, FTS_COLLECTION),
    "json_schema_errors": (json_schema_errors, JSON_SCHEMA_ERRORS),
    "field_constraints": (field_constraints, CONSTRAINTS),
    "leaf_flatten": (leaf_flatten, LEAVES),
    "context_prefix": (context_prefix, CONTEXT_PREFIX),
    "context_priority": (context_priority, CONTEXT_PRIORITY),
    "doc_stats": (doc_stats, DOC_STATS),
    "block_classify": (block_classify, BLOCK_CLASSIFY),
    "block_group": (block_group, BLOCK_GROUP),
    "bbox_normalise": (bbox_normalise, BBOX),
    "registry_coverage": (registry_coverage, REGISTRY),
    "contract_errors": (contract_errors, CONTRACTS),
    "completion_retry": (completion_retry, COMPLETION),
    "audit_events": (audit_events, AUDIT_EVENTS),
    "csv_files": (csv_files, CSV_FILES),
    "pdf_files": (pdf_files, PDF_FILES),
    "jsonl_sections": (jsonl_sections, JSONL_SECTIONS),
    "preflight_report": (preflight_report, REPORT),
    "first_errors": (first_errors, FIRST_ERRORS),
    "parsed_documents": (parsed_documents, PARSED),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "page_kinds": (page_kinds, PAGE_KINDS),
    "item_paths": (item_paths, ITEM_PATHS),
    "confidence_map": (confidence_map, CONFIDENCE),
    "citation_filter": (citation_filter, CITATION_FILTER),
    "prov_text": (prov_text, PROV_TEXT),
    "layout_boxes": (layout_boxes, LAYOUT_BOXES),
    "rendered_sections": (rendered_sections, RENDERED),
    "ranking_fields": (ranking_fields, RANKING_FIELDS),
    "contract_records": (contract_records, CONTRACT_RECORDS),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned and chunked, benchmark items cited over the parents, support counted by source."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(T.clean(F.col("text")), "\n")).alias("block_ord", "text")).withColumn("section_path", F.array(F.lit("body")))
    parents = chunking.parents(chunking.with_parents(chunking.passages(lines, chunking.Profile()), chunking.Profile()))
    plain = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("text"))
    sections = parents.select("doc_id", F.regexp_replace("text", "\n", " ").alias("text"))
    found = evidence.exact_anywhere(plain, sections).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    cites = plain.select("item_id").join(found, "item_id", "left").join(docs.select("doc_id", "source"), "doc_id", "left")
    return cites.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n_items"), F.count("doc_id").alias("n_exact"), F.count_if(F.col("doc_id").isNull()).alias("n_weak"))


def queries() -> dict:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}
