import io
import json
import random
import re
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from veristrata.functions import json_schema
from veristrata.functions import text as T
from veristrata.operators import audit, chunking, context, contracts, evidence, feed, layout, projection
from veristrata.plans import cli, client, completion, output
from veristrata.sources import files


def one(df):
    return df.collect()[0]


def test_clean_text(spark):
    raw = "\ufeffCanal&nbsp;2  Upper lock\r\n\r\n\r\n9  Barges &amp; tugs\u2014tolls\r\n"
    r = one(spark.createDataFrame([(raw,)], "t string").select(T.clean(F.col("t")).alias("c"), T.full_lines(T.clean(F.col("t"))).alias("n")))
    assert (r.c, r.n) == ("Canal 2 Upper lock\n\n9 Barges & tugs-tolls", 2)
    assert one(spark.createDataFrame([("&amp;lt;",)], "t string").select(T.clean(F.col("t")).alias("c"))).c == "<"


def test_ids_and_tokens(spark):
    df = spark.createDataFrame([("隐私法",), ("!!!",), (" Privacy Act 1988 ",)], "t string")
    rows = df.select(T.chunk_id(F.col("t"), "passage", F.lit(3)).alias("i"), T.search_tokens(F.lit("A b a-B 1")).alias("s"), T.date_number(F.lit("2026-06-04T01")).alias("d"), T.date_number(F.lit("2026")).alias("e")).collect()
    assert rows[0].i.startswith("hash-") and rows[0].i.endswith("::passage::0003") and len(rows[0].i) == 5 + 12 + 15
    assert rows[2].i == "privacy-act-1988::passage::0003"
    assert rows[0].s == ["a", "b", "1"] and rows[0].d == 20260604 and rows[0].e is None


def model_passages(texts, p):
    out, base, step = [], 0, p.passage_max - p.overlap
    for order, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        start = 0
        while True:
            part = words[start : start + p.passage_max]
            at = base + sum(len(w) + 1 for w in words[:start])
            out.append((order, at, at + len(" ".join(part)), len(part), " ".join(part)))
            if start + p.passage_max >= len(words):
                break
            start += step
        base += len(" ".join(words)) + 1
    return out


def model_parents(sizes, paths, p):
    out, no, t = [], -1, 0
    for i, n in enumerate(sizes):
        if no < 0 or paths[i] != paths[i - 1] or t >= p.parent_min or t + n > p.parent_max:
            no, t = no + 1, 0
        t += n
        out.append(no)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_chunks_follow_the_sequential_model(spark, partitions):
    rng = random.Random(5)
    p = chunking.Profile(parent_min=12, parent_max=20, passage_max=7, overlap=2)
    docs = {d: [" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))] for d in range(12)}
    rows = [(d, i, [f"s{i // 3}"], t) for d, texts in docs.items() for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "doc_id int, block_ord int, section_path array<string>, text string").repartition(partitions)
        got = chunking.with_parents(chunking.passages(df, p), p).orderBy("doc_id", "chunk_index").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for d, texts in docs.items():
        own, want = [r for r in got if r.doc_id == d], model_passages(texts, p)
        assert [(r.block_ord, r.char_start, r.char_end, r.token_count, r.text) for r in own] == want
        assert [r.parent_index for r in own] == model_parents([w[3] for w in want], [f"s{w[0] // 3}" for w in want], p)


def test_profile_is_checked():
    with pytest.raises(ValueError):
        chunking.Profile(passage_max=4, overlap=4)


def test_jaro_winkler_and_fuzzy(spark):
    assert round(evidence.jaro_winkler("frederick", "fredericka"), 2) == 0.98
    assert evidence.jaro_winkler("", "a") == 0 and evidence.jaro_winkler("ab", "cd") == 0
    leaves = spark.createDataFrame([(1, "name", "Vera Holm"), (1, "x", "signed"), (2, "y", "gone"), (1, "b", " ")], "doc_id int, path string, value string")
    sections = spark.createDataFrame([(1, 0, "a ledger signed by Vera Ho lm in the harbour"), (1, 1, "signed again")], "doc_id int, section_ord int, text string")
    r = {x.path: x for x in evidence.cite(leaves, sections).collect()}
    assert 0.85 <= r["name"].score < 1 and r["x"].score == 1 and r["x"].section_ord == 0
    assert r["y"].score == 0 and r["y"].quote == "gone" and "b" not in r


def test_exact_anywhere_equals_contains(spark):
    docs = [(1, "one two three four five six"), (2, "x two three four five sixty"), (3, "nothing\nof the kind"), (4, "")]
    items = [(1, "wo three four five six"), (2, "kind"), (3, "the kind"), (4, "two  three four five six")]
    got = {(r.item_id, r.doc_id, r.line_start) for r in evidence.exact_anywhere(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {(i, d, t[: t.find(q)].count("\n") + 1) for i, q in items for d, t in docs if q in t}


def test_contracts(spark):
    df = spark.createDataFrame([("q", "s", 0.5, [("v", 2.0)], []), (" ", "s", 0.5, [], []), ("q", "s", 0.5, [("v", 0.1)], [("", 0.2)])], "raw_query string, semantic_text string, confidence double, exact_anchors array<struct<value string, confidence double>>, scope_anchors array<struct<value string, confidence double>>")
    assert [r.e for r in df.select(contracts.query_signals().alias("e")).collect()] == ["exact_anchors.confidence is out of range", "raw_query is required", "scope_anchors.value is required"]
    box = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0),), ((5.0, 0.0, 5.0, 1.0),), ((-1.0, 0.0, 5.0, 1.0),)], "bbox struct<x0 double,y0 double,x1 double,y1 double>")
    assert [r.e for r in box.select(contracts.bounding_box().alias("e")).collect()] == [None, "bbox is empty", "bbox is out of range"]


SCHEMAS = [
    {"type": "object", "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"enum": ["x", 1, None]}}, "required": ["a"], "additionalProperties": False},
    {"type": "object", "properties": {"c": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/n"}}}, "$defs": {"n": {"anyOf": [{"type": "number", "exclusiveMaximum": 5}, {"type": "null"}]}}},
    {"oneOf": [{"type": "object", "required": ["a"]}, {"type": "object", "required": ["b"]}]},
    {"allOf": [{"properties": {"s": {"type": "string", "pattern": "^a", "maxLength": 3}}}, {"required": ["s"]}]},
    {"properties": {"a": {"$ref": "#/nowhere"}}},
]
VALUES = ['{"a":1}', '{"a":3,"b":"x","z":0}', '{"b":null}', '{"a":2.0,"b":1}', '{"c":[]}', '{"c":[1,7,null,"q"]}', '{"a":1,"b":2}', '{"s":"abcd"}', '{"s":"b"}', "[1]", '"t"', "7", "null", "not json"]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_compiled_schema_equals_interpreted(spark, schema):
    df = spark.createDataFrame([(v,) for v in VALUES], "j string")
    for r in df.select("j", json_schema.compiled(F.col("j"), schema).alias("a"), json_schema.interpreted(F.col("j"), schema).alias("b")).collect():
        assert (sorted(r.a) if r.a is not None else None) == (sorted(r.b) if r.b is not None else None), r.j


def test_recursive_schema_and_compatibility(spark):
    tree = {"$ref": "#/$defs/t", "$defs": {"t": {"type": "object", "properties": {"kid": {"$ref": "#/$defs/t"}, "v": {"type": "integer"}}}}}
    r = one(spark.createDataFrame([('{"kid":{"kid":{"v":"x"}}}',)], "j string").select(json_schema.validate(F.col("j"), tree).alias("e")))
    assert r.e == ["$.kid.kid.v expected integer but got string"]
    assert json_schema.compatibility({"properties": {"a": {"$ref": "http://x"}}}) == ["$.properties.a unsupported $ref http://x"]
    assert json_schema.for_provider({"anyOf": [{"type": "string", "minLength": 1}, {"type": "null"}]}) == {"type": "string", "nullable": True}


def test_projection(spark):
    df = spark.createDataFrame([({"id": "c1"}, [("h1", [("p1",), ("p2",)]), ("h2", [("p3",)])])], "case struct<id string>, sections array<struct<heading string, paragraphs array<struct<text string>>>>")
    m = [projection.Mapping("body", "sections.paragraphs.text", "full_text", True), projection.Mapping("id", "case.id", "filter"), projection.Mapping("none", "case.gone", "metadata"), projection.Mapping("heads", "sections.heading", "metadata")]
    r = one(projection.project(df, m))
    assert r.full_text == {"body": "p1 p2 p3"} and r.filter == {"id": "c1"} and json.loads(r.metadata) == {"none": [], "heads": ["h1", "h2"]} and r.error is None
    items = projection.project_items(df.withColumn("k", F.lit("C1")), "k", "sections", [projection.Mapping("t", "paragraphs.text", "full_text", True)])
    assert {x.object_id: x.full_text["t"] for x in items.collect()} == {"C1::0000": "p1 p2", "C1::0001": "p3"}
    j = spark.createDataFrame([('{"a":[{"b":1.0},{"b":[true,null]}]}',), ("bad",)], "j string").select(projection.json_values(F.col("j"), "a.b").alias("v")).collect()
    assert [x.v for x in j] == [["1.0", "true"], []]
    flat = projection.flatten_json(spark.createDataFrame([(1, '{"s":["x"," "],"o":{"n":2.50}}')], "k int, j string"), "k", "j").collect()
    assert {(x.path, x.value) for x in flat} == {("s[0]", "x"), ("o.n", "2.50")}


def test_feed_convert_is_all_or_nothing(spark, tmp_path):
    good = {"doc_id": "a", "parent_doc_id": "p", "version_id": "v", "section_ordinal": 1, "section_number": "6", "section_heading": "h", "citation": "c", "title": "t", "jurisdiction": "cth", "type": "Act", "source": "reg", "text": "body"}
    df = spark.createDataFrame([(json.dumps(good),), ("",)], "json string")
    assert feed.convert(spark, df, str(tmp_path / "ok")) == {"read": 1, "malformed": 0, "invalid": 0, "written": 1}
    out = json.loads(spark.read.text(str(tmp_path / "ok")).first()[0])
    assert out["put"] == "id:legal:legal_doc::a" and out["fields"]["authority_type"] == "legislation" and "page_start" not in out["fields"]
    bad = spark.createDataFrame([(json.dumps(good),), ("{",), (json.dumps(good | {"title": ""}),)], "json string")
    assert feed.convert(spark, bad, str(tmp_path / "no")) == {"read": 3, "malformed": 1, "invalid": 1, "written": 0}
    assert not (tmp_path / "no").exists()


def model_truncate(texts, budget, hits):
    total = lambda xs: max(0, sum(len(x) + 2 for x in xs) - 2)
    if total(texts) <= budget:
        return texts
    pick = list(hits)
    used, some = total([t for t, h in zip(texts, hits, strict=True) if h]), any(hits)
    if used <= budget:
        for i, t in enumerate(texts):
            cost = len(t) + (2 if some else 0)
            if not pick[i] and used + cost <= budget:
                pick[i], used, some = True, used + cost, True
    return [t for t, p in zip(texts, pick, strict=True) if p]


def test_priority_truncate_follows_the_model(spark):
    rng = random.Random(9)
    docs = {d: ["KEY" * rng.randint(0, 1) + "x" * rng.randint(0, 30) for _ in range(rng.randint(1, 9))] for d in range(40)}
    df = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id int, section_ord int, text string")
    for r in context.priority_truncate(df, 50, ["key"]).collect():
        assert r.context == "\n\n".join(model_truncate(docs[r.doc_id], 50, ["KEY" in t for t in docs[r.doc_id]]))
    strict = context.priority_truncate(df, 2, ["key"], strict=True).where("error_code is not null").collect()
    assert strict and all(r.context is None for r in strict)
    with pytest.raises(ValueError):
        context.prefix_window(df, 0)


def test_layout(spark):
    cases = [("• item", 10.0, "LIST"), ("1. item", 10.0, "LIST"), ("Big", 12.0, "HEADING"), ("SECTION ONE", 10.0, "HEADING"), ("A 123456", 10.0, "BODY"), ("  ", 10.0, "OTHER"), ("plain", 10.0, "BODY")]
    df = spark.createDataFrame([(t, h) for t, h, _ in cases], "t string, h double").select(layout.classified(F.col("t"), F.col("h"), F.lit(10.0)).alias("k"))
    assert [r.k for r in df.collect()] == [k for *_, k in cases]
    tree = {"kids": [{"type": "heading", "page number": 1, "content": "T", "bounding box": [20, 100, 100, 150]}, {"type": "list", "list items": [{"content": "a"}, {"content": "b"}]}, {"type": "table", "page number": 2, "rows": [{"cells": [{"content": " x "}, {"kids": [{"content": "y"}]}]}]}, {"type": "div", "kids": [{"type": "paragraph", "content": "p"}]}]}
    s = layout.map_trees(spark.createDataFrame([("d", json.dumps(tree))], "doc_id string, json string"), spark.createDataFrame([("d", 1, 200.0, 400.0)], "doc_id string, page int, width double, height double")).orderBy("section_ord").collect()
    assert [(r.type, r.kind, r.text, r.page, r.line) for r in s] == [("text", "HEADING", "T", 1, 1), ("text", "LIST", "a\nb", 1, 2), ("table", None, None, 2, 1), ("text", "BODY", "p", 1, 3)]
    assert tuple(s[0].bbox) == (100.0, 625.0, 500.0, 750.0) and s[2].rows == [["x", "y"]]


def office(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return buf.getvalue()


def test_boxes_sort_no_glyphs(spark):
    """Baselines near the first, equal ones, absent heights: boxes as by the rule, and only a row for each baseline is sorted."""
    rng = random.Random(3)
    rows = [(d, 1, i, rng.choice("a b"), rng.uniform(0, 90), rng.choice([10.0, 10.0, 11.5, 12.0, 12.5, rng.uniform(8, 300)]), rng.uniform(1, 9), rng.choice([4.0, 10.0, rng.uniform(1, 20)]), 100.0, 400.0) for d in range(60) for i in range(rng.randint(1, 9))]
    rows += [(99, 1, 0, "a", 1.0, 10.0, 5.0, None, 100.0, 400.0), (99, 1, 1, "b", 7.0, 50.0, 5.0, 10.0, 100.0, 400.0)]
    names = "doc_id page seq u x y w h page_width page_height".split()
    found = layout.layout_boxes(spark.createDataFrame(rows, "doc_id int, page int, seq int, u string, x double, y double, w double, h double, page_width double, page_height double"), ["doc_id", "page"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" in plan.split("Window [", 1)[1]
    got = {r.doc_id: r.bbox and tuple(round(v, 9) for v in r.bbox) for r in found.collect()}
    for doc in {r[0] for r in rows if r[3] != " "}:
        ink = [dict(zip(names, r, strict=True)) for r in rows if r[0] == doc and r[3] != " "]
        top, lines = min(g["y"] for g in ink), {}
        for g in ink:
            lines.setdefault(0 if g["y"] - top <= 2 else g["seq"] + 1, []).append(g)
        tall = [(max(g["y"] for g in line), max(g["h"] for g in line)) for line in lines.values() if all(g["h"] for g in line)]
        box = (min(g["x"] for g in ink) / 100, min(b - 1.67 * h for b, h in tall) / 400, max(g["x"] + g["w"] for g in ink) / 100, max(b + 0.31 * h for b, h in tall) / 400)
        box = [min(1000, max(0, v * 1000)) for v in box]
        wanted = tuple(round(v, 9) for v in box) if box[2] > box[0] and box[3] > box[1] else None
        assert got[doc] == wanted or all(abs(a - b) < 1e-6 for a, b in zip(got[doc], wanted, strict=True))


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(office({"word/document.xml": f"<w:document {w}><w:body>{p('one')}{p(' ')}{p('three')}<w:tbl><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl></w:body></w:document>"}))
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda rows: f"<worksheet {x}><sheetData>{rows}</sheetData></worksheet>"
    (tmp_path / "b.xlsx").write_bytes(
        office(
            {
                "xl/workbook.xml": f'<workbook {x} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>',
                "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
                "xl/worksheets/s1.xml": sheet('<row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="C1"><v>2</v></c></row><row r="3"><c r="A3"><v>1.5</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t> </t></is></c></row>'),
                "xl/worksheets/s2.xml": sheet(""),
            }
        )
    )
    (tmp_path / "c.csv").write_bytes('a,"x, y"\n"two\nlines",é\n'.encode("latin-1"))
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.csv").write_bytes(b'a,"b"c\n')
    (tmp_path / "f.xlsx").write_bytes(b"no zip")
    rows = {}
    for r in files.read_documents(spark, str(tmp_path)).collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [(r.type, r.text, r.line_start) for r in sorted(rows["a.docx"], key=lambda r: r.section_ord)] == [("text", "one", 1), ("text", "three", 3), ("table", None, 4)]
    assert rows["b.xlsx"][0].rows == [["h", "", "2"], [], ["1.5"]] and rows["b.xlsx"][0].page_count == 2 and len(rows["b.xlsx"]) == 1
    assert rows["c.csv"][0].rows == [["a", "x, y"], ["two\nlines", "é"]] and rows["c.csv"][0].doc_id.startswith("sha256:")
    assert "d.csv" not in rows  # an empty file has no section, and Spark's reader passes it over
    assert rows["e.csv"][0].error_code == "CSV_PARSE_FAILED" and rows["f.xlsx"][0].error_code == "XLSX_PARSE_FAILED"
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n[1]\n{bad\n')
    assert [(r.line_no, r.error_code) for r in files.read_json_lines(spark, str(tmp_path / "l.jsonl")).orderBy("line_no").collect()] == [(0, None), (2, "E_JSONL_PARSE_FAILED"), (3, "E_JSONL_PARSE_FAILED")]


def test_json_lines_are_numbered_across_splits(spark, tmp_path, monkeypatch):
    """Files in many splits, with blank, broken and other lines, ends of both kinds, a byte order mark, none at the end."""
    monkeypatch.setattr(feed, "BLOCK_LINES", 7, raising=False)
    one = lambda i: ("" if i % 5 == 0 else "{" if i % 7 == 0 else "[1]" if i % 11 == 0 else json.dumps({"a": i, "b": "é\u2028\rx" * (i % 4)}, ensure_ascii=False).replace("\\r", "\\t")) + " " * (i % 3)
    texts = {"a": "".join(one(i) + ("\r\n" if i % 2 else "\n") for i in range(400)), "b": "\ufeff" + "\n".join(map(one, range(1, 90))), "c": "\n\n", "d": "\ufeff{}\n1\n", "e": "{}\n"}
    (tmp_path / "l").mkdir()
    for name, text in texts.items():
        (tmp_path / "l" / f"{name}.jsonl").write_bytes(text.encode())
    wanted = {(name, i, line) for name, text in texts.items() for i, line in enumerate(re.split("\r?\n", text)) if line.strip(" ")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        # No task reads a whole file of several splits.
        assert spark.read.text(str(tmp_path / "l"), lineSep="\n").rdd.getNumPartitions() > 8
        reader, asked = type(spark.read), []
        text = reader.text
        monkeypatch.setattr(reader, "text", lambda self, *a, **k: asked.append(k) or text(self, *a, **k))
        lines = files.read_json_lines(spark, str(tmp_path / "l"))
        assert asked and not any(k.get("wholetext") for k in asked)
        rows = lines.collect()
        sections, found = feed.sections_of(lines.select("path", "line_no", "json"))
        bad = {(r.code, r.idx) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.path.rsplit("/", 1)[1][0], r.line_no, r.json) for r in rows} == wanted and len(rows) == len(wanted)
    codes, is_object = {}, lambda t: t.startswith("{") and len(t.strip()) > 1
    for name in texts:
        parsed = [t for n, _, t in sorted(w for w in wanted if w[0] == name) if t.strip() != "{" and not t.startswith("\ufeff")]
        codes |= {("E_REQUIRED_FIELD_EMPTY" if is_object(t) else "E_SECTION_PARSE_FAILED", i): 1 for i, t in enumerate(parsed)}
        codes |= {("E_JSONL_PARSE_FAILED", i): 1 for n, i, t in wanted if n == name and (t.strip() == "{" or t.startswith("\ufeff"))}
    assert bad == set(codes) and sections.count() == 0


def test_search_schema_file():
    s = files.parse_search_schema("schema legal {\n document legal {\n  field title type string { indexing: index | summary\n index: enable-bm25 }\n  field day type int { indexing: attribute\n attribute: fast-search }\n }\n fieldset default { fields: title }\n rank-profile base { first-phase { expression: bm25(title) } global-phase { rerank-count: 200 } }\n}")
    assert s.name == "legal" and s.fields[0] == feed.FieldSpec("title", "string", index=True, bm25=True, summary=True) and s.fields[1].fast_search and s.fieldset == ("title",)
    assert s.rank_profiles == (feed.RankProfile("base", ("title",), 200),)


def test_feed_diagnostics_take_no_join_and_reports_one_pass(spark):
    """Problems of odd feed rows, found without a shuffle; counts by stage and the outcome read each row once."""
    schema = feed.SchemaSpec("s", (feed.FieldSpec("a", "string", required=True), feed.FieldSpec("k.$['x", "array<int>"), feed.FieldSpec("t", "tensor<float>(x[2])")))
    rows = ["{", "[]", '{"fields":null}', '{"fields":{}}', '{"fields":{"a":null,"":1}}', """{"fields":{"a":"x","k.$['x":[1,null],"t":[1,2.5]}}""", '{"fields":{"a":"x","t":[1]}}']
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    lines = spark.createDataFrame(list(enumerate(rows)), "idx long, json string").withColumn("json", told.asNondeterministic()("json"))
    found = feed.feed_diagnostics(lines, spark, schema, size=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    none = [("E_FEED_FIELDS_NOT_OBJECT", f"feed[{i}].fields") for i in range(3)]
    assert sorted((r.code, r.path) for r in found.collect()) == sorted(
        [*none, ("E_REQUIRED_FIELD_EMPTY", "feed[3].fields.a"), ("E_FEED_TYPE_MISMATCH", "feed[4].fields.a"), ("W_UNKNOWN_FEED_FIELD", "feed[4].fields."), ("E_FEED_TYPE_MISMATCH", "feed[5].fields.k.$['x"), ("E_FEED_TYPE_MISMATCH", "feed[6].fields.t")]
    )
    before = seen.value
    (counts,) = feed.stage_counts(feed.united(found)).collect()
    assert tuple(counts) == (3, "feed", 7, 1, True, 1) and seen.value - before == len(rows)
    assert feed.stage_counts(feed.united(found.where("severity = 'warning'"))).first().exit_code == 0


def test_retry_and_headers():
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert completion.retry_after("5", now) == 5 and completion.retry_after("-1", now) is None and completion.retry_after("Mon, 01 Jan 2024 00:00:30 GMT", now) == 30 and completion.retry_after("Mon, 01 Jan 2018 00:00:30 GMT", now) is None
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise completion.ProviderError("RATE", "later", 429, 99 if len(calls) == 1 else None)
        return "ok"

    assert completion.Retry(3, 0.2, 5).run(flaky, slept.append) == "ok" and slept[0] == 5 and 0.3 < slept[1] < 0.5
    with pytest.raises(completion.ProviderError):
        completion.Retry().run(lambda: (_ for _ in ()).throw(completion.ProviderError("AUTH", "no", 401)), slept.append)


def test_client_cites_and_gates(spark):
    sections = spark.createDataFrame([(1, 0, "Signed by Alice Smith"), (2, 0, "Signed by nobody at all")], "doc_id int, section_ord int, text string")
    plan = client.extract(sections, lambda prompt, attempt: '{"who": "Alice Smith"}', "Who signed?", {"type": "object", "required": ["who"]}).with_evidence("who")
    results, cites = plan.run()
    assert {r.doc_id: r.error_code for r in results.collect()} == {1: None, 2: "EXTRACTION_EVIDENCE_MISSING"}
    assert {r.doc_id: r.score >= 0.85 for r in cites.collect()} == {1: True, 2: False}
    assert one(audit.counts(cites.withColumn("one", F.lit(1)), "one")).fields == 2


def test_stream_writes_each_batch_once(spark, tmp_path):
    from veristrata.streaming import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a  b"), (2, "&amp;")], "id int, text string").write.parquet(src)
    q = ingest.into(ingest.cleaned(ingest.watch(spark, src, spark.read.parquet(src).schema)), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.clean for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a b", "&"}


def test_json_schema_numbers_patterns_and_repeated_keys_in_both_forms(spark):
    schema = {"properties": {"a": {"enum": [1.5, 2, "x", None]}, "b": {"pattern": "^\\p{L}+$"}, "c": {"maximum": 10}, "d": {"minimum": 1e25}, "e": {"type": "integer"}}}
    good = ['{"a":1.5}', '{"a":1.50}', '{"a":2}', '{"a":"x"}', '{"a":null}', '{"b":"é"}', '{"c":10.0}', '{"d":1e26}', '{"e":123456789012345678901234567890}']
    bad = ['{"a":2.5}', '{"a":"1.5"}', '{"b":"1"}', '{"c":1e30}', '{"c":10.000000000000000001}', '{"d":3}', '{"e":1.5}', '{"c":123456789012345678901234567890}']
    twice = '{"c":1,"c":2}'
    df = spark.createDataFrame([(x,) for x in [*good, *bad, twice]], "j string")
    for form in (json_schema.compiled, json_schema.interpreted):
        got = {r.j: r.e for r in df.select("j", form(F.col("j"), schema).alias("e")).collect()}
        assert all(got[x] == [] for x in good), [(x, got[x]) for x in good]
        assert all(len(got[x]) == 1 for x in bad), [(x, got[x]) for x in bad]
        assert got[twice] is None
    bad_pattern = {"pattern": "("}
    one_text = spark.createDataFrame([('"x"',)], "j string")
    assert all(one(one_text.select(form(F.col("j"), bad_pattern).alias("e"))).e == ["$ has invalid pattern ("] for form in (json_schema.compiled, json_schema.interpreted))


def test_schema_from_text_and_path(tmp_path):
    (tmp_path / "s.json").write_text('{"type": "object"}')
    assert json_schema.load(tmp_path / "s.json") == json_schema.load('{"type": "object"}') == {"type": "object"}
    for wrong in (" ", "{", "[1]"):
        with pytest.raises(ValueError):
            json_schema.load(wrong)


def test_values_of_one_path_are_cited_each_with_their_place(spark):
    leaves = spark.createDataFrame([(1, "p", "oak"), (1, "p", "elm"), (1, "p", "yew tree")], "doc_id int, path string, value string")
    sections = spark.createDataFrame([(1, 0, "an elm", 3, 7), (1, 1, "an oak", 4, 9)], "doc_id int, section_ord int, text string, page_start int, line_start int")
    got = {r.value: (r.quote, r.page_start, r.line_start, r.char_offset) for r in evidence.cite(leaves, sections).collect()}
    assert got["oak"] == ("oak", 4, 9, 0) and got["elm"] == ("elm", 3, 7, 0) and len(got) == 3
    nowhere = evidence.cite(leaves, sections.limit(0)).collect()
    assert len(nowhere) == 3 and all((r.page_start, r.page_end, r.line_start, r.line_end, r.char_offset, r.score) == (1, 1, 1, 1, 0, 0.0) for r in nowhere)
    kept = lambda *a, **k: sorted(r.path for r in evidence.kept_citations(spark.createDataFrame([("a",), ("b",)], "path string"), *a, **k).collect())
    assert kept(("a",)) == ["a"] and kept() == [] and kept(("a",), provenance=True) == ["a", "b"]


def test_malformed_trees_and_records_are_rows(spark):
    geometry = spark.createDataFrame([(1, 1, 100.0, 100.0)], "doc_id int, page int, width double, height double")
    trees = spark.createDataFrame([(1, "{"), (2, '{"kids":[{"type":"paragraph","content":"x"}]}')], "doc_id int, json string")
    got = {r.doc_id: (r.error_code, r.text) for r in layout.map_trees(trees, geometry).collect()}
    assert got == {1: ("TREE_PARSE_FAILED", None), 2: (None, "x")}
    flat = projection.flatten_json(spark.createDataFrame([(1, "{"), (2, '{"a":1.50}')], "k int, j string"), "k", "j").collect()
    assert {(r.k, r.path, r.value, r.error) for r in flat} == {(1, None, None, "JSON_PARSE_FAILED"), (2, "a", "1.50", None)}


def test_csv_cells_may_be_long():
    assert files.parse_csv(b"a," + b"x" * 500_000)[1][0][2][0][1] == "x" * 500_000


def test_items_at_a_dotted_path(spark):
    df = spark.createDataFrame([("r", {"a": [{"b": [{"n": "1"}, {"n": "2"}]}, {"b": [{"n": "3"}]}, {"b": None}]})], "id string, v struct<a:array<struct<b:array<struct<n:string>>>>>")
    got = projection.project_items(df, "id", "v.a.b", [projection.Mapping("n", "n", "filter")]).select("object_id", F.col("filter")["n"].alias("n")).collect()
    assert [(r.object_id, r.n) for r in got] == [("r::0000", "1"), ("r::0001", "2"), ("r::0002", "3")]
    with pytest.raises(ValueError):
        projection.project_items(df, "id", "v.a.b.n", [])
    with pytest.raises(ValueError):
        projection.field_at(df, "v.c")


def test_http_provider_and_retries(spark):
    asked = []

    def send(url, body, headers, timeout):
        asked.append((url, json.loads(body), headers["Content-Type"], timeout))
        return [(503, "busy", {"Retry-After": "0"}), (200, '{"a": 1}', {})][min(len(asked), 2) - 1]

    call = completion.http_provider("http://x", {"K": "v"}, lambda prompt: {"q": prompt}, send=send)
    assert completion.Retry().run(lambda: call("hi", 1), sleep=lambda s: None) == '{"a": 1}' and asked[0] == ("http://x", {"q": "hi"}, "application/json", 60.0) and len(asked) == 2
    for answer, code in (((401, "x" * 900, {}), "PROVIDER_HTTP_401"), ((200, "no json", {}), "PROVIDER_RESPONSE_INVALID")):
        with pytest.raises(completion.ProviderError) as e:
            completion.http_provider("http://x", {}, lambda p: {}, send=lambda *a, answer=answer: answer)("p", 1)
        assert e.value.code == code and len(str(e.value)) < 600

    def flaky(prompt: str, attempt: int, seen={}):  # noqa: B006
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] < 3:
            raise completion.ProviderError("PROVIDER_HTTP_503", "busy", 503, 0.0)
        return "{}"

    df = spark.createDataFrame([(1, "p")], "request_id int, prompt string")
    assert one(completion.complete(df, flaky, {"type": "object"}, retry=completion.Retry(3, 0.0, 0.0))).error_code is None


def test_reports_runs_and_schemas_are_written(spark, tmp_path):
    rows = [("query", 1, "E_X", "error", "q", "m", None), ("schema", 0, "W_Y", "warning", "s", "m", None)]
    found = spark.createDataFrame(rows, feed.DIAGNOSTIC)
    assert feed.write_report(found, str(tmp_path / "r"), "orders", 3) == 1
    head = json.loads(spark.read.text(str(tmp_path / "r/report")).first()[0])
    assert head == {"schema": "orders", "has_errors": True, "errors": 1, "warnings": 1, "feed_preview_count": 3}
    assert [json.loads(r[0])["stage"] for r in spark.read.text(str(tmp_path / "r/diagnostics")).collect()] == ["schema", "query"]
    assert feed.write_report(found.where("severity = 'warning'"), str(tmp_path / "r2"), "orders") == 0
    now = datetime(2026, 6, 4, 1, 2, 3, tzinfo=UTC)
    assert output.run_id(now) == "run_20260604T010203Z"
    place = output.write_run(spark.createDataFrame([(1, "{}")], "id int, response string"), spark.createDataFrame([("{}",)], "audit string"), str(tmp_path), now)
    assert json.loads(spark.read.text(place + "/result").first()[0]) == {"id": 1, "response": "{}"}
    output.write_schema(spark, {"type": "object"}, str(tmp_path / "schema"))
    assert json.loads(spark.read.text(str(tmp_path / "schema"), wholetext=True).first()[0]) == {"type": "object"}


def test_files_that_are_not_there_and_pdf_backends(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.pdf", "none.docx")]
    got = {r.path.rsplit("/", 1)[1]: r.error_code for r in files.read_listed(spark, paths).collect()}
    assert got == {"a.csv": None, "b.pdf": "PDF_PARSE_FAILED", "none.docx": "DOCX_FILE_NOT_FOUND"}
    with pytest.raises(ValueError):
        files.pdf_backend("nothing")
    monkeypatch.setitem(files.PDF_BACKENDS, "plain", lambda content: (1, [("text", "t", None, 1, 1, 1)]))
    assert files.pdf_backend(" Plain ")(b"")[0] == 1


def test_ocr_hook_and_stats(spark):
    pages = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "page int, image binary")
    assert [r.ocr_text for r in layout.ocr_pages(pages).collect()] == ["", ""]
    assert [r.ocr_text for r in layout.ocr_pages(pages, lambda b: b.decode().upper()).orderBy("page").collect()] == ["ABC", ""]
    read = spark.createDataFrame([("a", "d1", 2, None), ("b", "d1", 4, None), ("c", None, None, "CSV_PARSE_FAILED")], "path string, doc_id string, n_sections int, error_code string")
    r = one(output.corpus_stats(read))
    assert (r.files, r.passed, round(r.pass_rate, 3), r.least, r.median, r.most, r.shared_ids) == (3, 2, 0.667, 2, 3.0, 4, 1)
    assert {x.error_code: x.files for x in output.error_codes(read).collect()} == {"none": 2, "CSV_PARSE_FAILED": 1}


def test_command_line(tmp_path):
    said = []
    assert cli.run([], said.append) == 2 and cli.run(["nothing"], said.append) == 2
    assert cli.run(["version"], said.append) == 0 and said
    assert cli.run(["init", str(tmp_path)], said.append) == 0 and cli.run(["init", str(tmp_path)], said.append) == 1
    (tmp_path / "s.json").write_text('{"properties": {"a": {"$ref": "http://x"}}}')
    assert cli.run(["schema", str(tmp_path / "s.json")], said.append) == 1 and json.loads(said[-1])["properties"] == 1
    assert cli.run(["schema", str(tmp_path / "gone.json")], said.append) == 1
    assert all(cli.run(["completion", s], said.append) == 0 for s in ("bash", "zsh", "fish")) and cli.run(["doctor"], said.append) == 0
