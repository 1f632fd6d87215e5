"""Whole files as documents and sections: CSV, XLSX, DOCX, PDF, document trees, JSON lines.

Files are read by Spark (``binaryFile``), so any store it reaches will do, and
parsed in Arrow batches by the standard library alone.  A file that can't be
parsed gives a row with ``error_code`` instead of failing the job; a file
without a byte gives no row.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION = "path string, doc_id string, page_count int, section_ord int, type string, text string, rows array<array<string>>, page int, line_start int, line_end int, error_code string, error string"
_OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Parsed = tuple[int, list[tuple[str, str | None, list[list[str]] | None, int, int, int]]]


def parse_csv(content: bytes) -> Parsed:
    """One table; every row is data. UTF-8, or else the whole file as Latin-1; nothing at all gives no section."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    # A cell may be as long as the file.
    csv.field_size_limit(sys.maxsize)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]
    return 1, [("table", None, rows, 1, 1, len(rows))] if rows else []


def _number(text: str, style: str) -> str:
    """A number as its format shows it, for the built-in formats."""
    value = float(text)
    if style in ("9", "10"):
        return f"{value * 100:.{0 if style == '9' else 2}f}%"
    if style in ("1", "3"):
        return f"{value:,.0f}" if style == "3" else f"{value:.0f}"
    if style in ("2", "4"):
        return f"{value:,.2f}" if style == "4" else f"{value:.2f}"
    if style in ("14", "15", "16", "17", "22"):
        day = datetime(1899, 12, 30) + timedelta(days=value)
        return {"14": f"{day.month}/{day.day}/{day:%y}", "15": f"{day.day}-{day:%b-%y}", "16": f"{day.day}-{day:%b}", "17": f"{day:%b-%y}", "22": f"{day.month}/{day.day}/{day:%y} {day.hour}:{day:%M}"}[style]
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def parse_xlsx(content: bytes) -> Parsed:
    """A table per sheet; blank rows are kept inside and trimmed at the end; an empty sheet counts as a page only."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        formats = [x.get("numFmtId", "0") for x in (read("xl/styles.xml").find(f"{_SHEET}cellXfs") or ())] if "xl/styles.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out, sheets = [], list(read("xl/workbook.xml").iter(f"{_SHEET}sheet"))
        for page, sheet in enumerate(sheets, 1):
            target = targets[sheet.get(f"{_OFFICE}id")]
            rows: dict[int, dict[int, str]] = {}
            for row in read(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)).iter(f"{_SHEET}row"):
                r = int(row.get("r", len(rows) + 1))
                cells = rows.setdefault(r, {})
                for cell in row.iter(f"{_SHEET}c"):
                    ref = re.match("[A-Z]+", cell.get("r", ""))
                    col = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref[0]))) if ref else len(cells) + 1
                    value = cell.findtext(f"{_SHEET}v") or ""
                    kind = cell.get("t", "n")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind == "n" and value:
                        style = int(cell.get("s", 0))
                        value = _number(value, formats[style] if style < len(formats) else "0")
                    cells[col] = value
            last = max((r for r, cells in rows.items() if any(v.strip() for v in cells.values())), default=0)
            if last:
                table = [[rows.get(r, {}).get(c, "") for c in range(1, max(rows.get(r, {}), default=0) + 1)] for r in range(1, last + 1)]
                out.append(("table", None, table, page, 1, len(table)))
        return max(1, len(sheets)), out


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs that aren't blank, each on the line of its ordinal; after them all tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")

    def said(p) -> str:
        parts = []
        for e in p.iter():
            if e.tag == f"{_WORD}t":
                parts.append(e.text or "")
            elif e.tag == f"{_WORD}tab":
                parts.append("\t")
            elif e.tag in (f"{_WORD}br", f"{_WORD}cr"):
                parts.append("\n")
        return "".join(parts)

    out, line = [], 0
    for p in body.findall(f"{_WORD}p"):
        line += 1
        if (text := said(p)).strip():
            out.append(("text", text, None, 1, line, line + max(1, len(text.splitlines())) - 1))
    for table in body.findall(f"{_WORD}tbl"):
        line += 1
        rows = [["\n".join(said(p) for p in c.findall(f"{_WORD}p")) for c in r.findall(f"{_WORD}tc")] for r in table.findall(f"{_WORD}tr")]
        out.append(("table", None, rows, 1, line, line + max(1, len(rows)) - 1))
    return 1, out


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"csv": parse_csv, "xlsx": parse_xlsx, "docx": parse_docx}
#: Other readers of PDF bytes by their ids, beside the engine's own, which is ``glyphs``.
PDF_BACKENDS: dict[str, Callable[[bytes], Parsed]] = {}
GLYPHS = "glyphs"


def pdf_backend(name: str) -> Callable[[bytes], Parsed]:
    """The backend of an id, whatever its case and the space around it; ValueError for an unknown one."""
    known = PDF_BACKENDS.get(name.strip().lower())
    if known is None:
        raise ValueError(f"unknown PDF backend {name}")
    return known


def _kind(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def _sections(path: str, doc_id: str, content: bytes, parsers: dict[str, Callable[[bytes], Parsed]] = PARSERS) -> Iterator[tuple]:
    kind = _kind(path)
    if kind not in parsers:
        yield (path, doc_id, None, None, None, None, None, None, None, None, "UNSUPPORTED_FORMAT", kind)
        return
    try:
        pages, found = parsers[kind](bytes(content))
    except Exception as e:  # noqa: BLE001  any malformed file is a row, not a failed job
        yield (path, doc_id, None, None, None, None, None, None, None, None, f"{kind.upper()}_PARSE_FAILED", str(e))
        return
    if not found:
        yield (path, doc_id, pages, None, None, None, None, None, None, None, None, None)
    for i, (variant, text, rows, page, start, end) in enumerate(found):
        yield (path, doc_id, pages, i, variant, text, rows, page, start, end, None, None)


def read_pdfs(spark: SparkSession, path: str | list[str], glob: str = "*.pdf", where: Column | None = None) -> DataFrame:
    """Blocks of PDF files as sections, with ``kind, char_offset, bbox`` beside the columns of other files.

    The glyphs are parsed once, into a table in the session's shared folder.
    Blocks are found by path, so that copies of a file don't mix.  ``where`` picks files by their path.
    """
    from veristrata.operators import layout
    from veristrata.sources import pdf, scratch

    place = scratch.new_path(spark, "glyphs")
    pdf.read_glyphs(spark, path, glob, where).write.parquet(place)
    glyphs = spark.read.schema(pdf.GLYPH).parquet(place)
    files = glyphs.groupBy("path", "doc_id").agg(F.max("page").alias("page_count"), F.max("error_code").alias("error_code"), F.max("error").alias("error"))
    found = layout.glyph_sections(glyphs.where("page is not null").withColumn("doc_id", F.col("path"))).withColumnRenamed("doc_id", "path")
    order = W.partitionBy("path").orderBy("page", "block_no")
    number = F.when(F.col("block_no").isNotNull(), F.row_number().over(order) - 1).alias("section_ord")
    kind = F.when(F.col("block_no").isNotNull(), F.lit("text")).alias("type")
    rows = F.lit(None).cast("array<array<string>>").alias("rows")
    lines = [F.col(c).cast("int").alias(c) for c in ("line_start", "line_end")]
    return files.join(found, "path", "left").select("path", "doc_id", "page_count", number, kind, "text", rows, "page", *lines, "error_code", "error", "kind", "char_offset", "bbox")


def read_documents(spark: SparkSession, path: str | list[str], glob: str = "*.{csv,xlsx,docx,pdf}", pdf: str | None = None) -> DataFrame:
    """Sections of all files under a path, of any format. ``doc_id`` is the digest of a file's bytes and tells nothing of its path.

    PDF files go through the backend ``pdf``, the engine's own if none is named.
    """
    own = pdf is None or pdf.strip().lower() == GLYPHS
    parsers = PARSERS if own else PARSERS | {"pdf": pdf_backend(pdf)}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    names = [c.split()[0] for c in SECTION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, d, c in zip(batch["path"], batch["doc_id"], batch["content"], strict=True) for r in _sections(p, d, c, parsers)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    is_pdf = F.lower("path").endswith(".pdf")
    some = [r.path for r in files.where(is_pdf).select("path").limit(1).collect()] if own else []
    keyed = (files.where(~is_pdf) if some else files).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("doc_id"), "content")
    read = keyed.mapInPandas(run, SECTION)
    if not some:
        return read
    return read.unionByName(read_pdfs(spark, path, glob, is_pdf).select(*names))


def read_listed(spark: SparkSession, paths: list[str], pdf: str | None = None) -> DataFrame:
    """Sections of the listed files, whatever their names; a path without a file is a row with ``<FORMAT>_FILE_NOT_FOUND``."""
    there, lost = [], []
    for p in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        (there if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else lost).append(p)
    gone = spark.createDataFrame([(p, *[None] * 9, f"{_kind(p).upper() or 'DOCUMENT'}_FILE_NOT_FOUND", f"no file at {p}") for p in lost], SECTION)
    return read_documents(spark, there, "*", pdf).unionByName(gone) if there else gone


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, json, error_code``: blank lines skipped, lines that are no object marked, the rest carried on.

    Files are read in splits, and each line is written once, with its split and its place in it, to a table in the
    session's shared folder; its number is its place there after the lines of the file's earlier splits.
    """
    from veristrata.sources import scratch

    place = scratch.new_path(spark, "lines")
    text = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("json"))
    text.write.parquet(place)
    kept = spark.read.schema("path string, _split long, _size long, _id long, json string").parquet(place)
    splits = kept.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.max("_size").alias("_size"), F.sum(F.octet_length("json") + 1).alias("_bytes"))
    of_file = W.partitionBy("path")
    before = F.coalesce(F.sum("_n").over(of_file.orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Spark's reader passes over a byte order mark: then two or three bytes are missing, as the last line ends or not.
    marked = (F.col("_split") == 0) & (F.max("_size").over(of_file) - F.sum("_bytes").over(of_file)).isin(2, 3)
    starts = splits.select("path", "_split", "_first", before.alias("_before"), marked.alias("_marked"))
    number = F.col("_before") + F.col("_id") - F.col("_first")
    line = F.concat(F.when(F.col("_marked") & (number == 0), "\ufeff").otherwise(""), F.regexp_replace("json", "\r$", ""))
    lines = kept.join(F.broadcast(starts), ["path", "_split"]).select("path", number.alias("line_no"), line.alias("json")).where(F.length(F.trim("json")) > 0)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("json")).startswith("OBJECT"), F.lit(False))
    return lines.withColumn("error_code", F.when(~good, "E_JSONL_PARSE_FAILED"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def read_registry(spark: SparkSession, path: str, rows: str = "sources") -> DataFrame:
    """A registry file's entries, one per row."""
    return spark.read.json(path, multiLine=True).select(F.explode(rows).alias("r")).select("r.*")


def registry_coverage(registry: DataFrame, coverage: DataFrame) -> DataFrame:
    """``family, registry_status, coverage_status, error``: families that only one side knows, or that disagree."""
    a = registry.select(F.col("sourceFamily").alias("family"), F.col("coverageStatus").alias("registry_status"))
    b = coverage.select(F.col("sourceFamily").alias("family"), F.col("coverageStatus").alias("coverage_status"))
    r, c = F.col("registry_status"), F.col("coverage_status")
    return a.join(b, "family", "full").withColumn("error", F.when(c.isNull(), "missing in coverage").when(r.isNull(), "missing in registry").when(r != c, "status differs"))


def parse_search_schema(text: str):
    """Fields, roles, fieldset and rank profiles of a search schema file (`.sd`), by its braces."""
    from veristrata.operators.feed import FieldSpec, RankProfile, SchemaSpec

    clean = re.sub(r"#.*", "", text)

    def body(at: int) -> tuple[str, int]:
        depth, i = 0, at
        while True:
            depth += {"{": 1, "}": -1}.get(clean[i], 0)
            i += 1
            if not depth:
                return clean[at + 1 : i - 1], i

    def named(word: str) -> Iterator[tuple[str, str]]:
        for m in re.finditer(rf"\b{word}\s+([\w.<>\[\]() ]+?)\s*(?:inherits\s+[\w, ]+)?\{{", clean):
            yield m[1].strip(), body(m.end() - 1)[0]

    fields = []
    for head, inner in named("field"):
        name, _, kind = head.partition(" type ")
        steps = {s.strip() for m in re.finditer(r"indexing\s*:\s*([^\n}]+)", inner) for s in m[1].split("|")}
        fields.append(FieldSpec(name.strip(), kind.strip(), "index" in steps, "attribute" in steps, "fast-search" in inner, "enable-bm25" in inner, "summary" in steps))
    sets = [f.strip() for _, inner in named("fieldset") for m in re.finditer(r"fields\s*:\s*([^\n}]+)", inner) for f in m[1].split(",")]
    ranks = []
    for name, inner in named("rank-profile"):
        count = re.search(r"rerank-count\s*:\s*(\d+)", inner)
        ranks.append(RankProfile(name.split()[0], tuple(dict.fromkeys(re.findall(r"bm25\(\s*(\w+)\s*\)", inner))), int(count[1]) if count else None))
    title = re.search(r"\bschema\s+(\w+)", clean)
    return SchemaSpec(title[1] if title else "", tuple(fields), tuple(sets), tuple(ranks))
