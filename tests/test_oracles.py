"""Every registered query with SQL gives DuckDB's rows on the smallest driver tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from veristrata.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_oracle(spark, con, name):
    found = catalogue.queries()[name](spark, DATA)
    wanted = con.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["block_classify", "page_kinds"])
def test_kinds_of_lines_with_letters_of_several_capitals(spark, tmp_path, name):
    """A line of 60 letters with ß, and each letter whose case the engines tell differently, on all nine kinds of lines."""
    odd = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000 and (len(chr(i).upper()) > 1 or chr(i).upper() != chr(i) or i in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB) or i in range(0x10D50, 0x10D90))]
    texts = ["\n".join(["x" * 59 + "ß", "ŉﬁ ABCß", "ὙΠΌᾳᾼ ß", ""] * 9)] + ["\n".join([f"ABC{c}{c} D{c}"] * 9) for c in odd]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, wanted = catalogue.queries()[name](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()[name])
    order = sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall()) and order == sorted(wanted.columns)


@pytest.mark.parametrize("name", ["block_classify", "page_kinds"])
def test_kinds_of_lines_with_late_letters_and_line_ends(spark, tmp_path, name):
    """Each letter and digit that DuckDB knows, those later than Java's version of Unicode too, and line ends other than \\n after a space, at both limits of a heading's length."""
    con = duckdb.connect()
    known = [c for (c,) in con.execute(r"SELECT chr(i::INTEGER) FROM range(1, 1114112) AS r(i) WHERE (i < 55296 OR i > 57343) AND regexp_matches(chr(i::INTEGER), '[\pL\p{Nd}]')").fetchall()]
    texts = ["\n".join([""] * 4 + ["ABC " + e, "A" * 59 + " " + e, e + " ABC", "ABCDE " + e + " "]) for e in "\x85\u2028\u2029"] + ["\n".join([""] * 4 + [c * 5, "ABCDE" + c * 3]) for c in known]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found, wanted = catalogue.queries()[name](spark, str(tmp_path)), con.sql(catalogue.oracle_sql()[name])
    assert len(known) > 130_000 and rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(wanted.columns, wanted.fetchall())


def test_flagship(spark):
    rows = catalogue.flagship(spark, DATA).collect()
    assert rows and sum(r.n_items for r in rows) == spark.read.parquet(f"{DATA}/benchmark.parquet").count()
