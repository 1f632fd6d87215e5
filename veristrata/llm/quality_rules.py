"""Quality rules as a bitmask ledger.

``measure`` reads every whole text once and returns counts.  ``ledger`` turns
them into one 64-bit word per document: bit ``k`` says that rule ``k`` fails.
Policies are versioned masks over that word, so a new policy, or the question
what a rule alone costs, needs no second look at any text: ``apply_policy``
and ``ablation`` work on the ledger only, by bitwise operations and
map-side-combined aggregates.

Defined results: a null or empty text has no words, so only ``too_few_words``
fails; a very long text is measured whole; repeated rows are judged separately and lines
that tie count as repeats of the first; extra columns are ignored whatever their
names, and an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import bounded_batches, table, with_bytes
from veristrata.llm.words import Chunk, chunks, white_table, continuation_table

WINDOW = 5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_POINT = ~(white_table() | continuation_table())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the measures in SQL that Spark and DuckDB read alike."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a ledger written earlier keeps its meaning.
RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols_per_word", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "mean_word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is dropped if a bit of ``mask`` is set in its ledger."""

    version: str
    mask: int


def policy(version: str, *names: str) -> Policy:
    bits = {r.name: r.bit for r in RULES}
    return Policy(version, sum(1 << bits[n] for n in names))


BASE = policy("base", "too_few_words", "repeated_windows")
CURRENT = policy("2", "too_few_words", "repeated_windows", "symbols_per_word", "duplicate_lines", "mean_word_length")
POLICIES = (BASE, policy("1", "too_few_words", "repeated_windows", "symbols_per_word"), CURRENT)


def _duplicated(keys: np.ndarray, keep) -> np.ndarray:
    import pandas as pd

    return pd.Series(keys).duplicated(keep=keep).to_numpy()


def _tagged(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return values ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def repeat_words(chunk: Chunk, hashes: np.ndarray) -> np.ndarray:
    """Per text: words inside windows of WINDOW words that occur twice or more in it."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(chunk.n, dtype=np.int64)
    whole = chunk.doc[:n] == chunk.doc[WINDOW - 1 :]
    key = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    at = np.flatnonzero(whole)
    twice = at[_duplicated(_tagged(key[at], chunk.doc[at]), False)]
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return chunk.per_doc(np.cumsum(cover[:-1]) > 0).astype(np.int64)


def duplicate_lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier one."""
    cuts = np.flatnonzero(chunk.buf == 0x0A)
    starts = np.concatenate([chunk.offsets[:-1], cuts + 1])
    starts.sort()
    ends = np.concatenate([cuts, chunk.offsets[1:]])
    ends.sort()
    words_before = np.searchsorted(chunk.starts, np.stack([starts, ends]))
    full = words_before[1] > words_before[0]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(chunk.offsets, starts, side="right") - 1
    again = _duplicated(_tagged(chunk.span_hash(starts, ends), doc), "first")
    return np.bincount(doc, minlength=chunk.n), chunk.per_doc(again, doc).astype(np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column(batch.num_columns - 1)
        found = {m: np.zeros(len(raw), dtype=np.int64) for m in MEASURES}
        for i, j, chunk in chunks(raw):
            hashes = chunk.word_hash()
            lines, again = duplicate_lines(chunk)
            for name, value in zip(MEASURES, (chunk.n_words, chunk.count_bytes(_WORD_POINT), chunk.count_bytes(_SYMBOL), lines, again, repeat_words(chunk, hashes)), strict=True):
                found[name][i:j] = value
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m]) for m in MEASURES)], names=["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and MEASURES of every whole text; one narrow pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_bytes(docs, "doc_id").mapInArrow(_measure, f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def failed_bits(rules=RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measures and ``failed_rules``, each rule evaluated once."""
    return measure(docs).withColumn("failed_rules", failed_bits(rules))


def apply_policy(rows: DataFrame, chosen: Policy, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failed_rules").bitwiseAND(F.lit(chosen.mask)) == 0)


def ablation(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per policy and rule: documents that fail it, that only it drops, and words lost by it alone.

    One aggregate over the ledger gives every figure; the driver only sees its single row.
    """
    bits = F.col("failed_rules")
    sums = []
    for p in policies:
        inside = bits.bitwiseAND(F.lit(p.mask))
        sums.append(F.count_if(inside != 0).alias(f"{p.version}|dropped"))
        for r in rules:
            if p.mask >> r.bit & 1:
                alone = inside == F.lit(1 << r.bit)
                sums += [
                    F.count_if(inside.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"{p.version}|{r.name}|fails"),
                    F.count_if(alone).alias(f"{p.version}|{r.name}|alone"),
                    F.coalesce(F.sum(F.when(alone, F.col("n_words"))), F.lit(0)).alias(f"{p.version}|{r.name}|words"),
                ]
    one = rows.agg(*sums)
    cells = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"`{p.version}|dropped`").alias("policy_dropped"), *[F.col(f"`{p.version}|{r.name}|{k}`").alias(f"n_{k}") for k in ("fails", "alone", "words")])
        for p in policies
        for r in rules
        if p.mask >> r.bit & 1
    ]
    return one.select(F.inline(F.array(*cells)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), BASE, "base_ok"), CURRENT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_ok")).alias("base_failed"), "kept", "n_lines", "failed_rules")


def _bits_sql(mask: int) -> str:
    return " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES if mask >> r.bit & 1)


OP1_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  ({_bits_sql(BASE.mask)}) <> 0 AS base_failed, ({_bits_sql(CURRENT.mask)}) = 0 AS kept, CAST({_bits_sql(31)} AS BIGINT) AS failed_rules
FROM m
"""
