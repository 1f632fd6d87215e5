"""Benchmark decontamination by canonical templates.

Tokens are words without the punctuation around them.  Numbers, units and
capitalised names become typed placeholders (slots); other tokens count in
lower case.  Windows of ``WINDOW`` canonical tokens are hash-joined with the
windows of the benchmark, so a question whose numbers or names were changed
still meets its template.  Windows of which most tokens are slots would match any
list of figures; they are joined by their literal tokens instead.  A match then needs

* ``COVERAGE`` of the item's windows somewhere in the document: of those with
  names as slots, of those with names as words, or of all, and
* consistent slots: each value of the item stands for one value of the
  document in ``CONSISTENT`` of its matched slots;

or ``RUN`` equal tokens of the item in order, however long the item is.

One narrow pass over the documents emits only windows that a sieve of the
benchmark's windows lets through (``SIEVE_BITS`` bits, whatever the benchmark's
size; it lets some others through and none of the benchmark's out).  Equal
windows of equal texts are one row before the join, so copies don't multiply,
and all that follows are joins and aggregates by text and item.

Defined results: null or empty texts match nothing; very long texts are read
whole; an item shorter than a window is one window of its own length, with
fewer than ``SHORTEST`` tokens a literal one; an item without a token matches
nothing; items with equal texts all match, under their own ids, null ones
included, whatever the ids' type; repeated rows match alike, each; an empty
benchmark or document table gives no matches; extra columns are ignored
whatever their names (and kept by ``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import bounded_batches, col, free_names, join_checked, release, settle, table
from veristrata.llm.words import Chunk, chunks, mix64

WINDOW = 8
SHORTEST = 4
#: A window with less than this share of plain tokens counts by its literal tokens; one of slots alone would match any list of names.
PLAIN = 0.5
LITERAL = 2
COVERAGE = 0.5
CONSISTENT = 0.75
#: Literal tokens in a row that are a match by themselves.
RUN = 13
#: Bits of the sieve, a Bloom filter of two probes: 8 MB.
SIEVE_BITS = 26
#: Units that count as one placeholder.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "hour",
    "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "meters", "metres", "kilometers",
    "kilometres", "miles", "inches", "feet", "pounds", "kilograms", "grams", "liters", "litres", "dollars", "dollar", "euros", "euro", "cents",
    "percent", "degrees",
)

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[[*range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SLOT = {"number": np.uint64(0x6E756D6265720001), "unit": np.uint64(0x756E697400000002), "name": np.uint64(0x6E616D6500000003)}


class Tokens:
    """The canonical tokens of a chunk: ``codes`` (templates), ``value`` (what stood there), ``slot``, ``doc``."""

    def __init__(self, raw: Chunk, lower: Chunk, units: np.ndarray):
        n = len(raw.buf)
        marks = _ALNUM[raw.buf]
        spots = np.flatnonzero(marks)
        count = np.zeros(n + 1, np.int64)
        np.cumsum(marks, out=count[1:])
        real = count[raw.ends] > count[raw.starts]
        starts, ends, self.doc = raw.starts[real], raw.ends[real], raw.doc[real]
        starts, ends = spots[count[starts]], spots[count[ends] - 1] + 1
        self.value = lower.span_hash(starts, ends)
        #: Of each text, the number of its first token; places are counted from there.
        self.starts = np.searchsorted(self.doc, np.arange(raw.n))
        small = np.zeros(n + 1, np.int64)
        np.cumsum(_SMALL[raw.buf], out=small[1:])
        first = raw.buf[starts]
        after = raw.buf[np.minimum(starts + 1, max(n - 1, 0))]
        # Latin capitals with accents: U+00C0..U+00DE.
        accented = (first == 0xC3) & (after >= 0x80) & (after <= 0x9E)
        rest = starts + 1 + accented
        single = rest >= ends
        title = (_UPPER[first] | accented) & (single | (small[ends] > small[np.minimum(rest, ends)]))
        number = _DIGIT[first]
        unit = np.isin(self.value, units)
        self.slot = number | unit | title
        figure = number | unit
        #: With names as slots, and with names as plain tokens (for texts in one case, where names can't be told).
        #: Third, literal tokens, for windows that have too many slots in the second form.
        self.codes = (np.select([number, unit, title], [_SLOT["number"], _SLOT["unit"], _SLOT["name"]], self.value), np.select([number, unit], [_SLOT["number"], _SLOT["unit"]], self.value), self.value)
        self._open = (self.slot, figure, figure)

    def windows(self, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
        """``(positions, hashes)`` of windows within one text: with enough plain tokens in one of two forms, the others literally in the third."""
        code, slot = self.codes[form], self._open[form]
        n = len(code) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        key = np.full(n, 3 * width + form, dtype=np.uint64)
        slots = np.zeros(len(code) + 1, np.int64)
        np.cumsum(slot, out=slots[1:])
        for i in range(width):
            key = key * np.uint64(0x9FB21C651E98DF25) + code[i : i + n]
        plain = slots[width:] - slots[:-width] <= (1 - PLAIN) * width
        if width < SHORTEST:
            plain[:] = False
        good = (self.doc[:n] == self.doc[width - 1 :]) & (~plain if form == LITERAL else plain)
        at = np.flatnonzero(good)
        return at, mix64(key[at])


def _unit_hashes() -> np.ndarray:
    out = [c.word_hash() for _, _, c in chunks(pa.array([" ".join(UNITS).encode()], pa.binary()))]
    return np.sort(np.concatenate(out))


def tokens_of(column) -> Iterator[tuple[int, int, Tokens]]:
    units = _unit_hashes()
    for (i, j, raw), (_, _, lower) in zip(chunks(column), chunks(column, lower=True), strict=True):
        # Accented Latin capitals, U+00C0..U+00DE in UTF-8, to lower case as well.
        b = lower.buf
        lead = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97))
        b[lead + 1] += 0x20
        yield i, j, Tokens(raw, lower, units)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; a null one counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("decontamination"), whole).alias("b"))


_KEY = "struct<a:bigint,b:bigint>"
_ITEM = f"item {_KEY}, form int, width int, pos int, hash bigint, mine array<bigint>, slot array<boolean>, slots int, figures int, rest int"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item, with its counts of windows in each form."""
    for batch in batches:
        for row, text in enumerate(batch.column(1)):
            for _, _, t in tokens_of(pa.array([text.as_py()], pa.binary())):
                width = min(WINDOW, len(t.value))
                found = [t.windows(width, form) for form in range(3)] if width else []
                sizes = [len(at) for at, _ in found]
                for form, (at, keys) in enumerate(found):
                    if len(at):
                        span = at[:, None] + np.arange(width)
                        ends = pa.array(np.arange(len(at) + 1) * width, pa.int32())
                        flat = lambda x: pa.array(x[span].reshape(-1))  # noqa: E731, B023
                        same = lambda v: pa.array(np.full(len(at), v, np.int32))  # noqa: E731, B023
                        columns = [batch.column(0).take(pa.array(np.full(len(at), row))), same(form), same(width), pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))]
                        columns += [pa.ListArray.from_arrays(ends, flat(t.value.view(np.int64))), pa.ListArray.from_arrays(ends, flat(t.slot)), *(same(n) for n in sizes)]
                        yield pa.RecordBatch.from_arrays(columns, names=["item", "form", "width", "pos", "hash", "mine", "slot", "slots", "figures", "rest"])


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64((1 << SIEVE_BITS) - 1)
    return (keys & most).astype(np.int64), ((keys >> np.uint64(32)) & most).astype(np.int64)


def sieve(windows: DataFrame) -> np.ndarray:
    """The bits that the windows' hashes set; as many rows as the sieve has words of 64 bits reach the driver."""
    most = (1 << SIEVE_BITS) - 1
    bits = windows.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(most)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(most)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _document_windows(forms: list[tuple[int, int]], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        lit = lambda at: (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
        for batch in batches:
            for i, _, t in tokens_of(batch.column(1)):
                for width, form in forms:
                    at, keys = t.windows(width, form)
                    one, two = _probes(keys)
                    some = np.flatnonzero(lit(one) & lit(two)) if len(keys) else []
                    if len(some):
                        at, keys = at[some], keys[some]
                        ends = pa.array(np.arange(len(at) + 1) * width, pa.int32())
                        theirs = pa.ListArray.from_arrays(ends, pa.array(t.value.view(np.int64)[at[:, None] + np.arange(width)].reshape(-1)))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + t.doc[at])), pa.array(at - t.starts[t.doc[at]]), pa.array(keys.view(np.int64)), theirs], names=["doc", "at", "hash", "theirs"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``doc, item, coverage, slot_consistency`` of accepted pairs of a text and an item's text, by their keys; settled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("item"), F.col(text).cast("string").cast("binary").alias("raw"))
    windows = settle(items.groupBy("item").agg(F.first("raw").alias("raw")).mapInArrow(_item_windows, _ITEM))
    forms = sorted((r.width, r.form) for r in windows.select("width", "form").distinct().collect())
    if not forms:
        release(windows)
        return spark.createDataFrame([], f"doc {_KEY}, item {_KEY}, coverage double, slot_consistency double")
    shared = spark.sparkContext.broadcast(sieve(windows))
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    seen = docs.select(text_key(F.col(text)).alias("doc"), raw.alias("raw")).mapInArrow(_document_windows(forms, shared), f"doc {_KEY}, at bigint, hash bigint, theirs array<bigint>")
    seen = settle(seen.groupBy("doc", "at", "hash").agg(F.first("theirs").alias("theirs")))
    # A window may match in several forms; it is one meeting of a place in the text and one in the item.
    form = lambda k: F.bool_or(F.col("form") == k).alias(f"f{k}")
    of_item = [F.first(c).alias(c) for c in ("theirs", "mine", "slot", "slots", "figures", "rest")]
    met = settle(join_checked(seen, windows, ["hash"]).groupBy("doc", "item", "at", "pos").agg(form(0), form(1), form(2), *of_item))
    places = lambda c: F.size(F.collect_set(F.when(c, F.col("pos"))))
    counts = [places(F.col("f0")).alias("n0"), places(F.col("f0") | F.col("f1")).alias("n1"), places(F.lit(True)).alias("n2")]
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    # What has enough plain tokens with names as slots has them in the second form too.
    covered = met.groupBy("doc", "item").agg(*counts, *[F.first(c).alias(c) for c in ("slots", "figures", "rest")]).withColumn("whole", F.col("figures") + F.col("rest"))
    covered = covered.select("doc", "item", F.greatest(share("n0", "slots"), share("n1", "figures"), share("n2", "whole")).alias("coverage"))
    cell = F.posexplode(F.arrays_zip("mine", "theirs", "slot")).alias("k", "c")
    cells = met.select("doc", "item", (F.col("pos") - F.col("at")).alias("shift"), "pos", cell).select("doc", "item", "shift", (F.col("pos") + F.col("k")).alias("k"), "c.mine", "c.theirs", "c.slot")
    cells = settle(cells.groupBy("doc", "item", "shift", "k").agg(*[F.first(c).alias(c) for c in ("mine", "theirs", "slot")]))
    # Share of matched slots whose value in the text is the usual one for the item's value, in the best copy.
    usual = cells.where("slot").groupBy("doc", "item", "shift", "mine", "theirs").agg(F.count("*").alias("n")).groupBy("doc", "item", "shift", "mine").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    usual = usual.groupBy("doc", "item", "shift").agg((F.sum("most") / F.sum("n")).alias("share")).groupBy("doc", "item").agg(F.max("share").alias("share"))
    # Equal tokens in a row: their places less their ranks are equal.
    equal = cells.where("mine = theirs").groupBy("doc", "item", "shift").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    runs = equal.select("doc", "item", F.posexplode("ks").alias("rank", "k"), "shift").groupBy("doc", "item", "shift", (F.col("k") - F.col("rank")).alias("run")).count()
    runs = runs.groupBy("doc", "item").agg(F.max("count").alias("run"))
    judged = covered.join(usual, ["doc", "item"], "left").join(runs, ["doc", "item"], "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    same = (F.col("coverage") >= COVERAGE) & (F.col("share") >= CONSISTENT)
    out = settle(judged.where(same | (F.col("run") >= RUN)).select("doc", "item", "coverage", F.when(same, F.col("share")).otherwise(1.0).alias("slot_consistency")))
    release(windows, seen, met, cells)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, item_id, coverage, slot_consistency``: a row per document and benchmark item in it."""
    items = benchmark.where("text is not null").select(text_key(F.col("text")).alias("item"), F.col("item_id"))
    found = settle(matches(docs, benchmark).join(items, "item"))
    rows = docs.select(F.col(key), text_key(F.col("text")).alias("_doc"))
    return join_checked(rows, found.withColumnRenamed("doc", "_doc"), ["_doc"]).select(key, "item_id", "coverage", "slot_consistency")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    found = matches(docs, benchmark).select("doc").distinct()
    (name,) = free_names(docs, "doc_key")
    marked = docs.withColumn(name, text_key(F.col("text")))
    return join_checked(marked, settle(found.withColumnRenamed("doc", name)), [name], "left_anti").select(*[col(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
