"""Near-duplicate documents by one-permutation MinHash, star edges and exact checks.

1. One narrow pass hashes every whole text to its set of word shingles.  One
   hash per shingle fills ``BINS`` bins at once (one-permutation hashing);
   empty bins borrow from the first filled bin in a random order of their own
   (optimal densification).  ``ROWS`` bins make a band.
2. Texts with equal sets are one *node*, so exact copies never meet in pairs.
3. A bucket (nodes with an equal band) proposes a star: each member with the
   bucket's most central node (the hub), whose buckets hold most nodes.  So
   candidates grow with members, not their square.
4. Every proposed link is confirmed on the full sets.  First each node is
   tested with one hub only; what the resulting groups already connect needs
   no further test.
5. Where a star leaves its bucket in several groups, two members of different
   groups may still be alike.  Then their *differences* from the hub (shingles
   that only one of the two sets holds) must overlap: with sets of sizes a and
   b, differences x and y and q = (100 - percent) / (100 + percent), a link
   means a symmetric difference of at most q (a + b), hence an overlap of at
   least (x + y - q (a + b)) / 2; and x > q (a + hub size) for a member that is
   not linked with the hub.  So at least half of either difference is shared, and
   a prefix of each, in the order of their rarity among the hub's members, must
   meet (prefix filter, then the positions of the meeting token).  The family's
   common core is in no difference, so large families of texts just below the
   threshold give few candidates.  Those are confirmed on the full sets too.

The bounds of step 5 are exact: no link inside a bucket is lost.  Two sets at
the threshold 0.8 share no band with probability ``(1 - 0.8**ROWS) ** BANDS`` =
2e-6, less for more similar ones.

Defined results: a text without words (or null) has an empty set and links
with nothing; a very long text is one set of all its shingles; rows that repeat
an id are linked by their texts like any others; equal texts (ties) share a
group, whose id is its smallest; a null id never becomes a group's id; extra
columns are ignored whatever their names, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm.session import bounded_batches, join_checked, release, settle, table, with_bytes
from veristrata.llm.words import Chunk, chunks, mix64

ROWS, BANDS = 8, 72
BINS = ROWS * BANDS
#: Members of a hub that are compared with one copy of its set.
HUB_ROWS = 1000

_rng = np.random.Generator(np.random.PCG64(71993))
#: Column j lists the bins from which bin j borrows, in order; ORDER holds each bin's place there.
_LENDERS = np.stack([_rng.permutation(BINS) for _ in range(BINS)], axis=1).astype(np.int16)
_ORDER = np.argsort(_LENDERS, axis=0).astype(np.int16)
_COEF = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingle_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, offsets)``: each text's sorted distinct shingle hashes."""
    hashes = chunk.word_hash()
    first = np.concatenate([[0], np.cumsum(chunk.n_words)])
    n = max(len(hashes) - k + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        value = value * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + n]
    value = mix64(value)
    parts, sizes = [], np.zeros(chunk.n, dtype=np.int64)
    for d, words in enumerate(chunk.n_words):
        if words == 0:
            continue
        s = first[d]
        if words < k:
            own = hashes[s : s + words]
            one = int(words)
            for h in own:
                one = (one * 0xC2B2AE3D27D4EB4F + int(h)) % (1 << 64)
            own = mix64(np.array([one], dtype=np.uint64))
        else:
            own = np.sort(value[s : s + words - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sizes[d] = len(own)
        parts.append(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def band_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket keys per non-empty set."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    n = len(full)
    if not n:
        return np.zeros((0, BANDS), dtype=np.uint64)
    row = np.repeat(np.arange(n), sizes[full])
    at = row * BINS + (((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sketch = np.zeros(n * BINS, dtype=np.uint64)
    sketch[at[new]] = values[new]
    filled = np.zeros(n * BINS, dtype=bool)
    filled[at[new]] = True
    sketch, filled = sketch.reshape(n, BINS), filled.reshape(n, BINS)
    count = filled.sum(axis=1)
    for r in np.flatnonzero(count < 32):
        own = np.flatnonzero(filled[r])
        lender = own[np.argmin(_ORDER[own], axis=0)]
        lender[own] = own
        sketch[r] = sketch[r, lender]
    rows, cols = np.nonzero(~filled & (count >= 32)[:, None])
    base, a = sketch.copy(), 0
    while len(rows):
        lender = _LENDERS[a, cols]
        ok = filled[rows, lender]
        sketch[rows[ok], cols[ok]] = base[rows[ok], lender[ok]]
        rows, cols, a = rows[~ok], cols[~ok], a + 1
    return mix64((sketch.reshape(n, BANDS, ROWS) * _COEF).sum(axis=2, dtype=np.uint64) ^ _BAND)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            n, node, ends, keys = len(raw), np.zeros(len(raw), np.int64), np.zeros(len(raw) + 1, np.int64), []
            size = np.zeros(n, np.int64)
            for i, j, chunk in chunks(raw, lower=True):
                values, offsets = shingle_sets(chunk, k)
                size[i:j] = np.diff(offsets)
                full = i + np.flatnonzero(size[i:j])
                if len(full):
                    sums = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full - i])
                    node[full] = mix64(sums + size[full].astype(np.uint64)).view(np.int64)
                    keys.append(band_keys(values, offsets))
            ends[1:] = np.cumsum((size > 0) * BANDS)
            flat = np.concatenate([x.reshape(-1) for x in keys]).view(np.int64) if keys else np.zeros(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(node, mask=size == 0), bands], names=["id", "text_key", "n", "node", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            for i, j, chunk in chunks(raw, lower=True):
                values, offsets = shingle_sets(chunk, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))], names=["node", "shingles"])

    return run


def _roots(parents: DataFrame) -> DataFrame:
    """``(node, comp)`` of a settled forest whose parents are smaller than their children, by pointer jumping."""
    at = parents
    while True:
        up = at.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        if not at.join(up, "comp").head(1):
            return at
        at = settle(at.join(up, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")))


def _labelled(rows: DataFrame, labels: DataFrame | None, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its group's smallest node."""
    if labels is None:
        return rows
    names = labels.select(F.col("node").alias(column), F.col("comp").alias("_comp"))
    return rows.join(names, column, "left").withColumn(column, F.coalesce("_comp", column)).drop("_comp")


def merge_groups(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Groups after adding ``edges (a, b)``; ``labels (node, comp)`` lists nodes that are not their group's smallest.

    Each round hangs every group on its smallest neighbour; only groups smaller
    than all their neighbours stay, so rounds are logarithmic.
    """
    while True:
        between = _labelled(_labelled(edges, labels, "a"), labels, "b").where("a <> b")
        if not between.head(1):
            return labels
        hung = settle(between.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
        roots = _roots(hung)
        if labels is None:
            labels = roots
        else:
            moved = _labelled(labels, roots, "comp")
            labels = settle(moved.unionByName(roots))


def near_groups(docs: DataFrame, k: int, percent: int = 80, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """``(signatures, labels)``: a row per document with its node, and nodes' groups."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text"))
    sigs = settle(with_bytes(keyed, "id", "text_key").mapInArrow(_signatures(k), f"id {kind}, text_key bigint, n bigint, node bigint, bands array<bigint>"))
    nodes = sigs.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("bucket")
    members = settle(rows.join(shared, "bucket"))
    if not members.head(1):
        release(members)
        return sigs, None
    sets = settle(_full_sets(keyed, sigs, members.select("node").distinct(), k))
    stars = _stars(members)
    labels = _star_links(stars, sets, percent)
    labels = merge_groups(labels, _beyond_stars(stars, sets, labels, percent))
    release(members, stars, sets)
    return sigs, labels


def _stars(members: DataFrame) -> DataFrame:
    """``bucket, node, n, hub, hub_n, reach``: every member of a bucket but its hub, which is the member whose buckets hold most nodes, as the text that others were copied from does."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("_m"))
    central = members.join(sizes, "bucket").groupBy("node").agg(F.sum("_m").alias("reach"))
    lead = F.max(F.struct("reach", "node", "n")).alias("h")
    hubs = settle(members.join(central, "node").groupBy("bucket").agg(lead).select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.reach").alias("reach")))
    stars = settle(members.join(hubs, "bucket").where("node <> hub"))
    release(hubs)
    return stars


def _star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Groups by the links between members and their hubs."""
    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    pairs = settle(stars.where(fits).groupBy(F.col("node").alias("b"), F.col("hub").alias("a")).agg(F.first("reach").alias("reach")))
    # First one link a node: what the resulting groups connect needs no further test.
    one = pairs.groupBy("b").agg(F.max_by("a", F.struct("reach", "a")).alias("a"))
    labels = merge_groups(None, _confirmed(one, sets, percent))
    rest = pairs.select("a", "b", F.col("a").alias("_a"), F.col("b").alias("_b"))
    rest = _labelled(_labelled(rest, labels, "_a"), labels, "_b").where("_a <> _b").select("a", "b")
    labels = merge_groups(labels, _confirmed(rest.join(one.select("a", "b"), ["a", "b"], "left_anti"), sets, percent))
    release(pairs)
    return labels


def _beyond_stars(stars: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Links ``(a, b)`` between members of one bucket that are in different groups after the stars."""
    less, more = 100 - percent, 100 + percent
    at = settle(_labelled(stars.withColumn("comp", F.col("node")), labels, "comp"))
    split = settle(at.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("bucket"))
    spokes = settle(at.join(split, "bucket").select("hub", "hub_n", "node", "n", "comp"))
    spokes = settle(_labelled(spokes.distinct().withColumn("hub_comp", F.col("hub")), labels, "hub_comp"))
    release(at, split)
    # A hub with many members is compared in parts, each with a copy of its set.
    parts = spokes.groupBy("hub").agg(F.count("*").alias("_m")).select("hub", F.ceil(F.col("_m") / HUB_ROWS).alias("_parts"))
    copies = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_of_hub")).join(parts, "hub")
    copies = copies.select("hub", "_parts", "_of_hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    dealt = spokes.join(parts, "hub").withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts"))).drop("_parts").join(sets, "node")
    both = dealt.join(copies.drop("_parts"), ["hub", "_part"])
    off = F.concat(F.array_except("shingles", "_of_hub"), F.array_except("_of_hub", "shingles"))
    differ = settle(both.select("hub", "node", "n", "comp", (F.col("comp") == F.col("hub_comp")).alias("near"), "hub_n", off.alias("off")))
    tokens = differ.select("hub", "node", F.explode("off").alias("token"))
    often = tokens.groupBy("hub", "token").agg(F.count("*").alias("_times")).where("_times > 1")
    ranked = tokens.join(often, ["hub", "token"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("_times", "token"))).alias("ranked"))
    # Tokens of one member alone come first in the order and meet nothing.
    x, alone = F.size("off"), F.size("off") - F.size("ranked")
    half = x - F.floor((x + (F.col("hub_n") - F.col("n")) * F.lit(less) / F.lit(more)) / 2 - 1e-9)
    long = F.least(x, F.floor(F.col("n") * F.lit(less / more * (1 + 100 / percent)) + 1e-9) + 1)
    # Of two members in different groups one is not linked with the hub, so the other's half holds; a member in the hub's group meets only others.
    cut = differ.join(ranked, ["hub", "node"]).select("hub", "node", "n", "comp", "near", x.alias("x"), alone.alias("alone"), "ranked", F.least(half, long).alias("half"), F.when(F.col("near"), F.least(half, long)).otherwise(long).alias("upto"))
    prefix = cut.withColumn("_r", F.slice("ranked", 1, F.greatest(F.col("upto") - F.col("alone"), F.lit(0)).cast("int")))
    prefix = settle(prefix.select("hub", "node", "n", "comp", "near", "x", "half", "alone", F.posexplode("_r")).select("hub", "node", "n", "comp", "near", "x", "half", F.col("col.token").alias("token"), (F.col("alone") + F.col("pos")).alias("at")))
    a, b = prefix.alias("a"), prefix.alias("b")
    first = "a.node < b.node and a.comp <> b.comp"
    sized = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and {more} * abs(a.x - b.x) <= {less} * (a.n + b.n)"
    inside = "if(a.near or b.near, (not a.near or a.at < a.half) and (not b.near or b.at < b.half), a.at < a.half and b.at < b.half)"
    placed = f"2 * {more} * least(a.x - a.at, b.x - b.at) >= {more} * (a.x + b.x) - {less} * (a.n + b.n)"
    meet = F.expr(f"a.hub = b.hub and a.token = b.token and {first} and {sized} and {inside} and {placed}")
    found = settle(a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    links = _confirmed(found.distinct(), sets, percent)
    release(spokes, differ, prefix, found)
    return links


def _full_sets(keyed: DataFrame, sigs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(node, shingles)`` of one document per wanted node, from its text."""
    chosen = sigs.where("n > 0").join(wanted, "node").groupBy("node").agg(F.min(F.struct("text_key", F.col("id"))).alias("r"))
    chosen = settle(chosen.select("node", F.col("r.text_key").alias("text_key"), F.coalesce(F.hash("r.id"), F.lit(0)).alias("_i")))
    texts = join_checked(keyed.withColumn("_i", F.coalesce(F.hash("id"), F.lit(0))), chosen, ["text_key", "_i"])
    # Rows that repeat an id and its text give a set each.
    return with_bytes(texts, "node").mapInArrow(_sets(k), "node bigint, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    both = F.size(F.array_intersect("_a", "_b"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("_n", both)
    return settle(found.where(100 * F.col("_n") >= percent * (F.size("_a") + F.size("_b") - F.col("_n"))).select("a", "b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row; rows of a group share the smallest id in it."""
    sigs, labels = near_groups(docs, k, percent, key)
    lowest = _labelled(sigs.where("n > 0").groupBy("node").agg(F.min("id").alias("id")).withColumn("comp", F.col("node")), labels, "comp")
    if labels is not None:
        lowest = lowest.join(lowest.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("node", "component_id")
    else:
        lowest = lowest.select("node", F.col("id").alias("component_id"))
    out = sigs.select("id", F.col("n").alias("n_shingles"), "node").join(lowest, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.col("component_id").isNull()).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w)
  UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)
), link AS MATERIALIZED (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT DISTINCT a AS d, a AS c FROM link
  UNION
  SELECT r.d, link.b FROM r JOIN link ON link.a = r.c
), m AS (
  SELECT d, min(c) AS c FROM r GROUP BY d
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.d = w.doc_id
"""
