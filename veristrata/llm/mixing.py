"""Mixing sources to target weights by minimum-cost flow.

A document may belong to several sources.  Documents are aggregated by their
membership pattern; only those sums (one row per pattern) reach the driver.
There a flow network routes word capacity from patterns to the sources'
quotas: the first pass over a pattern costs nothing, each repetition costs
more, so repeats are used only for what single passes cannot fill.  Documents
are then chosen in the order of a seeded hash, by a threshold per pattern that
three levels of bounded sums find; no whole source is sorted anywhere, and the
thresholds (one row a pattern, of at most ``MAX_PATTERNS``) go to the documents,
so no document is shuffled.

Defined results: a null or empty text has size 0 and is never taken; a very long
text counts all its words and is taken or left as a whole; null sources form
one source, ordered last; repeated rows of one id share a place in the seeded
order (a tie) and are taken or left together; an empty table gives an empty mix;
extra columns are kept by ``mix`` whatever their names, unless they carry the name
of an output column, which takes their place.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.llm.session import col, settle, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
SEED = "mix-1"
#: Bits of the seeded hash, and bits by which each of two levels of sums narrows a pattern's threshold.
HASH_BITS, LEVEL_BITS = 60, 8
#: Membership patterns that the driver routes; more are refused.
MAX_PATTERNS = 200_000


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: int = MAX_PASSES) -> dict:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its size.

    The excess of capped sources is reshared until none is above its cap; the
    level at which that ends is found by going through the sources in the
    order in which they reach their caps.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    parts = [(most * sizes[s], weights[k % len(weights)], k, s) for k, s in enumerate(names)]
    left, weight, level = share * sum(sizes.values()), sum(p[1] for p in parts), 0.0
    order = sorted(parts, key=lambda p: (p[0] / p[1], p[2]))
    for cap, w, _, _ in order:
        level = left / weight
        if level <= cap / w:
            break
        left, weight = left - cap, weight - w
        if weight:
            level = left / weight
    return {s: float(min(cap, level * w)) for cap, w, _, s in parts}


def route(capacity: dict, quota: dict, passes: int = MAX_PASSES) -> dict:
    """Words of each pattern (a tuple of sources) sent to each of its sources.

    Repetition costs rise with each pass and all other arcs are free, so the
    cheapest flow is reached by filling one pass after another to its maximum;
    shortest augmenting paths also reroute what earlier passes sent.
    """
    flow = {(p, s): 0 for p in capacity for s in p}
    patterns_of: dict = {}
    for p in capacity:
        for s in p:
            patterns_of.setdefault(s, []).append(p)
    left = dict(quota)
    for _ in range(passes):
        spare = dict(capacity)
        while True:
            seen: dict = {("p", p): None for p in capacity if spare[p] > 0}
            queue, end = deque(seen), None
            while queue and end is None:
                kind, at = node = queue.popleft()
                if kind == "p":
                    for s in at:
                        if ("s", s) not in seen:
                            seen[("s", s)] = node
                            queue.append(("s", s))
                            if left.get(s, 0) > 0:
                                end = ("s", s)
                                break
                else:
                    for p in patterns_of.get(at, ()):
                        if flow[(p, at)] > 0 and ("p", p) not in seen:
                            seen[("p", p)] = node
                            queue.append(("p", p))
            if end is None:
                break
            path, node = [], end
            while node is not None:
                path.append(node)
                node = seen[node]
            path.reverse()
            amount = min(spare[path[0][1]], left[end[1]])
            for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                if ka == "s":
                    amount = min(amount, flow[(b, a)])
            for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                if ka == "p":
                    flow[(a, b)] += amount
                else:
                    flow[(b, a)] -= amount
            spare[path[0][1]] -= amount
            left[end[1]] -= amount
    return flow


def seeded(key: str, seed: str = SEED):
    """A 60-bit hash of the id and the seed, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _limits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``_k, _limit``: the greatest hash of a pattern's rows that its rest of words still takes.

    Two levels narrow a pattern to the bucket in which its rest ends, each by at
    most 2**LEVEL_BITS sums; the last goes through that bucket's hashes.  ``plans`` and the
    levels' results have a row a pattern.
    """
    edge = plans.where("_rest > 0").select("_k", "_rest", F.lit(0).cast("long").alias("_from"), F.lit(0).cast("long").alias("_before"))
    for level in (1, 2, 3):
        width = max(HASH_BITS - level * LEVEL_BITS, 0) if level < 3 else 0
        inside = F.shiftright("_u", HASH_BITS - (level - 1) * LEVEL_BITS) == F.shiftright("_from", HASH_BITS - (level - 1) * LEVEL_BITS)
        sums = rows.join(F.broadcast(edge), "_k").where(inside)
        sums = sums.groupBy("_k", "_rest", "_before", F.shiftright("_u", width).alias("_b")).agg(F.sum("size").alias("n"))
        upto = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        if level < 3:
            found = sums.where((F.col("_at") <= F.col("_rest")) & (F.col("_at") + F.col("n") > F.col("_rest")))
            edge = settle(found.select("_k", "_rest", F.shiftleft("_b", width).alias("_from"), F.col("_at").alias("_before")))
        else:
            # The last whose middle is not beyond the rest.
            taken = sums.groupBy("_k").agg(F.max(F.when(2 * F.col("_at") + F.col("n") <= 2 * F.col("_rest"), F.col("_b"))).alias("_last"))
            taken = taken.join(F.broadcast(edge.select("_k", "_from")), "_k")
            return settle(taken.select("_k", F.coalesce("_last", F.col("_from") - 1).alias("_limit")))
    raise AssertionError


def mix(docs: DataFrame, sources, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES, seed: str = SEED, texts: bool = True) -> DataFrame:
    """``docs`` (without their texts unless ``texts``) with ``size, source_size, target, taken``.

    ``sources`` is an array column of a document's sources; ``source_size`` and
    ``target`` are those of its first source in code point order.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken") and (texts or c != "text")]
    member = F.array_sort(F.array_distinct(sources))
    pattern = F.to_json(F.struct(member.alias("p")))
    # What the documents carry travels in one column, so that no name of theirs meets one of ours.
    drawn = docs.select(F.struct(*[col(c) for c in kept]).alias("_doc"), n_words().alias("size"), seeded(key, seed).alias("_u"), member.alias("_p"), pattern.alias("_k"))
    rows = settle(drawn.drop("_doc") if texts else drawn)
    found = rows.groupBy("_k").agg(F.first("_p").alias("p"), F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sums = {tuple(r.p): r.n for r in found}
    sizes: dict = {}
    for p, n in sums.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, weights, share, passes)
    flow = route(sums, {s: int(t + 0.5) for s, t in targets.items()}, passes)
    plan = []
    for r in found:
        p = tuple(r.p)
        words = sum(flow[(p, s)] for s in p)
        whole = words // r.n if r.n else 0
        plan.append((r["_k"], sizes[p[0]], targets[p[0]], whole, words - whole * r.n))
    plans = spark.createDataFrame(plan, "_k string, source_size long, target double, _whole long, _rest long")
    limit = plans.join(_limits(rows, plans), "_k", "left")
    again = F.when((F.col("_rest") > 0) & (F.col("_u") <= F.col("_limit")), 1).otherwise(0)
    # Without their texts the documents have been settled already; with them they are read where they stand.
    chosen = (drawn if texts else rows).join(F.broadcast(limit), "_k")
    return chosen.select("_doc.*", "size", "source_size", "target", (F.col("size") * (F.col("_whole") + again)).alias("taken"))


def mix_by_source(docs: DataFrame, texts: bool = True) -> DataFrame:
    return mix(docs, F.array(F.col("source")), texts=texts)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), c AS (
  SELECT source, n, k, CAST(2 * n AS DOUBLE) AS cap, CAST(CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, 1.5::DOUBLE * (SELECT sum(n) FROM s) AS total FROM c
), l AS (
  SELECT min((total - capped) / open) FILTER (WHERE (total - capped) / open <= cap / w) AS first_level FROM o
), t AS (
  SELECT c.source, c.n AS source_size, least(cap, (SELECT (total - capped) / open FROM o WHERE (total - capped) / open <= cap / w ORDER BY cap / w, k LIMIT 1) * w) AS target FROM c
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest FROM q
), x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
