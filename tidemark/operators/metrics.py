"""Retrieval quality: relevance matchers, nDCG, nearest-rank percentiles, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHER_KEYS = ("repo", "path_prefix", "breadcrumb_substring")


def matcher(m: dict) -> Column:
    """Whether a chunk fits one matcher: all its keys must hold. Text in keys is literal."""
    parts = []
    if m.get("repo") is not None:
        parts.append(F.col("repo") == m["repo"])
    if m.get("path_prefix") is not None:
        parts.append(F.col("metadata")["path"].startswith(m["path_prefix"]))
    if m.get("breadcrumb_substring") is not None:
        parts.append(F.contains(F.lower("context_breadcrumb"), F.lit(m["breadcrumb_substring"].lower())))
    if not parts:
        raise ValueError(f"a matcher needs one of {', '.join(MATCHER_KEYS)}")
    return reduce(lambda a, b: a & b, parts)


def relevant(chunks: DataFrame, matchers: list[dict]) -> DataFrame:
    """Distinct ids of chunks that fit one of the matchers: a single scan with an OR."""
    if not matchers:
        return chunks.select("id").limit(0)
    return chunks.filter(reduce(lambda a, b: a | b, map(matcher, matchers))).select("id").distinct()


def dcg(rank: Column, hit: Column, k: int) -> Column:
    """Aggregate: sum of 1 / log2(rank + 1) over hits within the first k ranks."""
    return F.coalesce(F.sum(F.when(hit & (rank <= k), 1.0 / F.log2(rank + 1.0))), F.lit(0.0))


def ideal_dcg(n: Column, k: int) -> Column:
    """DCG of a ranking with its n relevant results first."""
    top = F.least(n, F.lit(k)).cast("int")
    return F.aggregate(F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def ndcg(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query, ndcg) for each query of relevance(query, id): ranked(query, rank, id) scored against
    it; a query without results scores 0, and so does one without relevant ids if it is ranked."""
    hits = ranked.join(relevance.distinct().withColumn("hit", F.lit(True)), ["query", "id"], "left")
    gained = hits.groupBy("query").agg(dcg(F.col("rank"), F.col("hit").isNotNull(), k).alias("dcg"))
    ideal = relevance.distinct().groupBy("query").agg(F.count("*").alias("n"))
    score = F.when(F.col("n").isNull() | (F.col("n") == 0), 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal_dcg(F.col("n"), k))
    return ideal.join(gained, "query", "full_outer").select("query", score.alias("ndcg"))


def ndcg_by_label(ranked: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, ndcg) where a row is relevant if it has the query's label: ranked(query, rank, id),
    queries(query, label), rows(id, label). The relevant rows are counted a label, never listed."""
    label = lambda df, c: df.select(F.col(c), F.col("label").alias(f"{c}_label"))
    few = ranked.join(label(queries, "query"), "query").join(label(rows, "id"), "id")
    gained = few.groupBy("query").agg(dcg(F.col("rank"), F.col("query_label") == F.col("id_label"), k).alias("dcg"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    score = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal_dcg(F.col("n"), k))
    return queries.join(sizes, "label", "left").join(gained, "query", "left").select("query", score.alias("ndcg"))


def percentile(column: str, p: float) -> Column:
    """Aggregate: the nearest-rank percentile, null without rows."""
    return F.expr(f"percentile_disc({p / 100!r}) within group (order by {column})")


def percentiles(rows: DataFrame, group: str, column: str, points: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(group, p<point>, ...): exact nearest-rank percentiles of each group, for groups of any size.

    percentile() holds a group's distinct values in one task. Here a sketch with rank error 1 / accuracy
    only says between which two values each point lies; what is below them is counted exactly, and
    only the values between them, a few in `accuracy`, are sorted. A rank outside its bounds would
    fail the query. Null values count nowhere; a group of nulls only has null percentiles."""
    some = rows.select(F.col(group).alias("g"), F.col(column).alias("v"))
    ends = [(max(p / 100 - 3 / accuracy, 0.0), min(p / 100 + 3 / accuracy, 1.0)) for p in points]
    near = F.percentile_approx("v", [e for pair in ends for e in pair], accuracy)
    sketched = some.groupBy(F.col("g").alias("eg")).agg(F.count("v").alias("n"), near.alias("near"), F.min("v").alias("least"), F.max("v").alias("most"))
    low = lambda i: F.col("least") if ends[i][0] == 0 else F.col("near")[2 * i]
    high = lambda i: F.col("most") if ends[i][1] == 1 else F.col("near")[2 * i + 1]
    rank = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.lit(p) * F.col("n") / 100))).cast("long")
    bounds = [c for i, p in enumerate(points) for c in (low(i).alias(f"low{i}"), high(i).alias(f"high{i}"), rank(p).alias(f"rank{i}"))]
    stats = sketched.select("eg", "n", *bounds)
    met = some.filter("v is not null").join(stats, F.col("g").eqNullSafe(F.col("eg")))
    every = range(len(points))
    below = met.groupBy(F.col("eg").alias("bg")).agg(F.array(*(F.count_if(F.col("v") < F.col(f"low{i}")) for i in every)).alias("below"))
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), F.col(f"rank{i}").alias("rank")) for i in every)))
    within = reduce(lambda x, y: x | y, (F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}")) for i in every))
    few = met.filter(within).select("eg", "v", asked.alias("a")).filter(F.col("v").between(F.col("a.low"), F.col("a.high")))
    values = few.groupBy("eg", "v", "a.i", "a.rank").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("eg", "i").orderBy("v")
    counted = values.join(below, F.col("eg").eqNullSafe(F.col("bg"))).withColumn("upto", F.get("below", F.col("i")) + F.sum("c").over(upto))
    hit = (F.col("upto") >= F.col("rank")) & (F.get("below", F.col("i")) < F.col("rank"))
    found = counted.groupBy(F.col("eg").alias("wg")).agg(*(F.min(F.when(hit & (F.col("i") == i), F.col("v"))).alias(f"v{i}") for i in every))
    whole = sketched.select("eg", "n").join(found, F.col("eg").eqNullSafe(F.col("wg")), "left")
    sure = lambda i: F.when((F.col("n") > 0) & F.col(f"v{i}").isNull(), F.raise_error(F.lit("a percentile lies outside its bounds")).cast("double")).otherwise(F.col(f"v{i}"))
    return whole.select(F.col("eg").alias(group), *(sure(i).alias(f"p{p:g}") for i, p in enumerate(points)))


def percentile_rank(values: list[float], p: float) -> float | None:
    """The nearest-rank percentile of a list."""
    if not values:
        return None
    n = len(values)
    at = -(-p * n // 100)
    return sorted(values)[int(min(max(at, 1), n)) - 1]


def overlap(a: Column, b: Column) -> Column:
    """Shared share of two id arrays: |A and B| / max(|A|, |B|), 1 if both are empty."""
    largest = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(largest == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / largest)


def summary(scored: DataFrame) -> DataFrame:
    """One row over scored(resolvable, ndcg, latency_ms): counts, mean nDCG and latency percentiles
    of the resolvable queries."""
    fine = lambda c: F.when(F.col("resolvable"), F.col(c))
    counts = scored.agg(
        F.count("*").alias("queries_total"), F.count_if("resolvable").alias("queries_resolved"), F.count_if(~F.col("resolvable")).alias("queries_unresolved"), F.avg(fine("ndcg")).alias("mean_ndcg"),
    )
    one = percentiles(scored.select(F.lit(1).alias("all"), fine("latency_ms").alias("latency")), "all", "latency", (50, 95, 99))
    return counts.join(one, F.lit(True), "left").drop("all")
