"""Retrieval quality: graded recall, reciprocal rank, discounted gain and their summaries.

Predictions are rows (query_id, rank, item) with ranks from 1; labels are rows
(query_id, item, grade) with grade 1.0 for relevant and 0.5 for acceptable items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with their grade, 0 where there is no label."""
    return predictions.join(labels, ["query_id", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def per_query(queries: DataFrame, predictions: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg, top1) of every query; a query without labels has zeros.

    The first hit counts for the reciprocal rank, acceptable or relevant.
    """
    hits = graded(predictions.filter(F.col("rank") <= k), labels)
    gain = F.col("grade") / F.log2(F.col("rank") + 1.0)
    got = hits.groupBy("query_id").agg(
        F.sum("grade").alias("got"),
        F.sum(gain).alias("dcg"),
        F.min_by(F.col("grade") / F.col("rank"), F.when(F.col("grade") > 0, F.col("rank"))).alias("rr"),
        F.max(F.when(F.col("rank") == 1, F.col("grade") > 0)).alias("top1"),
    )
    ranked = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list("grade"))), 1, k), lambda g, i: F.struct(g.alias("g"), (g / F.log2(i + 2.0)).alias("d")))
    ideal = labels.groupBy("query_id").agg(ranked.alias("best")).select(
        "query_id",
        F.aggregate("best", F.lit(0.0), lambda a, x: a + x.g).alias("ideal"),
        F.aggregate("best", F.lit(0.0), lambda a, x: a + x.d).alias("idcg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = queries.join(got, "query_id", "left").join(ideal, "query_id", "left")
    return out.select("query_id", zero(F.col("got") / F.col("ideal")).alias("recall"), zero(F.when(F.col("ideal") > 0, F.col("rr"))).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), F.coalesce("top1", F.lit(False)).alias("top1"))


def summary(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Count and, of each metric, mean, least, greatest and deviation, and how many are none or whole: by each
    group alone, by the first two together and overall, in one pass (grouping sets)."""
    sets = [[g] for g in groups] + [groups[:2], []]
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 6).alias(m), F.round(F.min(m), 6).alias(f"{m}_low"), F.round(F.max(m), 6).alias(f"{m}_high"), F.round(F.stddev_pop(m), 6).alias(f"{m}_spread")]
    first = F.col(metrics[0])
    aggs += [F.count_if(first == 0).alias("missed"), F.count_if(first >= 1).alias("whole")]
    return rows.groupingSets(sets, *groups).agg(F.grouping_id().cast("int").alias("level"), *aggs)


def ablation(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(mode, n, top1, top3, avg_ms) over runs (mode, query_id, rank, item, took_ms): shares of queries with a labelled item at the top."""
    hits = graded(runs, labels).groupBy("mode", "query_id").agg(F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("best"), F.first("took_ms").alias("took_ms"))
    share = lambda k: F.round(F.avg((F.coalesce("best", F.lit(k + 1)) <= k).cast("double")), 6)
    return hits.groupBy("mode").agg(F.count("*").alias("n"), share(1).alias("top1"), share(3).alias("top3"), F.round(F.avg("took_ms"), 6).alias("avg_ms"))


def spread(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean, population deviation, least and greatest of each group."""
    m = F.col(metric)
    return rows.groupBy(by).agg(F.round(F.avg(m), 6).alias("mean"), F.round(F.stddev_pop(m), 6).alias("pstdev"), F.min(m).alias("low"), F.max(m).alias("high"))


def threshold(mean: Column, deviation: Column, floor: float) -> Column:
    """The greater of a floor and the mean less two deviations, at least 0."""
    return F.greatest(F.lit(floor), F.greatest(F.lit(0.0), mean - 2 * deviation))


def verdict(delta: Column) -> Column:
    """+2 or more is fine, -5 or more minor, else a regression."""
    return F.when(delta >= 2, "ok").when(delta >= -5, "minor").otherwise("regression")


def selected(scored: DataFrame, by: str, item: str, score: str, least: float, cap: int) -> DataFrame:
    """(by, items): items at `least` or more, the best `cap` of them, in order of the item."""
    best = scored.filter(F.col(score) >= least).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i")))).alias("x"))
    return best.select(by, F.array_sort(F.transform(F.slice("x", 1, cap), lambda x: x.i)).alias("items"))


def golden(near: DataFrame, docs: DataFrame, wanted: list[str], k: int, least: float) -> DataFrame:
    """(query_id, doc_id, label) over ranked neighbours (query_id, doc_id, sim, rank): relevant are those of the
    first k that hold a wanted word, or the first where none does; acceptable are others of `least` similarity."""
    hits = docs.select("doc_id", F.exists(F.array(*map(F.lit, wanted)), lambda w: F.contains("text", w)).alias("_hit"))
    rows = near.join(hits, "doc_id").withColumn("_hit", F.col("_hit") & (F.col("rank") <= k))
    some = F.bool_or("_hit").over(Window.partitionBy("query_id"))
    label = F.when(F.col("_hit") | ((F.col("rank") == 1) & ~some), "relevant").when(F.col("sim") >= least, "acceptable")
    return rows.withColumn("label", label).filter("label IS NOT NULL").drop("_hit")


def candidates(forced: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, doc_id, place): forced documents first, by id, then ranked neighbours that are none of them."""
    f = forced.select("query_id", "doc_id", F.lit(0).alias("_kind"), F.col("doc_id").alias("_at"))
    n = near.select("query_id", "doc_id", F.lit(1).alias("_kind"), F.col("rank").cast("bigint").alias("_at"))
    first = f.unionByName(n).groupBy("query_id", "doc_id").agg(F.min(F.struct("_kind", "_at")).alias("_x"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_x", "doc_id"))
    return first.select("query_id", "doc_id", place.alias("place"))


def cost_guard(costs: DataFrame, by: str, order: list[str], cap: float, unit: float) -> DataFrame:
    """Rows with what is decided before each: `break` where one more unit would pass the cap, `alert` the first
    time that 80 % are spent, else `proceed`; negative costs count nothing."""
    w = Window.partitionBy(by).orderBy(*order)
    spent = F.coalesce(F.sum(F.greatest(F.col("cost"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = costs.withColumn("_spent", spent).withColumn("_break", F.col("_spent") + unit > cap + 1e-9)
    high = ~F.col("_break") & (F.col("_spent") + 1e-9 >= 0.8 * cap)
    seen = F.count_if(high).over(w.rowsBetween(Window.unboundedPreceding, 0))
    action = F.when(F.col("_break"), "break").when(high & (seen == 1), "alert").otherwise("proceed")
    return rows.withColumn("action", action).drop("_spent", "_break")
