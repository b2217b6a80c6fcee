"""Queries of the text and sketch problems over the test tables, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloframe.llm import bpe, mixing, quantiles, reading
from veloframe.storage import materialize

POINTS = [0.5, 0.9, 0.95, 0.99]
GROUPS = ["func_name", "mode"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _day_sketches(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "routing_spans").withColumn("day", F.to_date("ts"))
    return quantiles.sketch(spans, [*GROUPS, "day"], "duration_ns")


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """From the sketches of single days, added up."""
    return quantiles.percentiles(quantiles.merge(_day_sketches(spark, sf), GROUPS), GROUPS, POINTS)


def p2_day_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.percentiles(_day_sketches(spark, sf), [*GROUPS, "day"], POINTS)


def p2_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the exact percentile lies within the stated bounds."""
    return _within(spark, sf, quantiles.merge(_day_sketches(spark, sf), GROUPS))


def _within(spark: SparkSession, sf: str, sketches: DataFrame) -> DataFrame:
    """Percentiles of merged sketches with whether the exact percentile lies within the stated bounds."""
    spans = table(spark, sf, "routing_spans").filter("duration_ns is not null")
    exact = spans.groupBy(*GROUPS).agg(*(F.expr(f"percentile_disc({q}) within group (order by duration_ns)").alias(f"e{i}") for i, q in enumerate(POINTS)))
    exact = exact.select(F.col("func_name").alias("_f"), F.col("mode").alias("_m"), F.explode(F.array(*(F.struct(F.lit(q).alias("_q"), F.col(f"e{i}").cast("long").alias("exact")) for i, q in enumerate(POINTS)))).alias("e"))
    p = quantiles.percentiles(sketches, GROUPS, POINTS)
    j = p.join(exact, p["func_name"].eqNullSafe(exact["_f"]) & p["mode"].eqNullSafe(exact["_m"]) & (p["q"] == exact["e._q"]))
    return j.select("func_name", "mode", "q", "n", F.col("e.exact").between(F.col("lower"), F.col("upper")).alias("within"))


def p2_dense_within(spark: SparkSession, sf: str) -> DataFrame:
    """The same with only 64 exact codes a group, so that nearly everything is in the counters, and with one day deleted and added again."""
    spans = table(spark, sf, "routing_spans")
    day = F.to_date("ts") == F.lit(spans.agg(F.min(F.to_date("ts")).alias("d")).first()["d"])
    part = lambda rows, sign: quantiles.sketch(rows, GROUPS, "duration_ns", sign, kept=64)
    parts = [part(spans, 1), part(spans.filter(day), -1), part(spans.filter(day), 1)]
    return _within(spark, sf, quantiles.merge(parts[0].unionAll(parts[1]).unionAll(parts[2]), GROUPS))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), "doc_id")


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of the bytes that the ids of each document stand for."""
    return bpe.decode(p7_ids(spark, sf), "doc_id").select("doc_id", F.md5("bytes").alias("digest"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(bpe.token_counts(table(spark, sf, "documents"), ["doc_id", "source"]), "token-counts")


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_counts(spark, sf), table(spark, sf, "mix_targets"), "doc_id")[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    counts, targets = _counts(spark, sf), table(spark, sf, "mix_targets")
    return mixing.mix_report(counts, mixing.mix(counts, targets, "doc_id")[0], targets)


def p8_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Per target whether no document is used more often than allowed, nor another one two times less often, and whether the tokens chosen are
    within one document of the budget."""
    chosen, plan = mixing.mix(_counts(spark, sf), table(spark, sf, "mix_targets"), "doc_id")
    budget = spark.createDataFrame([(s, float(p["budget"])) for s, p in plan.items()], "source string, budget double")
    used = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.min("repeats").alias("least"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("longest"))
    rows = table(spark, sf, "mix_targets").join(budget, "source").join(used, "source", "left")
    limits = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("most") - F.col("least") <= 1), F.lit(True))
    return rows.select("source", limits.alias("limits_kept"), (F.abs(F.coalesce("tokens", F.lit(0)) - F.col("budget")) <= F.coalesce("longest", F.lit(0))).alias("within_a_document"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return reading.grade(documents, reading.train(documents, table(spark, sf, "reading_labels")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).filter(F.col("reading_level") == reading.LEVELS).select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


def p9_validation(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return reading.validation(reading.train(documents, table(spark, sf, "reading_labels")), documents)


_WITHIN = " union all ".join(f"select func_name, mode, {q} as q, count(*) as n, true as within from routing_spans where duration_ns is not null group by func_name, mode" for q in POINTS)

QUERIES = {f.__name__: f for f in (p2_percentiles, p2_day_percentiles, p2_within_bound, p2_dense_within, p7_ids, p7_round_trip, p8_selection, p8_report, p8_within_budget, p9_found, p9_levels, p9_validation)}
SQL = {"p2_within_bound": f"select func_name, mode, cast(q as double) as q, n, within from ({_WITHIN})", "p2_dense_within": f"select func_name, mode, cast(q as double) as q, n, within from ({_WITHIN})", "p8_within_budget": "select source, true as limits_kept, true as within_a_document from mix_targets", "p7_round_trip": "select doc_id, md5(coalesce(text, '')) as digest from documents"}
