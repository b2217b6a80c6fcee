"""Mixing sources to target weights: each source gives its share of the tokens, small sources are repeated up to a limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloframe.operators.ordered import range_sorted
from veloframe.storage import materialize

#: Targets are a parameter table; more sources than this are refused rather than sent to the driver.
MOST_SOURCES = 100_000


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> dict[str, dict]:
    """Per target source: its share, its budget of tokens, whole epochs, and the rest to be cut from one more epoch.

    Shares are the weights over the sum of the weights of the sources that have tokens (weight and repeats above 0). ``total`` is by
    default the greatest for which every source can fill its share, so shares come out exactly, to a document; for a greater total, sources
    that run out give all they may."""
    usable = {s: (w, k) for s, w, k in targets if w > 0 and k > 0 and available.get(s, 0) > 0}
    weights = sum(w for w, _ in usable.values())
    if total is None:
        total = min((available[s] * k * weights / w for s, (w, k) in usable.items()), default=0.0)
    plan = {}
    for s, w, k in targets:
        n, share = available.get(s, 0), usable[s][0] / weights if s in usable else 0.0
        budget = min(total * share, float(n * k))
        whole = int(budget // n) if n else 0
        plan[s] = {"share": share, "budget": budget, "whole": whole, "rest": budget - whole * n if whole < k else 0.0}
    return plan


def mix(counts: DataFrame, targets: DataFrame, id: str, source: str = "source", size: str = "n_tokens", total: float | None = None, seed: int = 11) -> tuple[DataFrame, dict[str, dict]]:
    """``id, source, n_tokens, repeats`` of the chosen records, and the plan.

    Records stand in a random order by a hash of id and seed, the same at every run; the whole epochs of a source take all of its records,
    the last one is cut in that order at the rest of the budget: where the running sum passes it, the record is taken if that comes closer.
    The order is a range-sort within each source over the whole cluster, running sums come from the sums of the partitions before, so a
    source of any size is cut without being gathered. Records of a null or unlisted source, of size 0 or of null size are never chosen;
    repeated targets of one source are an error; empty inputs give an empty result."""
    if targets.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "weight", "max_repeats").filter("source is not null").collect()]
    if len({s for s, _, _ in wanted}) < len(wanted):
        raise ValueError("a source has several targets")
    kind = counts.schema[id].dataType.simpleString()
    rows = counts.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).filter("n_tokens > 0 and source is not null")
    rows = rows.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    available = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most one row a target
    plan = budgets(wanted, available, total)
    ordered = range_sorted(rows.withColumn("_u", F.xxhash64("id", F.lit(seed))), ["source", "_u", "id"])
    sums = ordered.groupBy("_pid", "source").agg(F.sum("n_tokens").alias("n")).collect()  # partitions + sources rows: a source is contiguous
    before: dict[tuple[int, str], int] = {}
    running: dict[str, int] = {}
    for r in sorted(sums, key=lambda r: r["_pid"]):
        before[r["_pid"], r["source"]] = running.get(r["source"], 0)
        running[r["source"]] = running.get(r["source"], 0) + r["n"]
    rest = {s: p["rest"] for s, p in plan.items()}
    whole = {s: p["whole"] for s, p in plan.items()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upto: dict[str, int] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            pid, take = int(pdf["_pid"].iloc[0]), np.zeros(len(pdf), np.int64)
            for s, at in pdf.groupby("source", sort=False).indices.items():
                n = pdf["n_tokens"].to_numpy()[at]
                after = upto.get(s, before.get((pid, s), 0)) + np.cumsum(n)
                upto[s] = int(after[-1])
                take[at] = whole[s] + ((after <= rest[s]) | ((after - n < rest[s]) & (after - rest[s] < rest[s] - (after - n))))
            yield pdf.assign(repeats=take)[["id", "source", "n_tokens", "repeats"]][take > 0]

    chosen = materialize(ordered.mapInPandas(cut, f"id {kind}, source string, n_tokens long, repeats long"), "mix")
    ordered.unpersist()
    return chosen.withColumnRenamed("id", id), plan


def mix_report(counts: DataFrame, chosen: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per source of either side: weight and limit, documents and tokens there are, documents and tokens chosen, mean repeats, the target share
    (weight over the sum of the weights), the share aimed at (over the weights of sources that have tokens and may be used) and the actual one."""
    there = counts.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).cast("long").alias("tokens"))
    used = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("chosen_docs"), F.sum("repeats").alias("chosen_copies"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("chosen_tokens"))
    usable = (F.col("weight") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    weights, total = targets.agg(F.sum("weight")).first()[0], used.agg(F.sum("chosen_tokens")).first()[0]  # one row each
    rows = there.join(targets.select(F.col("source").alias("_t"), "weight", "max_repeats"), F.col("source").eqNullSafe(F.col("_t")), "full_outer").withColumn("source", F.coalesce("source", "_t")).drop("_t")
    rows = rows.join(used.withColumnRenamed("source", "_u"), F.col("source").eqNullSafe(F.col("_u")), "left").drop("_u")
    aimed = F.when(usable, F.col("weight"))
    usable_sum = rows.agg(F.sum(aimed)).first()[0]  # one row
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "tokens", "chosen_docs", "chosen_copies", "chosen_tokens")]
    return rows.select("source", "weight", "max_repeats", *zero, (F.coalesce("chosen_copies", F.lit(0)) / F.when(F.col("chosen_docs") > 0, F.col("chosen_docs"))).alias("mean_repeats"), (F.coalesce("weight", F.lit(0.0)) / F.lit(weights if weights else None).cast("double")).alias("target_share"), (F.coalesce(aimed, F.lit(0.0)) / F.lit(usable_sum or None).cast("double")).alias("aimed_share"), (F.coalesce("chosen_tokens", F.lit(0)) / F.lit(total if total else None).cast("double")).alias("actual_share"))
