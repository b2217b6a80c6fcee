"""Choosing among the plans of a person: selectors, weighted strategies, bounded plan memory, and score averaging.

Plans: ``person, plan_idx, score`` (null: none yet), ``selected``. Every selector is a grouped aggregate or one window over a person's plans,
so plans of a person meet in one shuffle; a person's plans are few by the memory bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloframe.functions.rng import uniform
from veloframe.storage import parameters


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def keep_selected(plans: DataFrame, person: str = "person") -> DataFrame:
    """The selected plan; persons with none or several come out in ``selection_errors``."""
    return plans.filter("selected").select(person, "plan_idx")


def selection_errors(plans: DataFrame, person: str = "person") -> DataFrame:
    return plans.groupBy(person).agg(F.sum(F.col("selected").cast("int")).alias("n_selected")).filter("n_selected <> 1")


def best(plans: DataFrame, person: str = "person", score: str = "score") -> DataFrame:
    """The best scored plan, the last of equals; NaN is above everything; persons without a scored plan are left out."""
    return plans.filter(F.col(score).isNotNull()).groupBy(person).agg(F.max_by("plan_idx", F.struct(score, "plan_idx")).alias("plan_idx"))


def _worst_order(person: str, score: str) -> Window:
    clean = F.when(~F.isnan(score), F.col(score))
    return Window.partitionBy(person).orderBy(F.col("_chosen").asc(), clean.asc_nulls_first(), F.col("plan_idx").asc())


def worst(plans: DataFrame, person: str = "person", score: str = "score") -> DataFrame:
    """The worst plan: one that isn't selected if there is any, without a score or NaN before all others, the first of equals."""
    rows = plans.withColumn("_chosen", F.coalesce(F.col("selected"), F.lit(False)))
    return rows.withColumn("_r", F.row_number().over(_worst_order(person, score))).filter("_r = 1").select(person, "plan_idx")


def bounded(plans: DataFrame, most: int, person: str = "person", score: str = "score") -> DataFrame:
    """What is left when the worst plan is removed until no person has more than ``most``. Removing the worst never changes the order of the
    rest, so the first ``n - most`` of one ranking go."""
    rows = plans.withColumn("_chosen", F.coalesce(F.col("selected"), F.lit(False)))
    rows = rows.withColumn("_r", F.row_number().over(_worst_order(person, score))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(person)))
    return rows.filter(F.col("_r") > F.col("_n") - most).drop("_r", "_n", "_chosen")


def at_random(plans: DataFrame, u: Column, person: str = "person") -> DataFrame:
    """The plan number floor(u n), u a number in [0, 1) that is the same for all plans of a person."""
    ranked = plans.withColumn("_u", u).withColumn("_i", F.row_number().over(Window.partitionBy(person).orderBy("plan_idx")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(person)))
    return ranked.filter(F.col("_i") == F.least(F.floor(F.col("_u") * F.col("_n")), F.col("_n") - 1)).select(person, "plan_idx")


def logit(plans: DataFrame, beta: float = 1.0, person: str = "person", score: str = "score") -> DataFrame:
    """``plans`` with ``probability``: exp(beta (score - best)) over its sum. Where a score is missing or not finite the first plan has
    probability 1; beta 0 makes all equal."""
    w = Window.partitionBy(person)
    sound = F.min(_finite(F.col(score)).cast("int")).over(w) == 1
    weight = F.exp(beta * (F.col(score) - F.max(score).over(w)))
    if beta == 0:
        return plans.withColumn("probability", 1.0 / F.count(F.lit(1)).over(w))
    rows = plans.withColumn("_ok", sound).withColumn("_w", F.when(F.col("_ok"), weight)).withColumn("_first", F.min("plan_idx").over(w))
    share = F.col("_w") / F.sum("_w").over(w)
    return rows.withColumn("probability", F.when(F.col("_ok"), share).otherwise((F.col("plan_idx") == F.col("_first")).cast("double"))).drop("_ok", "_w", "_first")


def draw(rows: DataFrame, weight: str, u: Column, group: str, order: str) -> DataFrame:
    """One row per group, with a probability in proportion to its weight: the first, in this order, whose running sum of weights is greater
    than u times the total, and the last row of positive weight if rounding leaves none. Weights of 0 or less never win; a group without a
    positive weight has no row."""
    w = Window.partitionBy(group)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(F.col(weight) > 0).withColumn("_u", u)
    rows = rows.withColumn("_run", F.sum(weight).over(run)).withColumn("_all", F.sum(weight).over(w)).withColumn("_last", F.max(order).over(w))
    hit = rows.filter((F.col("_u") * F.col("_all") < F.col("_run")) | (F.col(order) == F.col("_last")))
    return hit.withColumn("_r", F.row_number().over(w.orderBy(order))).filter("_r = 1").drop("_r", "_u", "_run", "_all", "_last")


def by_logit(plans: DataFrame, u: Column, beta: float = 1.0, person: str = "person", score: str = "score") -> DataFrame:
    return draw(logit(plans, beta, person, score), "probability", u, person, "plan_idx").select(person, "plan_idx")


def person_stream(base_seed: int, purpose: str, iteration: int, person: Column) -> Column:
    """A uniform number per person, iteration and purpose."""
    return uniform(base_seed, purpose, F.concat(F.lit(f"{iteration}:"), person))


#: Strategies that only choose among plans, and those that make new ones.
SELECTORS = ["KeepLastSelected", "BestScore", "SelectRandom", "WorstScore", "SelectExpBeta"]
INNOVATIONS = ["ReRoute", "ReRouteIgnore"]


def innovation_off(iteration: int, first: int, last: int, fraction: float) -> bool:
    """Whether new plans are no longer made: progress through the iterations has reached the fraction (a single iteration is the end)."""
    progress = (iteration - first) / (last - first) if last > first else 1.0
    return progress >= fraction


def strategies(persons: DataFrame, weights: DataFrame, u: Column, innovation: bool = True) -> DataFrame:
    """``person, strategy``: drawn by the weights of the person's subpopulation (``subpopulation, strategy, weight``, a null subpopulation is
    that of persons without one). Without innovation only selectors take part; persons for whom no weight is left have no row."""
    w = weights if innovation else weights.filter(F.col("strategy").isin(*SELECTORS))
    w = w.filter("weight > 0").select(F.col("subpopulation").alias("_s"), "strategy", "weight")
    rows = persons.join(parameters(w), F.col("subpopulation").eqNullSafe(F.col("_s")))
    return draw(rows, "weight", u, "person", "strategy").select("person", "strategy")


def apply_choice(plans: DataFrame, choice: DataFrame) -> DataFrame:
    """``plans`` with ``selected`` moved to the chosen plan; persons without a choice keep theirs."""
    c = choice.select(F.col("person").alias("_p"), F.col("plan_idx").alias("_i"))
    rows = plans.join(c, F.col("person") == F.col("_p"), "left")
    return rows.withColumn("selected", F.when(F.col("_p").isNull(), F.col("selected")).otherwise(F.col("plan_idx") == F.col("_i"))).drop("_p", "_i")


def copy_selected(plans: DataFrame, persons: DataFrame) -> DataFrame:
    """For these persons a copy of the selected plan, without a score and with a fresh average, becomes the selected one."""
    top = plans.groupBy("person").agg((F.max("plan_idx") + 1).alias("_new"))
    chosen = plans.join(persons.select("person").distinct(), "person", "left_semi")
    copies = chosen.filter("selected").join(top, "person").withColumn("plan_idx", F.col("_new").cast(plans.schema["plan_idx"].dataType)).drop("_new").withColumn("score", F.lit(None).cast("double"))
    if "msa_n" in plans.columns:
        copies = copies.withColumn("msa_n", F.lit(0).cast(plans.schema["msa_n"].dataType))
    marked = plans.join(persons.select("person").distinct().withColumn("_c", F.lit(True)), "person", "left").withColumn("selected", F.col("selected") & F.col("_c").isNull()).drop("_c")
    return marked.unionByName(copies)


def averaging_start(first: int, last: int, fraction: float) -> int:
    return int((last - first) * fraction + first)


def assign_scores(plans: DataFrame, scores: DataFrame, averaging: bool) -> DataFrame:
    """The selected plan of each scored person gets ``new``: as it is, or, while averaging, the running mean with the scores counted so far.
    A plan without a score takes the new one without counting it."""
    s = scores.select(F.col("person").alias("_p"), F.col("score").alias("new"))
    rows = plans.join(s, (F.col("person") == F.col("_p")) & F.col("selected"), "left")
    n = F.coalesce(F.col("msa_n"), F.lit(0))
    hit, mean = F.col("_p").isNotNull(), (F.lit(averaging) & F.col("score").isNotNull())
    alpha = 1.0 / (n + 1)
    score = F.when(~hit, F.col("score")).when(mean, alpha * F.col("new") + (1 - alpha) * F.col("score")).otherwise(F.col("new"))
    count = F.when(hit & mean, n + 1).otherwise(n)
    return rows.withColumns({"score": score, "msa_n": count.cast(plans.schema["msa_n"].dataType)}).drop("_p", "new")
