"""Company-year states, exit outcomes and their walk-forward."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.functions.columns import label_state, literal_table, log_loss
from oddsmith.functions.held import hold

# Fixed values.
OUTCOMES = ("filing", "acquired", "bankrupt", "deregistered")
BAD = ("bankrupt", "deregistered")
CONTINUOUS = ("log_assets", "leverage", "cash_ratio", "roa", "ocf_assets", "current_ratio", "going_concern")
DEFAULT = ("burning", "short_runway", "neg_equity", "going_concern")
EXITED = "exited"

_TASK_ROWS = 200_000  # company-years that one task of a Newton step takes at least


def is_bad(outcome: str = "outcome") -> Column:
    return F.col(outcome).isin(*BAD)


def ratios(panel: DataFrame) -> DataFrame:
    """Adds the ratios. Divisors are 1 at least; runway_years is infinite where no cash is burnt."""
    a = F.greatest("assets", F.lit(1.0))
    burn = F.greatest(-F.coalesce("ocf", F.lit(0.0)), F.lit(0.0))
    return panel.withColumns(
        {
            "log_assets": F.log10(a),
            "leverage": F.col("liabilities") / a,
            "cash_ratio": F.col("cash") / a,
            "roa": F.col("net_income") / a,
            "ocf_assets": F.col("ocf") / a,
            "current_ratio": F.when(F.col("current_liabilities").isNotNull(), F.col("current_assets") / F.greatest("current_liabilities", F.lit(1.0))),
            "runway_years": F.when(burn > 0, F.col("cash") / (burn + 1e-9)).otherwise(F.lit(float("inf"))),
            "going_concern": F.coalesce("going_concern", F.lit(0)),
        }
    )


@dataclass(frozen=True)
class Factor:
    flag: Callable[[], Column]
    yes: str
    no: str


REGISTRY = {
    "burning": Factor(lambda: F.col("ocf") < 0, "Burning", "CashPositive"),
    "short_runway": Factor(lambda: F.col("runway_years") < 1, "Runway<1y", "Runway>1y"),
    "neg_equity": Factor(lambda: F.col("equity") < 0, "NegEquity", "PosEquity"),
    "high_leverage": Factor(lambda: F.col("leverage") > 0.8, "HighLev", "LowLev"),
    "going_concern": Factor(lambda: F.col("going_concern") == 1, "GoingConcern", "NoGC"),
    "micro": Factor(lambda: F.col("assets") < 50e6, "Micro", "NotMicro"),
    "loss": Factor(lambda: F.col("net_income") < 0, "Loss", "Profit"),
}


def states(factors: Sequence[str] = DEFAULT) -> list[str]:
    return ["/".join(x) for x in itertools.product(*[(REGISTRY[f].yes, REGISTRY[f].no) for f in factors])]


def features(panel: DataFrame, factors: Sequence[str] = DEFAULT) -> DataFrame:
    """Eligible rows with ratios, one flag column `is_<factor>` each, and the state."""
    if unknown := set(factors) - set(REGISTRY):
        raise ValueError(f"unknown factors: {sorted(unknown)}")
    rows = ratios(panel.dropna(subset=["assets", "liabilities", "cash", "ocf"]))
    rows = rows.withColumns({f"is_{n}": F.coalesce(f.flag(), F.lit(False)) for n, f in REGISTRY.items()})
    return rows.withColumn("state", label_state([(F.col(f"is_{f}"), REGISTRY[f].yes, REGISTRY[f].no) for f in factors]))


def informative(panel: DataFrame, factors: Sequence[str] = DEFAULT) -> list[str]:
    """The factors without going_concern if the panel never knows it: one counting action."""
    known = panel.agg(F.count("going_concern")).first()[0]
    return [f for f in factors if f != "going_concern" or known]


def _grid(spark: SparkSession, factors: Sequence[str]) -> DataFrame:
    rows = [(s, o) for s in states(factors) for o in OUTCOMES]
    return literal_table(spark, rows, "state string, outcome string")


def _shrink(cells: DataFrame, prior: float, keys: Sequence[str]) -> DataFrame:
    total = lambda *c: F.sum("n").over(Window.partitionBy(*(list(keys) + list(c) or [F.lit(0)])))
    cells = cells.withColumns({"n_state": total("state"), "q": F.coalesce(F.try_divide(total("outcome"), total()), F.lit(0.0))})
    cells = cells.withColumn("w", F.col("n_state") / (F.col("n_state") + prior))
    return cells.withColumn("p", F.col("w") * F.coalesce(F.try_divide(F.col("n"), F.col("n_state")), F.col("q")) + (1 - F.col("w")) * F.col("q"))


def state_model(feat: DataFrame, factors: Sequence[str] = DEFAULT, prior: float = 20.0) -> DataFrame:
    """state, outcome, n, n_state, q, w, p over all rows of known outcome."""
    found = feat.filter("outcome_known").groupBy("state", "outcome").agg(F.count(F.lit(1)).alias("n"))
    cells = F.broadcast(_grid(feat.sparkSession, factors)).join(found, ["state", "outcome"], "left")
    return _shrink(cells.withColumn("n", F.coalesce("n", F.lit(0))), prior, [])


def transitions(feat: DataFrame, factors: Sequence[str] = DEFAULT) -> DataFrame:
    """from_state, to_state, n, p: the state a year later, or exited where the exit is known; not shrunk."""
    later = feat.groupBy("cik", (F.col("year") - 1).alias("year")).agg(F.min("state").alias("next_state"))
    gone = F.when(F.col("outcome_known") & (F.col("outcome") != "filing"), EXITED)
    pairs = feat.join(later, ["cik", "year"], "left").select(F.col("state").alias("from_state"), F.coalesce("next_state", gone).alias("to_state"))
    found = pairs.filter("to_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    names = states(factors)
    dense = literal_table(feat.sparkSession, [(a, b) for a in names for b in [*names, EXITED]], "from_state string, to_state string")
    cells = F.broadcast(dense).join(found, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.withColumn("p", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy("from_state"))), F.lit(0.0)))


def walk_forward(feat: DataFrame, factors: Sequence[str] = DEFAULT, prior: float = 20.0, min_train_years: int = 3, lag_years: int = 2) -> DataFrame:
    """Scored company-years: losses of state model and base rate, P(bad exit) of both.

    Cohort Y trains on all known cohorts up to Y - `lag_years`: counts per year are cumulated, then
    joined that many years later. Years with too few training cohorts are not scored.
    """
    known = feat.filter("outcome_known")
    per_year = known.groupBy("year", "state", "outcome").agg(F.count(F.lit(1)).alias("n"))
    years = known.select("year").distinct()
    tests = years.withColumnRenamed("year", "fold")
    pairs = F.broadcast(tests).join(years, F.col("year") <= F.col("fold") - lag_years)  # calendar years
    folds = pairs.groupBy("fold").agg(F.count(F.lit(1)).alias("train_years")).filter(F.col("train_years") >= min_train_years)
    summed = per_year.join(F.broadcast(pairs), "year").groupBy("fold", "state", "outcome").agg(F.sum("n").alias("n"))
    cells = folds.select("fold").join(F.broadcast(_grid(feat.sparkSession, factors))).join(summed, ["fold", "state", "outcome"], "left")
    fitted = _shrink(cells.withColumn("n", F.coalesce("n", F.lit(0))), prior, ["fold"])
    bad = lambda c: F.sum(F.when(is_bad(), F.col(c)).otherwise(0.0))
    per_state = fitted.groupBy("fold", "state").agg(bad("p").alias("p_bad_state"), bad("q").alias("p_bad_base"))
    rows = known.withColumn("fold", F.col("year")).join(F.broadcast(fitted.select("fold", "state", "outcome", "p", "q")), ["fold", "state", "outcome"])
    rows = rows.join(F.broadcast(per_state), ["fold", "state"])  # years x states
    return rows.withColumns({"ll_state": log_loss(F.col("p")), "ll_base": log_loss(F.col("q")), "y_bad": is_bad().cast("int")}).drop("fold", "p", "q")


# --- Logistic regression -------------------------------------------------------------------


@dataclass(frozen=True)
class Logit:
    """Fitted weights: the intercept's and one for each standardised column of CONTINUOUS."""

    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def _input(c: str) -> Column:
    """The column with 0 for what is missing or infinite."""
    return F.coalesce(F.when(F.abs(c) == float("inf"), 0.0).otherwise(F.col(c)), F.lit(0.0)).cast("double")


def _inputs(feat: DataFrame) -> DataFrame:
    """cik, year, y and CONTINUOUS, with 0 for what is missing or infinite."""
    return feat.select("cik", "year", is_bad().cast("double").alias("y"), *[_input(c).alias(c) for c in CONTINUOUS])


def design_blocks(known: DataFrame, most: int = 65_536) -> DataFrame:
    """year, x, y: the rows of `known` as blocks of at most `most` rows of one year each, float64 in row order."""
    names = list(CONTINUOUS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def block(year: int) -> pa.RecordBatch:
            whole = np.concatenate(held.pop(year))
            return pa.RecordBatch.from_arrays([pa.array([year], pa.int32()), pa.array([whole[:, 1:].tobytes()]), pa.array([whole[:, 0].tobytes()])], ["year", "x", "y"])

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", *names)], 1)
            years = batch.column("year").to_numpy(zero_copy_only=False)
            for year in np.unique(years).tolist():
                held.setdefault(year, []).append(table[years == year])
                if sum(map(len, held[year])) >= most:
                    yield block(year)
        for year in list(held):
            yield block(year)

    return _inputs(known).select(F.col("year").cast("int"), "y", *names).mapInArrow(blocks, "year int, x binary, y binary")


def fit_logits(known: DataFrame, folds: dict[int, int], l2: float = 1.0, steps: int = 25) -> dict[int, Logit]:
    """Penalised logistic regression by Newton's method; fold f trains on the years up to folds[f].

    The rows become numeric blocks once. Every step is one pass over the blocks for all folds that
    have not settled: tasks add up gradients and 8 x 8 Hessians, a tree adds the tasks' sums, and the
    driver solves one small system per fold.
    """
    spark, size = known.sparkSession, len(CONTINUOUS) + 1
    rows = _inputs(known)
    table = F.broadcast(literal_table(spark, list(folds.items()), "fold int, last int"))
    summed = rows.join(table, F.col("year") <= F.col("last")).groupBy("fold")
    found = summed.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in CONTINUOUS for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]).collect()
    stats = {r["fold"]: r for r in found}
    last = {f: folds[f] for f in stats}  # a fold without rows has no model
    mu = {f: np.array([stats[f][f"mu_{c}"] for c in CONTINUOUS]) for f in last}
    sd = {f: np.array([stats[f][f"sd_{c}"] for c in CONTINUOUS]) + 1e-9 for f in last}
    blocks = design_blocks(known)
    parts = -(-max((r["n"] for r in found), default=1) // _TASK_ROWS)  # a step is short: few rows need few tasks
    blocks = hold(blocks.coalesce(parts) if parts < blocks.rdd.getNumPartitions() else blocks).rdd
    weights = {f: np.zeros(size) for f in last}
    penalty = np.full(size, l2)
    penalty[0] = 0
    open_ = set(last)
    for _ in range(steps if last else 0):
        now = {f: weights[f] for f in open_}

        def sums(parts: Iterator, now: dict = now) -> Iterator[dict[int, np.ndarray]]:
            total: dict[int, np.ndarray] = {}
            for part in parts:
                y = np.frombuffer(part["y"])
                x = np.frombuffer(part["x"]).reshape(len(y), -1)
                for f, w in now.items():
                    if part["year"] <= last[f]:
                        z = np.column_stack([np.ones(len(y)), np.clip((x - mu[f]) / sd[f], -5, 5)])
                        p = 1 / (1 + np.exp(-z @ w))
                        total[f] = total.get(f, 0) + np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            yield total

        step = blocks.mapPartitions(sums).treeReduce(lambda a, b: {f: a.get(f, 0) + b.get(f, 0) for f in a.keys() | b.keys()})
        for f in list(open_):
            delta = np.linalg.solve(step[f][size:].reshape(size, size) + np.diag(penalty), step[f][:size] + penalty * weights[f])
            weights[f] = weights[f] - delta
            if float(np.abs(delta).max()) < 1e-10:
                open_.discard(f)
        if not open_:
            break
    return {f: Logit(weights[f], mu[f], sd[f]) for f in last}


def logit_probability(rows: DataFrame, models: dict[int, Logit], fold: str) -> DataFrame:
    """`rows` (with CONTINUOUS and a fold number) and p_bad_logit by the fold's model; other folds go."""
    table = [(f, m.weights.tolist(), m.mean.tolist(), m.deviation.tolist()) for f, m in models.items()]
    small = literal_table(rows.sparkSession, table, f"{fold} int, w array<double>, mu array<double>, sd array<double>")
    z = F.col("w")[0]
    for k, c in enumerate(CONTINUOUS):
        z = z + F.col("w")[k + 1] * F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (_input(c) - F.col("mu")[k]) / F.col("sd")[k]))
    return rows.join(F.broadcast(small), fold).withColumn("p_bad_logit", 1 / (1 + F.exp(-z))).drop("w", "mu", "sd")  # one row per calendar year


def yearly_logits(feat: DataFrame, min_train_years: int = 3, lag_years: int = 2) -> dict[int, Logit]:
    """The models of the cohorts; cohort Y trains on the known company-years up to Y - `lag_years`."""
    known = feat.filter("outcome_known")
    years = sorted(r[0] for r in known.select("year").distinct().collect())  # calendar years
    folds = {y: y - lag_years for y in years if sum(t <= y - lag_years for t in years) >= min_train_years}
    return fit_logits(known, folds) if folds else {}


def logit_scores(feat: DataFrame, min_train_years: int = 3, lag_years: int = 2) -> DataFrame:
    """cik, year, y, p_bad_logit of the known company-years by their cohort's model."""
    models = yearly_logits(feat, min_train_years, lag_years)
    return logit_probability(_inputs(feat.filter("outcome_known")), models, "year").select("cik", "year", "y", "p_bad_logit")


def final_logit(feat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """term and weight of the model of all known company-years, and its cik, year, p_bad_logit for all of `feat`."""
    known = feat.filter("outcome_known")
    models = fit_logits(known, {0: 9999})
    names = ["intercept", *CONTINUOUS]
    rows = [(n, float(x)) for m in models.values() for n, x in zip(names, m.weights, strict=True)]
    weights = literal_table(feat.sparkSession, rows, "term string, weight double")
    return weights, logit_probability(_inputs(feat).withColumn("fold", F.lit(0)), models, "fold").select("cik", "year", "p_bad_logit")
