"""Age-stitched prediction models fitted out of fold from sums, their scores and contributions.

A model belongs to an age and to the fold it leaves out. Nothing is fitted row by row on the
driver: one aggregate gives the sums of every age and fold, the sums of a training set are the
total less its fold, and the driver solves systems of a few unknowns. Least squares needs one
such aggregate a generation of ages; logistic regression one more for each Newton step, which
serves all ages and folds of the generation at once.

Models are rows (age, fold, kind, features, means, weights, base): scoring is a join with that
small table and an expression, and the stored table is its own list of members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.plans.scores import longevity_q
from cohortspark.sources.stored import settle

MAX_STEPS = 50
DIGITS = 9  # scores are rounded: ranks must not depend on the order of a sum
MODEL = "age int, fold int, kind string, features array<string>, means array<double>, weights array<double>, base double"


@dataclass(frozen=True)
class Model:
    """Prediction ``base + sum of weight * (value - mean)``, a missing value at its mean; logistic models on the logit scale."""

    age: int
    fold: int
    kind: str
    features: list[str]
    means: list[float]
    weights: list[float]
    base: float


Bundle = dict[tuple[int, int], Model]
Fit = Callable[[DataFrame, Sequence[str], int], Bundle]


def fold_of(nfolds: int, key: str = "id") -> Column:
    """Folds from the first digits of an md5, so that any tool can assign them."""
    mark = F.md5(F.col(key).cast("string").cast("binary"))
    return (F.conv(F.substring(mark, 1, 6), 16, 10).cast("long") % nfolds).cast("int")


def _sums(train: DataFrame, size: int, add: Callable[[int, int, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums by (age, fold) of what ``add(age, fold, x, y)`` gives for the rows of a batch.

    One row a task, age and fold is shuffled; ages x folds vectors reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            age, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = batch.column(3).to_numpy()
            for a, f in {*zip(age.tolist(), fold.tolist())}:
                at = (age == a) & (fold == f)
                for to, value in add(a, f, x[at], y[at]):
                    totals[a, to] = totals.get((a, to), 0.0) + value
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([totals[k] for k in keys], pa.list_(pa.float64()))],
            ["age", "fold", "s"])

    parts = train.select("age", "fold", "x", "y").mapInArrow(run, "age int, fold int, s array<double>")
    found = parts.groupBy("age", "fold").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
    return {(r["age"], r["fold"]): np.array(r["s"]) for r in found}


def _moments(train: DataFrame, p: int, nfolds: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (age, fold left out): products of (1, known value.., missing.., outcome), from one aggregate."""

    def add(age, fold, x, y):
        known = ~np.isnan(x)
        z = np.column_stack([np.ones(len(x)), np.where(known, x, 0.0), ~known, y])
        yield fold, (z.T @ z).ravel()

    sums = _sums(train, (2 * p + 2) ** 2, add)
    ages = {a for a, _ in sums}
    total = {a: sum(v for (b, _), v in sums.items() if b == a) for a in ages}
    left = {(a, f): (total[a] - sums.get((a, f), 0.0)).reshape(2 * p + 2, -1) for a in ages for f in range(nfolds)}
    return {key: m for key, m in left.items() if m[0, 0] > 0.5}  # some row to learn from


def _centred(m: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the known values, and products of (1, value less mean.., a missing one 0) with themselves and the outcome.

    What is left of a feature without spread is rounding, and becomes 0.
    """
    known = m[0, 0] - m[0, 1 + p : 1 + 2 * p]
    means = np.where(known > 0, m[0, 1 : 1 + p] / np.maximum(known, 1), 0.0)
    a = np.zeros((1 + p, 1 + 2 * p))
    a[0, 0] = 1.0
    for j in range(p):
        a[1 + j, [0, 1 + j, 1 + p + j]] = -means[j], 1.0, means[j]
    g, c = a @ m[:-1, :-1] @ a.T, a @ m[:-1, -1]
    flat = np.r_[False, np.diag(g)[1:] <= 1e-10 * np.diag(m)[1 : 1 + p]]
    g[flat], g[:, flat], c[flat] = 0.0, 0.0, 0.0
    return means, g, c


def _ridge(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Penalty on weights in units of their feature's spread; a feature without spread gets weight 0."""
    return penalty * np.r_[0.0, np.diag(gram)[1:] + 1e-9 * gram[0, 0]]


def linear(train: DataFrame, names: Sequence[str], nfolds: int, penalty: float = 1e-3) -> Bundle:
    """Least squares of the outcome, with a ridge penalty on standardised weights."""
    p, out = len(names), {}
    for (age, fold), m in _moments(train, p, nfolds).items():
        means, g, c = _centred(m, p)
        b = np.linalg.solve(g + np.diag(_ridge(g, penalty)), c)
        out[age, fold] = Model(age, fold, "linear", list(names), means.tolist(), b[1:].tolist(), float(b[0]))
    return out


def logistic(train: DataFrame, names: Sequence[str], nfolds: int, penalty: float = 1e-3, tolerance: float = 1e-9) -> Bundle:
    """Logistic regression of an outcome or probability, with a ridge penalty on standardised weights."""
    p = len(names)
    moments = _moments(train, p, nfolds)
    means, ridge, beta = {}, {}, {}
    for key, m in moments.items():
        means[key], g, _ = _centred(m, p)
        ridge[key] = _ridge(g, penalty)
        beta[key] = np.zeros(p + 1)
    for _ in range(MAX_STEPS):

        def add(age, fold, x, y):
            for other in range(nfolds):
                if other == fold or (age, other) not in beta:
                    continue
                z = np.column_stack([np.ones(len(x)), np.nan_to_num(x - means[age, other])])
                q = 0.5 * (1 + np.tanh(0.5 * (z @ beta[age, other])))
                yield other, np.concatenate([z.T @ (y - q), ((z * (q * (1 - q))[:, None]).T @ z).ravel()])

        sums, largest = _sums(train, (p + 1) * (p + 2), add), 0.0
        for key, s in sums.items():
            gradient = s[: p + 1] - ridge[key] * beta[key]
            move = np.linalg.lstsq(s[p + 1 :].reshape(p + 1, -1) + np.diag(ridge[key]), gradient, rcond=1e-14)[0]
            beta[key] = beta[key] + np.clip(move, -5.0, 5.0)
            largest = max(largest, float(np.abs(move).max()))
        if largest < tolerance:
            break
    else:
        raise ArithmeticError(f"not converged after {MAX_STEPS} steps")
    return {(a, f): Model(a, f, "logistic", list(names), means[a, f].tolist(), b[1:].tolist(), float(b[0])) for (a, f), b in beta.items()}


def models_table(spark: SparkSession, bundle: Mapping[tuple[int, int], Model]) -> DataFrame:
    if not bundle:
        raise ValueError("no models")
    return spark.createDataFrame([tuple(asdict(m).values()) for m in bundle.values()], MODEL)


def save_bundle(spark: SparkSession, bundle: Mapping[tuple[int, int], Model], path: str) -> str:
    """One table: a row a model, which is also the list of what the bundle holds."""
    models_table(spark, bundle).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    return {(r["age"], r["fold"]): Model(**r.asDict()) for r in spark.read.schema(MODEL).parquet(path).collect()}


def _terms(features: DataFrame, bundle: Mapping[tuple[int, int], Model], on: Sequence[str] = ("age",)) -> DataFrame:
    """Rows beside the models of their age, with each model's terms (feature, value, contribution)."""
    names = sorted({n for m in bundle.values() for n in m.features})
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("double"))])
    models = F.broadcast(models_table(features.sparkSession, bundle))  # ages x folds rows
    rows = features.withColumn("_values", values).join(models, list(on))
    term = F.transform(F.arrays_zip("features", "means", "weights"), lambda t: F.struct(
        t["features"].alias("feature"), F.col("_values")[t["features"]].alias("value"),
        F.coalesce(t["weights"] * (F.col("_values")[t["features"]] - t["means"]), F.lit(0.0)).alias("contribution")))
    return rows.withColumn("_terms", term)


def _score() -> Column:
    total = F.col("base") + F.aggregate("_terms", F.lit(0.0), lambda acc, t: acc + t["contribution"])
    bounded = F.when(F.col("kind") == "logistic", 1 / (1 + F.exp(-total))).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    return F.round(bounded, DIGITS)


def model_score(bundle: Mapping[tuple[int, int], Model], features: DataFrame) -> DataFrame:
    """id, sex, age, cv, score: every fold's model on the features of its age, each with its own features."""
    return _terms(features, bundle).select("id", "sex", "age", F.col("fold").alias("cv"), _score().alias("score"))


def held_out(bundle: Mapping[tuple[int, int], Model], rows: DataFrame) -> DataFrame:
    """id, sex, age, fold, score: each row by the model that has not seen its fold."""
    return _terms(rows, bundle, ("age", "fold")).select("id", "sex", "age", "fold", _score().alias("score"))


def contributions(bundle: Mapping[tuple[int, int], Model], features: DataFrame) -> DataFrame:
    """id, age, fold, feature, value, contribution, of every row under every fold's model of its age.

    Contributions are exact: they add up to the prediction less that of a row at the means.
    """
    rows = _terms(features, bundle).select("id", "age", "fold", F.inline("_terms"))
    return rows.select("id", "age", "fold", "feature", "value", "contribution")


def importance(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature (and key, such as fold or age)."""
    return table.groupBy(*keys, "feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def top_features(summary: DataFrame, k: int = 6) -> DataFrame:
    return summary.orderBy(F.col("mean_abs").desc_nulls_last(), "feature").limit(k)


def _generations(ages: Sequence[int], step: int) -> list[list[int]]:
    """Ages in the order they can be fitted: a generation's older models are all in the one before."""
    rank = {}
    for age in sorted(ages, reverse=True):
        rank[age] = rank.get(age + step, -1) + 1
    return [sorted(a for a in rank if rank[a] == g) for g in range(max(rank.values(), default=-1) + 1)]


def _stitch(rows: DataFrame, names: Sequence[str], ages: Sequence[int], step: int, nfolds: int, known: Column, unstitched: Column,
            fit: Fit) -> tuple[Bundle, DataFrame]:
    """Models and held-out scores, oldest generation first.

    ``known`` is 1, 0 or null where an older model says how likely the outcome is;
    ``unstitched`` is the same at ages without an older model, where null rows are left out.
    """
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    rows = rows.filter(F.col("age").isin(list(ages))).withColumns({"age": F.col("age").cast("int"), "fold": fold_of(nfolds), "_known": known, "_last": unstitched})
    rows = settle(rows.select("id", "sex", "age", "fold", "_known", "_last", *[F.col(f"`{n}`") for n in names]), "model-rows")
    bundle: Bundle = {}
    table = older = None
    for generation in _generations(ages, step):
        mine = rows.filter(F.col("age").isin(generation))
        if older is None:
            outcome = mine.withColumn("y", F.col("_last").cast("double"))
        else:
            later = older.select("id", (F.col("age") - step).alias("age"), F.col("score").alias("_p"))
            outcome = mine.join(later, ["id", "age"], "left").withColumn("y", F.coalesce(F.col("_known").cast("double"), "_p"))
        models = fit(outcome.filter("y is not null").select("age", "fold", x.alias("x"), "y"), names, nfolds)
        bundle |= models
        if not models:
            continue
        older = settle(held_out(models, mine), "held-out")  # the next generation's outcomes: lineage ends here
        table = older if table is None else table.unionByName(older)
    if table is None:
        raise ValueError("no rows with a known outcome")
    return bundle, table


def train_mortality(features: DataFrame, vital: DataFrame, names: Sequence[str], ages: Sequence[int], step: int = 5,
                    nfolds: int = 5, required: str | None = None, fit: Fit = logistic) -> tuple[Bundle, DataFrame]:
    """Models of dying, oldest ages first; the younger outcome is the older model's score.

    features: id, sex, age and the named columns; vital: id, death_age, last_age. Returns
    the models and each patient's held-out score with its quantile by age and sex.
    """
    if required is not None:
        features = features.filter(F.col(required).isNotNull())
    rows = features.join(vital, "id").filter(F.col("death_age").isNull() | (F.col("death_age") > F.col("age")))
    until = F.col("age") + step
    died = F.when(F.col("death_age") <= until, 1)
    bundle, table = _stitch(rows, names, ages, step, nfolds, died, died.when(F.col("last_age") >= until, 0), fit)
    return bundle, longevity_q(table, "score").withColumnRenamed("score_q", "quantile")


def train_disease(features: DataFrame, vital: DataFrame, onsets: DataFrame, names: Sequence[str], ages: Sequence[int],
                  step: int = 5, nfolds: int = 5, required: str | None = None, fit: Fit = logistic) -> tuple[Bundle, DataFrame]:
    """Models of falling ill among patients not yet ill; dying first counts as not falling ill.

    onsets: id, onset_age.
    """
    if required is not None:
        features = features.filter(F.col(required).isNotNull())
    rows = features.join(vital, "id").join(onsets.select("id", "onset_age"), "id", "left")
    rows = rows.filter((F.col("death_age").isNull() | (F.col("death_age") > F.col("age")))
                       & (F.col("onset_age").isNull() | (F.col("onset_age") > F.col("age"))))
    until = F.col("age") + step
    state = F.when(F.col("onset_age") <= until, 1).when(F.col("death_age") <= until, 0)
    bundle, table = _stitch(rows, names, ages, step, nfolds, state, state.when(F.col("last_age") >= until, 0), fit)
    return bundle, longevity_q(table, "score").withColumnRenamed("score_q", "quantile")
