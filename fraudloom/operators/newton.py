"""Logistic regressions fitted side by side: every fold, held-out group or muted feature set of
a protocol in the same few Spark jobs.

A fit sees the rows that its codes let in.  One job of an iteration evaluates all fits on every
batch of rows with matrix products and sends back, per fit, the sums of gradient and Hessian;
the driver holds only those sums (fits x features squared) and takes the Newton steps.  So the
number of jobs follows the iterations (about ten), not the folds or groups.

Rows are standardised once for all fits, with the mean and deviation over all rows; the penalty
of a fit is scaled to the deviations of its own rows, which gives the coefficients of a separate
fit on separately standardised rows.  A penalty of 1 is 1 / n on the mean loss (C = 1 on the sum).
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = 64  # fits evaluated together
TOL, MOST = 1e-9, 40


@dataclass(frozen=True)
class Fit:
    """A fit by name: rows with `without[c]` in an integer column c stay out, rows must have `only[c]` in c; muted features stay at zero."""

    name: str
    without: tuple[tuple[str, int], ...] = ()
    only: tuple[tuple[str, int], ...] = ()
    muted: tuple[str, ...] = ()
    penalty: float = 1.0  # 1 / C


@dataclass
class Linear:
    """A fitted curve on raw features: 1 / (1 + exp(-(intercept + sum of coefficient x feature)))."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    rows: int = 0
    steps: int = 0
    gradient: float = 0.0

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            out = out + F.col(c) * F.lit(b)
        return out

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "Linear":
        return cls(**json.loads(text))


@dataclass
class _State:
    """Where a fit stands, in standardised coordinates; the intercept is last."""

    beta: np.ndarray
    step: np.ndarray | None = None
    loss: float = np.inf
    done: bool = False
    steps: int = 0
    gradient: float = 0.0
    last: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _masks(batch: pa.RecordBatch, codes: list[str], fits: list[Fit]) -> np.ndarray:
    """rows x fits: whether a fit sees a row. A null code is no code."""
    at = {c: batch.column(c).fill_null(-(1 << 31)).to_numpy() for c in codes}
    out = np.ones((batch.num_rows, len(fits)), bool)
    for j, f in enumerate(fits):
        for c, v in f.without:
            out[:, j] &= at[c] != v
        for c, v in f.only:
            out[:, j] &= at[c] == v
    return out


def _sums(fits: list[Fit], codes: list[str], features: list[str], mean, dev, betas, weights):
    """Batches (features..., y, codes...) -> (fit, k, v): per-fit sums of the task. Without betas: moments."""
    d = len(features)

    def run(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features], axis=1)
            z = np.concatenate([(x - mean) / dev, np.ones((len(x), 1))], axis=1)
            y = b.column("__y").to_numpy(zero_copy_only=False).astype(np.float64)
            seen = _masks(b, codes, fits)
            if "__c" in b.schema.names:
                seen = seen * b.column("__c").to_numpy()[:, None]
            if betas is None:
                parts = np.concatenate([seen.sum(0)[:, None], (seen * y[:, None]).sum(0)[:, None], seen.T @ z[:, :d], seen.T @ z[:, :d] ** 2], axis=1)
            else:
                eta = z @ betas.T
                e = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
                w = seen * np.where(y[:, None] == 1, weights[:, 1], weights[:, 0])
                loss = (w * (np.maximum(eta, 0.0) + np.log1p(e) - y[:, None] * eta)).sum(0)
                grad = (w * (p - y[:, None])).T @ z
                upper = np.triu_indices(d + 1)
                half = (w * p * (1 - p)).T @ (z[:, upper[0]] * z[:, upper[1]])  # one product gives the Hessians of all fits
                hess = np.empty((len(fits), d + 1, d + 1))
                hess[:, upper[0], upper[1]] = hess[:, upper[1], upper[0]] = half
                hess = hess.reshape(len(fits), -1)
                parts = np.concatenate([loss[:, None], grad, hess], axis=1)
            total = parts if total is None else total + parts
        if total is not None:
            f, k = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(f.ravel().astype(np.int32)), pa.array(k.ravel().astype(np.int32)), pa.array(total.ravel())], names=["fit", "k", "v"])

    return run


def _collect(rows: DataFrame, shape: tuple[int, int], run) -> np.ndarray:
    """One job; at most fits x (features + 1)(features + 2) sums come back."""
    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "fit int, k int, v double").groupBy("fit", "k").agg(F.sum("v").alias("v")).collect():
        out[r.fit, r.k] = r.v
    return out


def fit_many(df: DataFrame, features: list[str], fits: list[Fit], label: str = "y", balanced: bool = True, standardise: bool = True, count: str | None = None) -> dict[str, Linear]:
    """name -> fitted curve.  Rows with a null label are left out; a null or NaN feature is an error.

    `balanced` weighs classes N / (2 N_class) inside every fit.  A fit whose rows have one class only keeps
    coefficients of zero.  `df` is read once an iteration: pass a stored table, with equal rows once and
    their number in `count` where rows repeat.
    """
    codes = sorted({c for f in fits for c, _ in (*f.without, *f.only)})
    bad = F.array_contains(F.transform(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v.isNull() | F.isnan(v)), True)
    checked = F.when(bad, F.raise_error(F.lit("a feature is null or NaN"))).otherwise(F.col(features[0]).cast("double"))
    rows = df.filter(F.col(label).isNotNull()).select(checked.alias(features[0]), *[F.col(c).cast("double").alias(c) for c in features[1:]], F.col(label).cast("int").alias("__y"), *codes, *([F.col(count).cast("double").alias("__c")] if count else []))
    stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    d = len(features)
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    dev = np.array([stats[f"s{i}"] or 0.0 for i in range(d)])
    dev = np.where(dev > 1e-12 * np.maximum(1.0, np.abs(mean)), dev, 1.0)
    out: dict[str, Linear] = {}
    for at in range(0, len(fits), GROUP):
        out |= _fit_group(rows, features, fits[at : at + GROUP], codes, mean, dev, balanced, standardise)
    return out


def _fit_group(rows, features, fits, codes, mean, dev, balanced, standardise) -> dict[str, Linear]:
    d, m = len(features), len(fits)
    got = _collect(rows, (m, 2 + 2 * d), _sums(fits, codes, features, mean, dev, None, None))
    n, pos, s1, s2 = got[:, 0], got[:, 1], got[:, 2 : 2 + d], got[:, 2 + d :]
    neg = n - pos
    # sample deviation of a fit's rows, in units of the common one
    var = (s2 - s1**2 / np.maximum(n, 1)[:, None]) / np.maximum(n - 1, 1)[:, None]
    own = np.sqrt(np.maximum(var, 0.0))
    scale = np.where(own > 1e-9, own, 0.0) ** 2 if standardise else np.broadcast_to((1.0 / dev) ** 2, own.shape)
    open_ = np.array([[f not in fit.muted for f in features] for fit in fits])
    if standardise:
        open_ &= own > 1e-9
    weights = np.ones((m, 2))
    if balanced:
        weights = np.stack([n / (2 * np.maximum(neg, 1)), n / (2 * np.maximum(pos, 1))], axis=1)
    total = weights[:, 0] * neg + weights[:, 1] * pos
    two = (pos > 0) & (neg > 0)
    lam = np.array([f.penalty for f in fits]) / np.maximum(n, 1)
    state = [_State(np.zeros(d + 1)) for _ in fits]
    for j, s in enumerate(state):
        s.beta[d] = np.log(weights[j, 1] * pos[j] / (weights[j, 0] * neg[j])) if two[j] else np.sign(pos[j] - neg[j]) * 30.0
        s.last, s.done = s.beta.copy(), not two[j]
    for _ in range(MOST):
        if all(s.done for s in state):
            break
        got = _collect(rows, (m, 1 + (d + 1) + (d + 1) ** 2), _sums(fits, codes, features, mean, dev, np.stack([s.beta for s in state]), weights))
        for j, s in enumerate(state):
            if s.done:
                continue
            pen = np.append(lam[j] * scale[j], 0.0)
            loss = got[j, 0] / total[j] + 0.5 * (pen * s.beta**2).sum()
            if loss > s.loss + 1e-12 and s.step is not None and np.abs(s.step).max() > 1e-10:
                s.step = s.step / 2  # the step was too long
                s.beta = s.last + s.step
                continue
            grad = got[j, 1 : d + 2] / total[j] + pen * s.beta
            hess = got[j, d + 2 :].reshape(d + 1, d + 1) / total[j] + np.diag(pen)
            use = np.append(open_[j], True)
            s.loss, s.last, s.gradient, s.steps = loss, s.beta.copy(), float(np.abs(grad[use]).max()), s.steps + 1
            step = np.zeros(d + 1)
            step[use] = -np.linalg.lstsq(hess[np.ix_(use, use)], grad[use], rcond=None)[0]
            s.step, s.done = step, bool(np.abs(grad[use]).max() < TOL)
            if not s.done:
                s.beta = s.beta + step
    out = {}
    for j, (fit, s) in enumerate(zip(fits, state)):
        raw = np.where(open_[j], s.last[:d] / dev, 0.0)
        out[fit.name] = Linear(list(features), [float(v) for v in raw], float(s.last[d] - (raw * mean).sum()), int(n[j]), s.steps, s.gradient)
    return out


def score_by(df: DataFrame, models: dict[str, Linear], key: Column, out: str = "p") -> DataFrame:
    """`df` with the probability of the model named by `key`: one expression over the features and a literal table of coefficients."""
    features = next(iter(models.values())).features
    row = lambda m: F.array(*[F.lit(v) for v in (*m.coefficients, m.intercept)])
    table = F.create_map(*[x for name, m in models.items() for x in (F.lit(name), row(m))])
    values = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    margin = F.aggregate(F.zip_with(values, table[key], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-margin)))


def save(spark: SparkSession, path: str, **models: Linear) -> None:
    spark.createDataFrame([(k, m.to_json()) for k, m in models.items()], "name string, model string").coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> dict[str, Linear]:
    return {r["name"]: Linear.from_json(r.model) for r in spark.read.schema("name string, model string").json(path).collect()}
