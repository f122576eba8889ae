"""Scores turned into chances by a stored calibration, and a list ranked by several orders with its filters as flags."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyline.operators.newcomers import fold_logits
from tallyline.operators.ranking import By, with_running_sum


# ------------------------------------------------------------------------------------------------ calibration

def fit_calibration(rows: DataFrame, xs: list[str], outcomes: list[str], period: str, targets: list[int], *, ridge: float = 1e-3, min_rows: int = 50) -> DataFrame:
    """(outcome, period, term, value, rows, base_rate): for every outcome and target period the chance as a logit of ``xs``, from earlier periods' rows.

    ``rows`` must hold only rows whose outcome counts (such as those that played). Terms are on the scale of ``xs``. A target without enough rows, or with one kind of outcome, has no rows here.
    """
    out = []
    for outcome in outcomes:
        fits = fold_logits(rows, xs, outcome, period, targets, ridge=ridge, min_rows=min_rows, min_class=1)
        for t, beta in fits.beta.items():
            slopes = beta[1:] / fits.scale[t]
            terms = {"intercept": float(beta[0] - slopes @ fits.mean[t]), **{x: float(b) for x, b in zip(xs, slopes)}}
            out += [(outcome, int(t), term, value, fits.n[t], fits.positive[t] / fits.n[t]) for term, value in terms.items()]
    return rows.sparkSession.createDataFrame(out, "outcome string, period long, term string, value double, rows long, base_rate double")


def shape_of(xs: list[str], outcomes: list[str]) -> str:
    return ",".join(xs) + ">" + ",".join(outcomes)


def save_calibration(fitted: DataFrame, path: str, *, model: str, shape: str) -> int:
    """Add ``fitted`` as the next version of ``model`` in the parameter table at ``path``; older versions stay. The version's number."""
    spark = fitted.sparkSession
    stored = _stored(spark, path)
    last = None if stored is None else stored.where(F.col("model") == model).agg(F.max("version")).first()[0]
    version = 1 + (last or 0)
    fitted.withColumns({"model": F.lit(model), "version": F.lit(version).cast("long"), "shape": F.lit(shape), "write_id": F.lit(uuid.uuid4().hex)}).write.mode("append").parquet(path)
    return version


def load_calibration(spark: SparkSession, path: str, *, model: str, shape: str) -> DataFrame | None:
    """The newest version of ``model``; None if there is none, or if its shape is not ``shape``: parameters of another shape are never guessed at."""
    stored = _stored(spark, path)
    if stored is None:
        return None
    mine = stored.where(F.col("model") == model)
    newest = mine.agg(F.max_by("shape", "version").alias("shape"), F.max("version").alias("version")).first()
    if newest["version"] is None or newest["shape"] != shape:
        return None
    return mine.where(F.col("version") == newest["version"]).select("outcome", "period", "term", "value", "rows", "base_rate")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def with_chances(df: DataFrame, calibration: DataFrame | None, xs: list[str], outcomes: list[str], period: str) -> DataFrame:
    """``df`` with ``<outcome>_chance``; null without a calibration of its period, or where one of ``xs`` is null."""
    if calibration is None:
        return df.withColumns({f"{o}_chance": F.lit(None).cast("double") for o in outcomes})
    terms = ["intercept", *xs]
    # one row per outcome and period, the number of outcomes being that of the caller's list
    wide = calibration.groupBy("period").agg(*[F.max(F.when((F.col("outcome") == o) & (F.col("term") == t), F.col("value"))).alias(f"_{o}_{i}") for o in outcomes for i, t in enumerate(terms)])
    out = df.join(F.broadcast(wide.withColumnRenamed("period", "_at")), F.col(period) == F.col("_at"), "left")
    for o in outcomes:
        z = F.col(f"_{o}_0")
        for i, x in enumerate(xs, 1):
            z = z + F.col(f"_{o}_{i}") * F.col(x).cast("double")
        out = out.withColumn(f"{o}_chance", F.when(z.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))))
    return out.drop("_at", *[f"_{o}_{i}" for o in outcomes for i in range(len(terms))])


# ------------------------------------------------------------------------------------------------ the list

def ranked_watchlist(df: DataFrame, group: list[str], orders: dict[str, list[By]], filters: dict[str, Column], **kw) -> DataFrame:
    """``df`` with a flag ``is_<filter>`` for each of ``filters`` and a place ``<order>_<filter>`` among the rows that pass it, for every order.

    A place is the running count of flagged rows, so all filters of an order come from one sort, and choosing another order or filter later is a plain
    selection. Orders should end in a unique key; oversized groups are ranked by value ranges. Rows that a filter leaves out have no place in it.
    """
    out = df.withColumns({f"is_{name}": F.coalesce(flag, F.lit(False)) for name, flag in filters.items()})
    for order, keys in orders.items():
        for name in filters:
            place = f"{order}_{name}"
            out = with_running_sum(out, group, keys, F.col(f"is_{name}").cast("long"), place, **kw).withColumn(place, F.when(F.col(f"is_{name}"), F.col(place)))
    return out


def select_watchlist(full: DataFrame, order: str, name: str, n: int) -> DataFrame:
    """The first ``n`` places of one order and filter."""
    return full.where(F.col(f"{order}_{name}") <= n).withColumnRenamed(f"{order}_{name}", "place")
