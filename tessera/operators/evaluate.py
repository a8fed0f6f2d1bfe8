"""Classification metrics (V1-V5) from a predictions DataFrame.

Precision / recall / F1 come from the confusion counts (one ``groupBy``; its
size is classes x classes).  ROC AUC is the exact rank-sum statistic with
mid-ranks for tied scores; ranks come from a distributed sort, so no global
window or driver-side sort is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import col
from tessera.plans.ordering import with_running_total, with_running_totals

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def require_target(df: DataFrame, target: str | None) -> None:
    """V5: the target column must exist."""
    if not target or target not in df.columns:
        raise ValueError(f"no column {target!r} to compare predictions with")


def confusion_matrix(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """V4: counts of actual x predicted."""
    return (pred.groupBy(col(label).alias("actual"), col(prediction).alias("predicted"))
                .agg(F.count(F.lit(1)).alias("count")))


def classification_report(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """V1/V2: accuracy and support-weighted precision, recall and F1 (0 on
    zero division), as one row."""
    cm = confusion_matrix(pred, label, prediction)
    actual = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    predicted = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("npred"))
    hits = cm.where(F.col("actual") == F.col("predicted")).select(
        F.col("actual").alias("cls"), F.col("count").alias("tp"))
    per_class = (actual.join(predicted, "cls", "full").join(hits, "cls", "left")
                 .fillna(0, subset=["support", "npred", "tp"]))
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per_class = per_class.select("support", "tp", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0,
                2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    total = F.sum("support")
    return per_class.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("support") * F.col("p")) / total).alias("precision"),
        (F.sum(F.col("support") * F.col("r")) / total).alias("recall"),
        (F.sum(F.col("support") * f1) / total).alias("f1"))


def _auc_by_class(scored: DataFrame) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney with mid-ranks) for each class ``_c`` of
    rows (_c, _y, _s): one row per class, null where one side is empty.

    Equal scores are counted first, so that a score many rows share is one
    row of the sort; ranks are running totals of those counts."""
    ties = scored.groupBy("_c", "_s").agg(F.sum("_y").alias("npos"), F.count(F.lit(1)).alias("n"))
    ranked = with_running_total(ties, ["_c", "_s"], "n", "_before")
    mid = F.col("_before") + (F.col("n") + 1) / 2.0
    per = ranked.groupBy("_c").agg(F.sum(F.col("npos") * mid).alias("rsum"), F.sum("npos").alias("p"),
                                   F.sum("n").alias("n"), F.min("_before").alias("start"))
    neg = F.col("n") - F.col("p")
    rsum = F.col("rsum") - F.col("p") * F.col("start")
    auc = F.try_divide(rsum - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * neg)
    return per.select("_c", F.when((F.col("p") > 0) & (neg > 0), auc).alias("auc"))


def binary_auc(data: DataFrame, is_positive: Column, score: Column) -> DataFrame:
    """Exact ROC AUC as a one-row DataFrame; null if a class is absent."""
    scored = data.select(F.lit("").alias("_c"), is_positive.cast("long").alias("_y"), score.cast("double").alias("_s"))
    return _auc_by_class(scored).agg(F.max("auc").alias("roc_auc"))


def multiclass_auc(data: DataFrame, label: str, scores: dict[str, Column]) -> DataFrame:
    """One-vs-rest macro AUC: {class value: score column}, ranked together in
    one distributed sort; null if a class is absent from the rows."""
    items = [F.struct(F.lit(str(c)).alias("_c"),
                      (col(label).cast("string") == F.lit(str(c))).cast("long").alias("_y"),
                      s.cast("double").alias("_s")) for c, s in scores.items()]
    long = data.select(F.explode(F.array(*items)).alias("r")).select("r.*")
    whole = F.count("auc") == len(scores)
    return _auc_by_class(long).agg(F.when(whole, F.avg("auc")).alias("roc_auc"))


def curve_points(data: DataFrame, is_positive: Column, score: Column, steps: int = 200) -> DataFrame:
    """Points of the ROC and precision-recall curves: ``threshold`` (rows of at
    least this score count as positive; null before the first), ``tp``, ``fp``,
    ``tpr`` (recall), ``fpr`` and ``precision`` (null where nothing is).

    Equal scores are one point, from counts by score and running totals.  Of
    the points within a ``steps``-th of both rates the last is kept, so there
    are at most 2 * steps + 2 of any number of rows, and the area by
    trapezoids is off by at most 1 / (2 * steps) from that of all points.
    Rows whose score or label is null are left out; rates are null where a
    class is absent."""
    rows = data.select(is_positive.cast("long").alias("_y"), score.cast("double").alias("_s")).where("_y IS NOT NULL AND _s IS NOT NULL")
    ties = (rows.groupBy((-F.col("_s")).alias("_d")).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_q", F.col("_n") - F.col("_p")))
    total = ties.agg(F.coalesce(F.sum("_p"), F.lit(0)).alias("p"), F.coalesce(F.sum("_q"), F.lit(0)).alias("q")).first()
    ranked = with_running_totals(ties, ["_d"], {"_p": "_tp", "_q": "_fp"})
    reached = ranked.select((-F.col("_d")).alias("threshold"), (F.col("_tp") + F.col("_p")).alias("tp"), (F.col("_fp") + F.col("_q")).alias("fp"))
    cell = [F.expr(f"CASE WHEN {total[k]} = 0 THEN 0 ELSE {name} * {steps}L DIV {max(total[k], 1)}L END") for k, name in (("p", "tp"), ("q", "fp"))]
    last = (reached.groupBy((cell[0] + cell[1]).alias("_cell"))
            .agg(F.max_by(F.struct("threshold", "tp", "fp"), F.col("tp") + F.col("fp")).alias("x")).select("x.*"))
    start = data.sparkSession.createDataFrame([(None, 0, 0)], "threshold double, tp long, fp long")
    tp, fp = F.col("tp"), F.col("fp")
    return start.unionByName(last).select(
        "threshold", "tp", "fp", F.try_divide(tp, F.lit(total["p"])).alias("tpr"), F.try_divide(fp, F.lit(total["q"])).alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"))


def curve_area(points: DataFrame) -> float | None:
    """Area below the ROC curve of (at most a few hundred) points, by
    trapezoids."""
    at = sorted((r["fpr"], r["tpr"]) for r in points.collect() if r["fpr"] is not None and r["tpr"] is not None)
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at, at[1:])) if at else None


def probability_scores(pred: DataFrame, labels: Sequence[str],
                       probability: str = "_ts_probability") -> dict[str, Column]:
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(col(probability))
    return {lbl: arr[i] for i, lbl in enumerate(labels)}


def evaluate(pred: DataFrame, target: str, metrics: Sequence[str] = METRICS,
             prediction: str = "predicted_label", labels: Sequence[str] | None = None,
             probability: str = "_ts_probability") -> DataFrame:
    """The reference's evaluation request as (metric, value) rows."""
    require_target(pred, target)
    actual = col(target).cast("string")
    data = pred.withColumn("_ts_actual", actual)
    report = classification_report(data, "_ts_actual", prediction)
    wanted = [m for m in ("accuracy", "precision", "recall", "f1") if m in metrics]
    out = report.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wanted]))
        .alias("r")).select("r.*") if wanted else None
    if "roc_auc" in metrics:
        if not labels or probability not in pred.columns:  # the model gives no scores
            auc = pred.sparkSession.range(1).select(F.lit(None).cast("double").alias("roc_auc"))
        elif len(labels) == 2:
            auc = binary_auc(data, F.col("_ts_actual") == F.lit(labels[1]),
                             probability_scores(data, labels, probability)[labels[1]])
        else:
            auc = multiclass_auc(data, "_ts_actual", probability_scores(data, labels, probability))
        auc = auc.select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
        out = auc if out is None else out.unionByName(auc)
    return out
