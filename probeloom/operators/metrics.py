"""Classification metrics, all derived from one small confusion table.

A prediction table has label, prediction and probs (in the order of a fixed
class list), plus any key columns naming the model, fold or group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeloom.functions import vectors as V
from probeloom.session import settle

PROBABILITY_FLOOR = 2.220446049250313e-16
METRICS = ("macro_f1", "accuracy", "balanced_accuracy", "log_loss")


def class_list(classes: Sequence[str]):
    return F.array(*[F.lit(c) for c in classes])


def with_prediction(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Add the label of the first largest probability."""
    return scored.withColumn(
        "prediction", F.element_at(class_list(classes), V.first_argmax(F.col("probs")) + 1)
    )


def confusion(predictions: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, prediction, n, loss: at most classes x classes rows per key.

    Everything below needs only this table, so predictions are scanned once and
    reduced map-side however skewed the labels are.
    """
    true_p = F.element_at("probs", F.array_position(class_list(classes), F.col("label")).cast("int"))
    clipped = F.least(F.greatest(true_p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0 - PROBABILITY_FLOOR))
    return predictions.groupBy(*keys, "label", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log(clipped)).alias("loss")
    )


def confusion_matrix(table: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per class, one column per predicted class, zeros filled in.

    Classes without true rows have a row too; labels outside the list are an error.
    """
    all_known(table, classes)
    return (
        with_classes(table, classes, keys).groupBy(*keys, "label").pivot("prediction", list(classes)).agg(F.sum("n"))
        .na.fill(0, subset=list(classes))
    )


def all_known(table: DataFrame, classes: Sequence[str]) -> None:
    stray = table.filter(~(F.col("label").isin(*classes) & F.col("prediction").isin(*classes))).limit(1).collect()
    if stray:
        raise ValueError(f"label {stray[0]['label']!r} or prediction {stray[0]['prediction']!r} is not a listed class")


def with_classes(table: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The confusion table with an empty cell on the diagonal for every listed class."""
    empty = table.select(*keys).distinct() if keys else table.sparkSession.range(1).drop("id")
    cells = empty.withColumn("label", F.explode(class_list(classes))).withColumn("prediction", F.col("label"))
    return table.unionByName(cells.select(
        *keys, "label", "prediction", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("loss")
    ))


def per_class(table: DataFrame, keys: Sequence[str] = (), classes: Sequence[str] | None = None) -> DataFrame:
    """keys, label, tp, predicted, support, loss, precision, recall, f1_score.

    With ``classes`` every listed class has a row, whether it occurs or not.
    """
    if classes is not None:
        all_known(table, classes)
        table = with_classes(table, classes, keys)
    hit = F.col("label") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"),
                 F.col("loss").alias("l"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0)).cast("long").alias("t")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                 F.lit(0.0).alias("l"), F.lit(0).cast("long").alias("t")),
    )
    counts = (
        table.select(*keys, F.inline(sides)).groupBy(*keys, F.col("c").alias("label"))
        .agg(F.sum("t").alias("tp"), F.sum("p").alias("predicted"), F.sum("s").alias("support"),
             F.sum("l").alias("loss"))
    )
    zero = F.lit(0.0)
    return counts.select(
        "*",
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("predicted") + F.col("support")), zero).alias("f1_score"),
    )


SUMMARIES = ("accuracy", "macro avg", "weighted avg")


def report(table: DataFrame, keys: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages.

    With ``labels`` the rows and averages are over that list. The class table is
    read four times, so it is evaluated once first.
    """
    classes = settle(per_class(table, keys, labels))
    clash = classes.filter(F.col("label").isin(*SUMMARIES)).limit(1).collect()
    if clash:
        raise ValueError(f"a class has the name of a summary row: {clash[0]['label']}")
    rows = classes.select(*keys, "label", "precision", "recall", "f1_score", "support")
    n = F.sum("support")

    def averaged(name: str, mean) -> DataFrame:
        return classes.groupBy(*keys).agg(
            F.lit(name).alias("label"),
            *[mean(c).alias(c) for c in ("precision", "recall", "f1_score")],
            n.alias("support"),
        )

    accuracy = F.sum("tp") / n
    return (
        rows.unionByName(averaged("accuracy", lambda c: accuracy))
        .unionByName(averaged("macro avg", F.avg))
        .unionByName(averaged("weighted avg", lambda c: F.sum(F.col(c) * F.col("support")) / n))
    )


def scalar_metrics(table: DataFrame, keys: Sequence[str] = (), classes: Sequence[str] | None = None) -> DataFrame:
    """keys, n_rows, macro_f1, accuracy, balanced_accuracy, log_loss.

    Macro-F1 averages over ``classes``, or else over labels seen in truth or
    prediction; balanced accuracy over labels with support.
    """
    return per_class(table, keys, classes).groupBy(*keys).agg(
        F.sum("support").alias("n_rows"),
        F.avg("f1_score").alias("macro_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum("loss") / F.sum("support")).alias("log_loss"),
    )


def scored_metrics(predictions: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return scalar_metrics(confusion(predictions, classes, keys), keys)
