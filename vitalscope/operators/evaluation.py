"""Evaluation of an ordered class: everything derives from the confusion counts.

Class 0 is the most urgent. Predicting lower than the truth is over-triage,
predicting higher is under-triage. The counts have at most classes squared
rows, so all but the first group-by works on a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import repair

# Fixed values.
SAFETY_TOLERANCE = 0.5
WEAK_F1 = 0.70
FEW_ROWS = 2
CLASS_NAMES = ["L0 (Emerg)", "L1 (Urgent)", "L2 (Std)", "L3 (NonU)"]


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by=()) -> DataFrame:
    """label, prediction, n for the cells that occur, per group ``by``."""
    return df.groupBy(
        *by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))


def confusion_grid(cells: DataFrame, n_classes: int | None = None) -> DataFrame:
    """All cells from class 0 to the largest class seen, empty ones with 0."""
    if n_classes is None:
        top = cells.agg(F.greatest(F.max("label"), F.max("prediction"))).scalar()
        span = F.sequence(F.lit(0), top)
    else:
        span = F.sequence(F.lit(0), F.lit(n_classes - 1))
    one = cells.sparkSession.range(1)
    grid = one.select(F.explode(span).alias("label")).withColumn("prediction", F.explode(span))
    return grid.join(cells, ["label", "prediction"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def confusion_wide(cells: DataFrame, n_classes: int) -> DataFrame:
    """One row per true class, one column per predicted class."""
    grid = confusion_grid(cells, n_classes)
    columns = [
        F.sum(F.when(F.col("prediction") == k, F.col("n")).otherwise(0)).alias(f"pred_{k}")
        for k in range(n_classes)
    ]
    return grid.groupBy("label").agg(*columns)


def _share(condition: Column) -> Column:
    return 100.0 * F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def _over() -> Column:
    return F.col("prediction") < F.col("label")


def _under() -> Column:
    return F.col("prediction") > F.col("label")


def _right() -> Column:
    return F.col("prediction") == F.col("label")


def error_rates(cells: DataFrame, by=()) -> DataFrame:
    """Accuracy, over- and under-triage in percent of all rows, with grades."""
    grouped = cells.groupBy(*by) if by else cells.groupBy()
    rates = grouped.agg(
        F.sum("n").alias("n_rows"),
        _share(_right()).alias("accuracy"),
        _share(_under()).alias("under_triage_pct"),
        _share(_over()).alias("over_triage_pct"),
    )
    return rates.withColumn("safety_grade", repair.safety_grade(F.col("under_triage_pct"))).withColumn(
        "efficiency_grade", repair.efficiency_grade(F.col("over_triage_pct"))
    )


def class_rates(cells: DataFrame) -> DataFrame:
    """Per true class: counts and rates in percent of that class."""
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return cells.groupBy("label").agg(
        F.sum("n").alias("total_actual"),
        total(_right()).alias("correct"),
        total(_over()).alias("over_triage"),
        total(_under()).alias("under_triage"),
        _share(_right()).alias("correct_rate"),
        _share(_over()).alias("over_triage_rate"),
        _share(_under()).alias("under_triage_rate"),
    )


def error_patterns(cells: DataFrame) -> DataFrame:
    """Each kind of misclassification with its direction and share of the true class."""
    of_class = Window.partitionBy("label")  # at most one row per predicted class
    shared = cells.withColumn("share_pct", 100.0 * F.col("n") / F.sum("n").over(of_class))
    return shared.filter(~_right() & (F.col("n") > 0)).withColumn(
        "direction",
        F.when(_over(), "UPGRADED (over-triage)").otherwise("DOWNGRADED (under-triage)"),
    )


def class_report(cells: DataFrame, by=()) -> DataFrame:
    """precision, recall, f1 and support per class; a zero division gives 0."""
    by = list(by)
    true = cells.groupBy(*by, F.col("label").alias("class")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(_right(), F.col("n")).otherwise(0)).alias("tp"),
    )
    predicted = cells.groupBy(*by, F.col("prediction").alias("class")).agg(
        F.sum("n").alias("predicted")
    )
    both = true.join(predicted, [*by, "class"], "full").na.fill(0, ["support", "tp", "predicted"])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return (
        both.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn(
            "f1",
            ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .select(*by, "class", "precision", "recall", "f1", "support")
    )


def report_averages(report: DataFrame, by=()) -> DataFrame:
    """Macro and weighted means of a class report."""
    grouped = report.groupBy(*by) if by else report.groupBy()
    aggs = []
    for name in ("precision", "recall", "f1"):
        aggs.append(F.avg(name).alias(f"macro_{name}"))
        aggs.append(
            (F.sum(F.col(name) * F.col("support")) / F.sum("support")).alias(f"weighted_{name}")
        )
    return grouped.agg(*aggs, F.sum("support").alias("support"))


def weak_classes(report: DataFrame, folds: int = 5) -> DataFrame:
    """Flags: low f1, very few rows, fewer rows than folds."""
    return report.withColumn("is_weak", F.col("f1") < WEAK_F1).withColumn(
        "is_tiny", F.col("support") <= FEW_ROWS
    ).withColumn("fewer_rows_than_folds", F.col("support") < folds)


def fold_metrics(predictions: DataFrame, fold: str = "fold", by=()) -> DataFrame:
    """Accuracy, macro f1 and error rates of every fold."""
    keys = [*by, fold]
    cells = confusion(predictions, by=keys)
    rates = error_rates(cells, by=keys).drop("safety_grade", "efficiency_grade")
    macro = report_averages(class_report(cells, by=keys), by=keys).select(*keys, "macro_f1")
    return rates.join(macro, keys)


def fold_summary(per_fold: DataFrame, by=()) -> DataFrame:
    """Mean and population deviation over folds."""
    grouped = per_fold.groupBy(*by) if by else per_fold.groupBy()
    aggs = []
    for name in ("accuracy", "macro_f1", "under_triage_pct"):
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    out = grouped.agg(*aggs, F.avg("over_triage_pct").alias("over_triage_pct_mean"))
    return out.withColumn("safety_grade", repair.safety_grade(F.col("under_triage_pct_mean")))


def select_method(
    results: DataFrame, tolerance: float = SAFETY_TOLERANCE, order: str = "ord"
) -> DataFrame:
    """The method to keep: among those within ``tolerance`` points of the lowest
    under-triage the most accurate, then the lower under-triage, then the first.
    """
    lowest = results.agg(F.min("under_triage_pct")).scalar()
    safe = results.filter(F.col("under_triage_pct") <= lowest + tolerance)
    return safe.orderBy(F.desc("accuracy"), "under_triage_pct", order).limit(1)


def most_accurate(results: DataFrame, order: str = "ord") -> DataFrame:
    return results.orderBy(F.desc("accuracy"), "under_triage_pct", order).limit(1)


def best_by_macro_f1(summary: DataFrame, order: str = "ord") -> DataFrame:
    """The model with the highest mean macro F1 over its folds; of equal ones the first."""
    return summary.orderBy(F.desc("macro_f1_mean"), order).limit(1)


def override_cost(results: DataFrame, method: str, tolerance: float = SAFETY_TOLERANCE) -> DataFrame:
    """What choosing ``method`` by hand costs against the automatic choice."""
    auto = select_method(results, tolerance)
    return results.filter(F.col("method") == method).select(
        "method",
        auto.select("method").scalar().alias("automatic_method"),
        (F.col("under_triage_pct") - auto.select("under_triage_pct").scalar())
        .alias("under_triage_cost"),
        (F.col("accuracy") - auto.select("accuracy").scalar()).alias("accuracy_gain"),
    )


def against_baseline(results: DataFrame, baseline: str) -> DataFrame:
    """Change of accuracy and under-triage against one method."""
    base = results.filter(F.col("method") == baseline)
    return results.select(
        "method",
        (F.col("accuracy") - base.select("accuracy").scalar()).alias("accuracy_change"),
        (F.col("under_triage_pct") - base.select("under_triage_pct").scalar())
        .alias("under_triage_change"),
    )


def ablation(results: DataFrame, raw: str, treated: str) -> DataFrame:
    """Effect of a treatment: the change and a verdict in words."""
    change = against_baseline(results, raw).filter(F.col("method") == treated)
    return change.withColumn(
        "verdict",
        F.when((F.col("accuracy_change") > 0) | (F.col("under_triage_change") < 0), "helped")
        .when(
            (F.col("accuracy_change") == 0) & (F.col("under_triage_change") == 0), "no change"
        )
        .otherwise("did not help"),
    )
