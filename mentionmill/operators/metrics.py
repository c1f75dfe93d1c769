"""Votes, binary-classification metrics, sweeps and reports; one aggregation pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(num, den) -> Column:
    """num / den, null where den is 0."""
    num, den = (F.col(x) if isinstance(x, str) else x for x in (num, den))
    return F.try_divide(num.cast("double"), den.cast("double"))


def normalise_answer(answer: str | Column) -> Column:
    """yes, no, or null for anything else."""
    a = F.lower(F.trim(F.col(answer) if isinstance(answer, str) else answer))
    return F.when(a.isin("yes", "no"), a)


def vote_counts(answers: DataFrame, keys: list[str], answer: str = "answer", label: str | None = None) -> DataFrame:
    """``yes, valid, repeat`` of repeated sampling, and ``correct`` where a label is given."""
    a = normalise_answer(answer)
    aggs = [F.count_if(a == "yes").alias("yes"), F.count_if(a.isNotNull()).alias("valid"), F.count(F.lit(1)).alias("repeat")]
    if label:
        aggs.append(F.count_if(((a == "yes") & (F.col(label) == 1)) | ((a == "no") & (F.col(label) == 0))).alias("correct"))
    return answers.groupBy(*keys).agg(*aggs)


def correct_share_to_class(label: str, correct, valid, tie: str = "correct") -> Column:
    """Predicted class from the share of correct answers; ``tie`` says what exactly half counts as. Null without a valid answer."""
    p = ratio(correct, valid)
    right = (p >= 0.5) if tie == "correct" else (p > 0.5)
    return F.when(p.isNull(), None).when(right, F.col(label)).otherwise(1 - F.col(label)).cast("int")


def yes_share_to_class(yes, valid, threshold: float = 0.5) -> Column:
    """Predicted class from the share of yes answers; without a valid answer 0."""
    return F.coalesce(ratio(yes, valid) >= threshold, F.lit(False)).cast("int")


def yes_to_correct(label: str, yes: str, valid: str) -> Column:
    """Correct count of the second encoding from the yes count of the first."""
    return F.when(F.col(label) == 1, F.col(yes)).otherwise(F.col(valid) - F.col(yes))


def majority(columns: list[str]) -> Column:
    """Most frequent 0/1 of several columns, nulls left out; a tie is 0."""
    some = F.filter(F.array(*columns), lambda x: x.isNotNull())
    ones = F.size(F.filter(some, lambda x: x == 1))
    return F.when(F.size(some) > 0, (ones * 2 > F.size(some)).cast("int"))


def mean_of(columns: list[str]) -> Column:
    """Mean of several columns, nulls left out; null when all are."""
    some = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some))


def confusion(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if(y.isNull() | p.isNull()).alias("n_invalid"),
    ]


def with_scores(counts: DataFrame) -> DataFrame:
    """acc, precision, recall, f1 (0 without a positive) and auc on hard labels (null where a class is absent)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        counts.withColumn("acc", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", zero(ratio(tp, tp + fp)))
        .withColumn("recall", zero(tpr)).withColumn("f1", zero(ratio(2 * tp, 2 * tp + fp + fn))).withColumn("auc", (tpr + tnr) / 2)
    )


def binary_metrics(rows: DataFrame, by: list[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion counts and scores for each group; rows with a null label or prediction only count as invalid."""
    return with_scores(rows.groupBy(*by).agg(*confusion(label, pred)))


def valid_share(rows: DataFrame, by: list[str] = (), valid: str = "valid", repeat: str = "repeat") -> DataFrame:
    """Share of valid answers, -1 where there are none to count."""
    return rows.groupBy(*by).agg(F.coalesce(ratio(F.sum(valid), F.sum(repeat)), F.lit(-1.0)).alias("valid_share"))


def cell(label: str = "label", pred: str = "pred") -> Column:
    """TP, FP, TN or FN."""
    right = F.when(F.col(label) == F.col(pred), "T").otherwise("F")
    return F.when(F.col(label).isNotNull() & F.col(pred).isNotNull(), F.concat(right, F.when(F.col(pred) == 1, "P").otherwise("N")))


def threshold_sweep(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Errors at every distinct score as threshold (``score >= threshold`` is positive): ``threshold, fp, fn, errors``.

    Rows are first summed per distinct score; running sums are then dealt by ranges of the score.
    """
    from .filters import running_sums

    per = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    run = running_sums(per, F.col("threshold").desc(), ["pos", "neg"])
    whole = scored.where(F.col(score).isNotNull()).agg(F.count_if(F.col(label) == 1).alias("all_pos"))
    got = run.crossJoin(whole)  # one row
    fp, fn = F.col("neg"), F.col("all_pos") - F.col("pos")
    return got.select("threshold", fp.alias("fp"), fn.alias("fn"), (fp + fn).alias("errors"))


def best_threshold(sweep: DataFrame, positive_only: bool = True) -> DataFrame:
    """Threshold with the fewest errors; the largest one among equals."""
    rows = sweep.where("threshold > 0") if positive_only else sweep
    return rows.agg(
        F.max_by("threshold", F.struct(-F.col("errors"), F.col("threshold"))).alias("threshold"), F.min("errors").alias("errors")
    )


def distribution(rows: DataFrame, value: str, label: str, bins: int = 20) -> DataFrame:
    """Counts of a 0..1 value in equal bins, for each label."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("label"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def similarity_bin(sim: str | Column) -> Column:
    """Ten-wide bins centred on multiples of ten, half-open above."""
    return F.floor(((F.col(sim) if isinstance(sim, str) else sim) + 5) / 10).cast("int")


def type_matrix(pairs: DataFrame, types: list[str], one: str, two: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion of the pairs in which the first mention has type A or the second type B, for every A and B.

    By inclusion and exclusion from one grouping by both types, so a pair is
    counted once and not for each of the types' squares.
    """
    base = pairs.groupBy(F.col(one).alias("t1"), F.col(two).alias("t2")).agg(*confusion(label, pred)[:4])
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in types for b in types], "type_1 string, type_2 string")
    hit = F.coalesce(F.col("t1") == F.col("type_1"), F.lit(False)) | F.coalesce(F.col("t2") == F.col("type_2"), F.lit(False))
    sums = [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")]
    return with_scores(F.broadcast(grid).crossJoin(base).groupBy("type_1", "type_2").agg(*sums))  # both sides: squares of the type list


def pivot_report(scores: DataFrame, rows: list[str], setting: str, settings: list[str], value: Column, empty: str = "-") -> DataFrame:
    """One row for each template, one column for each setting, cells as text."""
    wide = scores.withColumn("_v", value).groupBy(*rows).pivot(setting, settings).agg(F.first("_v"))
    return wide.fillna(empty, settings)


def f1_text(f1: str = "f1", valid: str | None = None) -> Column:
    """``0.1234`` or ``0.1234 (99.9%)``."""
    text = F.format_string("%.4f", F.col(f1))
    return F.concat(text, F.format_string(" (%.1f%%)", F.col(valid) * 100)) if valid else text
