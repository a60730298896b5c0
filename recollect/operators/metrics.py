"""Ranking metrics over a score table with ``label`` (0/1) and ``score`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scalars as X
from recollect.operators.ordering import running_totals
from recollect.operators.staging import stage

# The threshold grid is -MARGIN, 1/199 .. 198/199, 1 + MARGIN.
N_THRESHOLDS = 200
MARGIN = 1e-7
SMOOTHING = 1e-6

_PAIRS = "decimal(38,0)"


def from_two_class(df: DataFrame, label: str = "label_0", score: str = "prob") -> DataFrame:
    """Plain label and score columns from two-class lists."""
    return df.withColumns({
        "label": X.positive_class(F.col(label)).cast("int"),
        "score": X.positive_class(F.col(score)).cast("double"),
    })


def _class_counts() -> tuple[Column, Column]:
    return (
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    )


def pair_wins(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: positives, negatives, pairs, and pairs whose positive scores strictly higher.

    Rows are first reduced to one per (group, score). Negatives below a score are a running
    sum over those, so pairs are counted without ever being formed. Pair counts are decimals:
    the product of two row counts may exceed 64 bits.
    """
    return wins_of_counts(scores.groupBy(*by, "score").agg(*_class_counts()), by)


def wins_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`pair_wins` of rows already reduced to (group, score, pos, neg)."""
    by = list(by)
    below = running_totals(counts, ["score"], {"neg_to_here": F.col("neg")}, by)
    won = F.col("pos").cast(_PAIRS) * (F.col("neg_to_here") - F.col("neg")).cast("decimal(20,0)")
    return below.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(won.cast(_PAIRS)).cast(_PAIRS).alias("wins"),
    ).select(
        *by, "p", "n", "wins",
        (F.col("p").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).cast(_PAIRS).alias("pairs"),
    )


def auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs ranked correctly; a tie earns nothing.

    A group with one class only has auc 1 and no wins.
    """
    return _share_won(pair_wins(scores, by), by)


def _share_won(wins: DataFrame, by: Sequence[str]) -> DataFrame:
    share = F.try_divide(F.col("wins").cast("double"), F.col("pairs").cast("double"))
    one_class = F.col("pairs") == 0
    return wins.select(
        *by, F.when(one_class, F.lit(1.0)).otherwise(share).alias("auc"), "p", "n", "wins"
    )


def gauc(scores: DataFrame, by: Sequence[str] = (), user: str = "uid") -> DataFrame:
    """AUC per user, weighted by the user's rows; users with one class are left out.

    Exact over all rows of a user. With ``by`` (a batch, say) users are taken within each group.
    """
    return _weigh_users(_share_won(pair_wins(scores, [*by, user]), [*by, user]), by)


def _weigh_users(users: DataFrame, by: Sequence[str]) -> DataFrame:
    users = users.where((F.col("p") > 0) & (F.col("n") > 0))
    weight = F.col("p") + F.col("n")
    return users.groupBy(*by).agg(
        F.sum(F.col("auc") * weight).alias("weighted_auc_sum"),
        F.sum(weight).alias("impressions"),
    ).select(
        *by,
        F.coalesce(F.try_divide("weighted_auc_sum", "impressions"), F.lit(0.0)).alias("gauc"),
        F.coalesce("weighted_auc_sum", F.lit(0.0)).alias("weighted_auc_sum"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
    )


def threshold(i: Column) -> Column:
    """i-th threshold of the grid."""
    last = N_THRESHOLDS - 1
    return (
        F.when(i == 0, F.lit(0.0 - MARGIN)).when(i == last, F.lit(1.0 + MARGIN))
        .otherwise(i / F.lit(float(last)))
    )


def thresholds_below(score: Column) -> Column:
    """Number of thresholds strictly below a score, 0 to 200.

    The grid is even, so the number is near score * 199; comparing with the neighbouring
    thresholds settles it exactly.
    """
    last = N_THRESHOLDS - 1
    s = score.cast("double")
    guess = F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * last).cast("int")
    inner = (
        F.when((guess + 1) / F.lit(float(last)) < s, guess + 1)
        .when(guess / F.lit(float(last)) < s, guess)
        .otherwise(guess - 1)
    )
    inner = F.least(F.greatest(inner, F.lit(0)), F.lit(last - 1))
    return (
        F.when(F.isnan(s) | ~(s > -MARGIN), F.lit(0))
        .when(s > 1.0 + MARGIN, F.lit(N_THRESHOLDS))
        .otherwise(inner + 1).cast("int")
    )


def bucket_counts(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(bucket, pos, neg): rows by the number of thresholds below their score."""
    return scores.withColumn("bucket", thresholds_below(F.col("score"))).groupBy(*by, "bucket").agg(
        *_class_counts()
    )


def confusion_from_buckets(buckets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn at each of the 200 thresholds, from at most 201 buckets per group."""
    by = list(by)
    ids = F.explode(F.sequence(F.lit(0), F.lit(N_THRESHOLDS))).alias("bucket")
    spark = buckets.sparkSession
    groups = buckets.select(*by).distinct() if by else spark.range(1).select()
    zero = F.lit(0).cast("bigint")
    blank = groups.select(*by, ids).select(*by, "bucket", zero.alias("pos"), zero.alias("neg"))
    full = buckets.select(*by, "bucket", "pos", "neg").unionByName(blank).groupBy(*by, "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # A window holds the 201 buckets of one group.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = full.select(
        *by, "bucket",
        F.sum("pos").over(upto).alias("fn"), F.sum("neg").over(upto).alias("tn"),
        F.sum("pos").over(group).alias("p"), F.sum("neg").over(group).alias("q"),
    ).where(F.col("bucket") < N_THRESHOLDS)
    return sums.select(
        *by, F.col("bucket").alias("threshold_no"), threshold(F.col("bucket")).alias("threshold"),
        (F.col("p") - F.col("fn")).alias("tp"), (F.col("q") - F.col("tn")).alias("fp"), "tn", "fn",
    )


def confusion(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at 200 thresholds; a row is predicted positive if score > threshold."""
    return confusion_from_buckets(bucket_counts(scores, by), by)


def curve_points(counts: DataFrame) -> DataFrame:
    """Add recall and false positive rate to confusion counts."""
    return counts.withColumns({
        "recall": (F.col("tp") + SMOOTHING) / (F.col("tp") + F.col("fn") + SMOOTHING),
        "fpr": F.col("fp") / (F.col("fp") + F.col("tn") + SMOOTHING),
    })


def area_under_curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the threshold curve of confusion counts, by the trapezoid rule."""
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy("threshold_no")
    steps = curve_points(counts).select(
        *by, "recall", "fpr",
        F.lead("recall").over(along).alias("next_recall"),
        F.lead("fpr").over(along).alias("next_fpr"),
    )
    area = (F.col("fpr") - F.col("next_fpr")) * ((F.col("recall") + F.col("next_recall")) / 2.0)
    return steps.groupBy(*by).agg(F.sum(area).alias("auroc"))


def auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return area_under_curve(confusion(scores, by), by)


def row_loss(label: Column, score: Column) -> Column:
    """Cross-entropy of one row after the probability floor and clipping."""
    p_true = F.when(label == 1, score).otherwise(1.0 - score)
    return -F.ln(X.clip01(p_true + F.lit(X.PROB_FLOOR)))


def logloss(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy over rows, per group if given."""
    return scores.groupBy(*by).agg(F.avg(row_loss(F.col("label"), F.col("score"))).alias("logloss"))


def batch_mean_loss(scores: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Mean of batch means; equals the row mean only for batches of one size."""
    return logloss(scores, [batch]).agg(F.avg("logloss").alias("logloss"))


def score_cube(scores: DataFrame, step: str = "batch_id", user: str = "uid") -> DataFrame:
    """(step, user, score, pos, neg, n): all that step metrics need to know of the rows, stored."""
    cube = scores.groupBy(step, user, "score").agg(*_class_counts(), F.count(F.lit(1)).alias("n"))
    return stage(cube, "cube")


def _merged(cube: DataFrame, by: Sequence[str]) -> DataFrame:
    return cube.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "n")])


def cube_steps(cube: DataFrame, step: str = "batch_id", user: str = "uid") -> tuple[DataFrame, DataFrame]:
    """Step metrics and bucket counts of a :func:`score_cube`, whose users are merged once."""
    tied = stage(_merged(cube, [step, "score"]), "tied")
    pairs = wins_of_counts(tied, [step]).select(step, "wins", "pairs")
    by_user = [step, user]
    users = _weigh_users(_share_won(wins_of_counts(cube, by_user), by_user), [step])
    # A row without a score has no loss.
    scored = tied.where(F.col("score").isNotNull())
    lost = F.col("pos") * row_loss(F.lit(1), F.col("score")) + (F.col("n") - F.col("pos")) * row_loss(
        F.lit(0), F.col("score")
    )
    loss = scored.groupBy(step).agg((F.sum(lost) / F.sum("n")).alias("loss"))
    table = pairs.join(loss, step, "left").join(users.select(step, "weighted_auc_sum", "impressions"), step, "left")
    steps = table.select(
        F.col(step).alias("step"), "wins", "pairs",
        F.coalesce("weighted_auc_sum", F.lit(0.0)).alias("weighted_auc_sum"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"), "loss",
    )
    buckets = tied.withColumn("bucket", thresholds_below(F.col("score"))).groupBy(step, "bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return steps, buckets


def step_metrics(scores: DataFrame, step: str = "batch_id") -> DataFrame:
    """One row per step: wins, pairs, per-user AUC sums and loss of that step alone."""
    return cube_steps(score_cube(scores, step), step)[0]


def running_curves(buckets: DataFrame, step: str = "batch_id") -> DataFrame:
    """(step, auroc): area under the curve of the counts accumulated up to each step."""
    counts = confusion_from_buckets(buckets, [step])
    names = ("tp", "fp", "tn", "fn")
    # Steps grow with the data: each threshold's running sum is cut over many tasks.
    totals = running_totals(counts, [step], {f"sum_{c}": F.col(c) for c in names}, ["threshold_no"]).select(
        step, "threshold_no", *[F.col(f"sum_{c}").alias(c) for c in names]
    )
    return area_under_curve(totals, [step]).withColumnRenamed(step, "step")


def accumulate(steps: DataFrame) -> DataFrame:
    """Metrics of each step and of all steps up to it.

    A step without pairs, or without users of both classes, has NULL for that step's value.
    """
    names = ("wins", "pairs", "weighted_auc_sum", "impressions", "loss")
    sums = {f"sum_{c}": F.col(c) for c in names}
    sums["n_steps"] = F.lit(1).cast("bigint")
    totals = running_totals(steps, ["step"], sums)

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    return totals.select(
        "step", *names,
        ratio("wins", "pairs").alias("cur_auc"),
        ratio("weighted_auc_sum", "impressions").alias("cur_gauc"),
        ratio("sum_wins", "sum_pairs").alias("pair_auc_so_far"),
        ratio("sum_weighted_auc_sum", "sum_impressions").alias("gauc_so_far"),
        (F.col("sum_loss") / F.col("n_steps")).alias("mean_loss"),
    )


def running_metrics(scores: DataFrame, step: str = "batch_id") -> DataFrame:
    """Step metrics with the accumulated threshold AUC, pair AUC, per-user AUC and mean loss."""
    steps, buckets = cube_steps(score_cube(scores, step), step)
    table, curves = accumulate(steps), running_curves(buckets, step)
    return table.join(curves.withColumnRenamed("auroc", "auroc_so_far"), "step")
