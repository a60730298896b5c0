import math
from itertools import product

import numpy as np
import pytest

from recollect.operators import metrics as M

SCHEMA = "uid bigint, label int, score double, batch_id bigint"


def grid():
    n = 200
    return [-1e-7] + [(i + 1) * 1.0 / (n - 1) for i in range(n - 2)] + [1 + 1e-7]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(400):
        user = 1 if i % 3 == 0 else int(rng.integers(2, 30))
        score = float(rng.choice([rng.random(), rng.integers(0, 200) / 199, 0.5, 0.0, 1.0]))
        out.append((user, int(rng.random() < 0.3), score, i % 5))
    return out + [(900, 1, 0.2, 6), (900, 1, 0.4, 6)]


@pytest.fixture(scope="module")
def scores(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def wins(rows):
    pos, neg = ([r[2] for r in rows if r[1] == c] for c in (1, 0))
    return sum(p > n for p, n in product(pos, neg)), len(pos), len(neg)


def by(rows, *places):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[p] for p in places), []).append(r)
    return groups


def user_auc(rows):
    total = weight = 0
    for group in by(rows, 0).values():
        w, p, n = wins(group)
        if p and n:
            total += w / (p * n) * (p + n)
            weight += p + n
    return total, weight


def test_auc_counts_strictly_ordered_pairs(scores, rows):
    w, p, n = wins(rows)
    row = M.auc(scores).first()
    assert (row.wins, row.p, row.n, row.auc) == (w, p, n, pytest.approx(w / (p * n)))
    grouped = {r.batch_id: r for r in M.auc(scores, ["batch_id"]).collect()}
    assert (grouped[6].auc, grouped[6].wins) == (1.0, 0)
    for (batch,), group in by(rows, 3).items():
        assert grouped[batch].wins == wins(group)[0]


def test_pair_counts_beyond_64_bits(spark):
    huge = 4 * 10**9
    df = spark.createDataFrame([(0.1, 0, huge), (0.9, huge, 0)], "score double, pos bigint, neg bigint")
    row = df.selectExpr("sum(cast(pos as decimal(38,0)) * cast(4000000000 as decimal(20,0))) w").first()
    assert row.w == huge * huge
    assert dict(M.auc(spark.createDataFrame([(1, 1, 0.5, 0)], SCHEMA)).dtypes)["wins"] == "decimal(38,0)"


def test_gauc_skips_users_of_one_class(spark, scores, rows):
    total, weight = user_auc(rows)
    row = M.gauc(scores).first()
    assert (row.gauc, row.impressions) == (pytest.approx(total / weight), weight)
    grouped = {r.batch_id: r for r in M.gauc(scores, ["batch_id"]).collect()}
    for (batch,), group in by(rows, 3).items():
        total, weight = user_auc(group)
        if weight:
            assert grouped[batch].gauc == pytest.approx(total / weight)
    none = M.gauc(spark.createDataFrame([(1, 1, 0.5, 0), (2, 0, 0.5, 0)], SCHEMA)).first()
    assert (none.gauc, none.impressions) == (0.0, 0)


def test_threshold_buckets_are_exact(spark):
    edges = grid()
    points = edges + [np.nextafter(t, 9) for t in edges] + [np.nextafter(t, -9) for t in edges] + [-5.0, 5.0, float("nan")]
    points = [float(p) for p in points]
    df = spark.createDataFrame([(p,) for p in points], "score double")
    got = [r.b for r in df.select("score", M.thresholds_below(df.score).alias("b")).collect()]
    assert got == [sum(p > t for t in edges) for p in points]


def test_confusion_and_area(scores, rows):
    got = {r.threshold_no: r for r in M.confusion(scores).collect()}
    assert len(got) == 200
    x, y = [], []
    for i, t in enumerate(grid()):
        tp = sum(r[1] == 1 and r[2] > t for r in rows)
        fp = sum(r[1] == 0 and r[2] > t for r in rows)
        p = sum(r[1] for r in rows)
        n = len(rows) - p
        assert (got[i].tp, got[i].fp, got[i].fn, got[i].tn) == (tp, fp, p - tp, n - fp)
        assert got[i].threshold == pytest.approx(t, abs=1e-12)
        x.append(fp / (n + 1e-6))
        y.append((tp + 1e-6) / (p + 1e-6))
    area = sum((x[i] - x[i + 1]) * (y[i] + y[i + 1]) / 2 for i in range(199))
    assert M.auroc(scores).first().auroc == pytest.approx(area)


def loss(r):
    return -math.log(min(max((r[2] if r[1] else 1 - r[2]) + 1e-7, 0), 1))


def test_logloss(scores, rows):
    assert M.logloss(scores).first().logloss == pytest.approx(np.mean([loss(r) for r in rows]))
    means = [np.mean([loss(r) for r in g]) for g in by(rows, 3).values()]
    assert M.batch_mean_loss(scores).first().logloss == pytest.approx(np.mean(means))


def test_running_metrics(spark, scores, rows):
    got = M.running_metrics(scores).orderBy("step").collect()
    groups = sorted(by(rows, 3).items())
    assert [r.step for r in got] == [k[0] for k, _ in groups]
    w = pn = total = weight = 0
    losses, seen = [], []
    for r, (_, group) in zip(got, groups):
        step_w, p, n = wins(group)
        step_total, step_weight = user_auc(group)
        w, pn, total, weight = w + step_w, pn + p * n, total + step_total, weight + step_weight
        losses.append(np.mean([loss(x) for x in group]))
        seen += group
        assert r.cur_auc == (pytest.approx(step_w / (p * n)) if p * n else None)
        assert r.cur_gauc == (pytest.approx(step_total / step_weight) if step_weight else None)
        assert r.pair_auc_so_far == pytest.approx(w / pn)
        assert r.gauc_so_far == pytest.approx(total / weight)
        assert r.mean_loss == pytest.approx(np.mean(losses))
        so_far = spark.createDataFrame(seen, SCHEMA)
        if r.step in (0, 6):
            assert r.auroc_so_far == pytest.approx(M.auroc(so_far).first().auroc)


def test_two_class_lists(spark):
    df = spark.createDataFrame([([0, 1], [0.3, 0.7])], "label_0 array<tinyint>, prob array<double>")
    row = M.from_two_class(df).first()
    assert (row.label, row.score) == (1, 0.7)
