import math

import numpy as np
import pytest

from millrace import dual_track_loss, kl_divergence_from_logits, masked_weighted_kl

K = 0.6901289731433179  # KL of token 0
SCHEMA = "batch_id long, pos int, student array<double>, teacher array<double>, mask double, w double"


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(0, 0, [0.0, 0.0], [4.0, -4.0], 1.0, 2.0), (0, 1, [0.0, 0.0], [0.0, 0.0], 0.5, 3.0)], SCHEMA)


def value(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][-1]


def one(spark, student, teacher, mask=1.0):
    return spark.createDataFrame([(0, 0, student, teacher, mask, 1.0)], SCHEMA)


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_kl_of_random_logits(spark, engine):
    rng = np.random.default_rng(0)
    s, t = rng.normal(size=(2, 6, 5))
    df = spark.createDataFrame([(i // 3, i % 3, s[i].tolist(), t[i].tolist(), 1.0, 1.0) for i in range(6)], SCHEMA)
    got = {(r.batch_id, r.pos): r.kl for r in kl_divergence_from_logits(df, engine=engine, temperature=1.5).collect()}
    assert len(got) == 6
    for i in range(6):
        a, b = s[i] / 1.5, t[i] / 1.5
        a, b = a - np.log(np.exp(a).sum()), b - np.log(np.exp(b).sum())
        assert got[i // 3, i % 3] == pytest.approx((np.exp(b) * (b - a)).sum() * 2.25, rel=1e-12)
        assert got[i // 3, i % 3] >= -1e-6


@pytest.mark.parametrize("engine", ["native", "arrow"])
def test_kl_reductions_and_temperature(pair, engine):
    rows = {r.pos: r.kl for r in kl_divergence_from_logits(pair, temperature=2.0, engine=engine).collect()}
    assert rows[0] == pytest.approx(2.412209651175077)
    assert rows[1] == pytest.approx(0.0, abs=1e-12)
    assert value(kl_divergence_from_logits(pair, reduction="mean", engine=engine)) == pytest.approx(K / 2)
    assert value(kl_divergence_from_logits(pair, reduction="sum", engine=engine)) == pytest.approx(K)


def test_kl_of_no_tokens(pair):
    none = pair.where("false")
    assert math.isnan(value(kl_divergence_from_logits(none, reduction="mean")))
    assert value(kl_divergence_from_logits(none, reduction="sum")) == 0
    assert math.isnan(value(masked_weighted_kl(none, normalize_weights=False)))
    assert value(masked_weighted_kl(none)) == 0


def test_kl_invariants(spark):
    same = one(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    assert value(kl_divergence_from_logits(same, reduction="sum")) == pytest.approx(0, abs=1e-15)
    shifted = one(spark, [101.0, 102.0, 103.5], [-9.0, -7.0, -8.0])
    plain = one(spark, [1.0, 2.0, 3.5], [1.0, 3.0, 2.0])
    assert value(kl_divergence_from_logits(shifted, reduction="sum")) == pytest.approx(value(kl_divergence_from_logits(plain, reduction="sum")))


def test_infinite_logits(spark):
    inf = float("inf")
    assert value(kl_divergence_from_logits(one(spark, [0.0, -inf], [0.0, 0.0]), reduction="sum")) == inf
    assert math.isnan(value(kl_divergence_from_logits(one(spark, [0.0, 0.0], [0.0, -inf]), reduction="sum")))
    # a masked token still poisons the loss
    assert math.isnan(value(masked_weighted_kl(one(spark, [0.0, 0.0], [0.0, -inf], mask=0.0), mask="mask")))


def test_masked_weighted(pair):
    assert value(masked_weighted_kl(pair, mask="mask", weights="w")) == pytest.approx(2 * K / 3.5)
    assert value(masked_weighted_kl(pair, mask="mask", weights="w", normalize_weights=False)) == pytest.approx(2 * K / 1.5)
    assert value(masked_weighted_kl(pair, weights="w", normalize_weights=False)) == pytest.approx(K)
    zero = pair.selectExpr("batch_id", "pos", "student", "teacher", "0.0D as mask")
    assert value(masked_weighted_kl(zero, mask="mask")) == 0
    boolean = pair.selectExpr("batch_id", "pos", "student", "teacher", "pos = 0 as mask")
    assert value(masked_weighted_kl(boolean, mask="mask")) == pytest.approx(K)


def test_dual_track_squares_the_mask(pair):
    assert value(dual_track_loss(pair, text_weights="w", mask="mask")) == pytest.approx(2 * K / 2.75)
    assert value(dual_track_loss(pair, mask="mask", alpha_text=7.0)) == pytest.approx(K / 1.5)
    assert value(dual_track_loss(pair, text_weights="w", alpha_text=0.0)) == 0
    both = dual_track_loss(pair, text_weights="w", vision_weights="w", alpha_vision=3.0)
    assert value(both) == pytest.approx(value(dual_track_loss(pair, text_weights="w")))


def test_groups(spark, pair):
    more = pair.union(pair.selectExpr("batch_id + 1", "pos", "teacher", "teacher", "mask", "w"))
    got = {r.batch_id: r.loss for r in masked_weighted_kl(more, mask="mask", weights="w", group_cols=["batch_id"]).collect()}
    assert got == pytest.approx({0: 2 * K / 3.5, 1: 0.0}, abs=1e-12)


def test_checks(spark, pair):
    with pytest.raises(ValueError, match="temperature must be positive"):
        kl_divergence_from_logits(pair, temperature=0)
    with pytest.raises(ValueError, match="reduction must be one of"):
        kl_divergence_from_logits(pair, reduction="median")
    with pytest.raises(ValueError, match="batch, seq, vocab"):
        kl_divergence_from_logits(pair, "pos", "teacher")
    with pytest.raises(ValueError, match="no such columns"):
        masked_weighted_kl(pair, mask="nowhere")
    for s, t in (([1.0] * 5, [1.0] * 4), ([], []), (None, [1.0])):
        with pytest.raises(Exception, match="same shape"):
            kl_divergence_from_logits(one(spark, s, t)).collect()
    with pytest.raises(Exception, match="mask is null"):
        masked_weighted_kl(one(spark, [1.0], [1.0], mask=None), mask="mask").collect()


def test_plan_has_one_exchange_and_no_python(pair):
    plan = dual_track_loss(pair, text_weights="w", mask="mask")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1 and "Join" not in plan
