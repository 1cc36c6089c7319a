import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.functions import divergence
from rolloom.functions import tokens as tk
from rolloom.operators import advantage, groupwise


def one(df):
    return df.first()[0]


def gae_plain(r, v, m, gamma, lam):
    nv = last = 0.0
    out = []
    for a, b, k in zip(r[::-1], v[::-1], m[::-1], strict=True):
        fresh = a + gamma * nv - b + gamma * lam * last
        if k:
            nv, last = b, fresh
        out.append(last)
    return out[::-1]


MASK = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
REWARDS = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0]


@pytest.mark.parametrize("fill", [0.0, 3.5, -100.0])
def test_gae_ignores_masked_values(spark, fill):
    values = [fill, fill, 4.0, 5.0, 6.0, fill, fill, 7.0, 9.0, fill, fill]
    df = spark.createDataFrame([(0, [float(x) for x in REWARDS], values, MASK)], "row_id int, r array<double>, v array<double>, m array<int>")
    got = one(df.select(tk.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8)))
    want = gae_plain(REWARDS, [0, 0, 4, 5, 6, 0, 0, 7, 9, 0, 0], MASK, 0.9, 0.8)
    assert np.allclose([g for g, k in zip(got, MASK, strict=True) if k], [w for w, k in zip(want, MASK, strict=True) if k])


def test_masked_sums_neutralise_nan(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 2.0], [1, 0, 1])], "v array<double>, m array<int>")
    s, m = df.select(tk.masked_sum(F.col("v"), F.col("m")), tk.masked_mean(F.col("v"), F.col("m"))).first()
    assert s == 3.0 and math.isclose(m, 3 / (2 + 1e-8))


def test_array_shapes(spark):
    df = spark.createDataFrame([([1, 2, 9, 4], [0, 1, 1, 0])], "x array<int>, m array<int>")
    x, m = F.col("x"), F.col("m")
    row = df.select(
        tk.response_mask(x, [9]), tk.pad(x, 6, 0), tk.pad(x, 6, 0, left=True), tk.truncate(x, 2), tk.truncate(x, 2, "left"), tk.keep_where(x, m), tk.spread_where(tk.keep_where(x, m), m, 0), tk.spans(m), tk.at_last_valid(F.lit(5.0), m), tk.running_sum(F.transform(x, lambda v: v.cast("double"))), tk.tail_mask(m, F.lit(2))
    ).first()
    assert row[0] == [1, 1, 1, 0] and row[1] == [1, 2, 9, 4, 0, 0] and row[2] == [0, 0, 1, 2, 9, 4] and row[3] == [1, 2] and row[4] == [9, 4]
    assert row[5] == [2, 9] and row[6] == [0, 2, 9, 0] and [tuple(s) for s in row[7]] == [(1, 3)] and row[8] == [0.0, 5.0, 0.0, 0.0] and row[9] == [1, 3, 12, 16] and row[10] == [1, 0]


def test_empty_response_scores_at_its_end(spark):
    df = spark.createDataFrame([([0, 0, 0],)], "m array<int>")
    assert one(df.select(tk.at_last_valid(F.lit(2.0), F.col("m")))) == [0.0, 0.0, 2.0]


def test_divergences_are_bounded(spark):
    df = spark.createDataFrame([(0.0, -50.0), (-50.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(divergence.kl(F.col("a"), F.col("b"), "k3+")).collect()]
    assert got[1] == 10.0 and math.isclose(got[0], math.exp(-20) + 20 - 1 if False else 10.0)
    with pytest.raises(NotImplementedError):
        divergence.kl(F.col("a"), F.col("b"), "full")


GROUPS = [(0, "a", 1.0, 2), (1, "a", 3.0, 4), (2, "b", 5.0, 1), (3, "c", 2.0, 3), (4, "c", 2.0, 3)]


@pytest.fixture
def groups(spark):
    return spark.createDataFrame(GROUPS, "row_id long, uid string, score double, n int")


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("grpo", [-1 / (2**0.5 + 1e-6), 1 / (2**0.5 + 1e-6), 5 / (1 + 1e-6), 0, 0]),
        ("rloo", [-2, 2, 5, 0, 0]),
        ("rloo_vectorized", [-2, 2, 0, 0, 0]),
        ("opo", [1 - 14 / 6, 3 - 14 / 6, 5, 0, 0]),
        ("gpg", [-1, 1, 5, 0, 0]),
    ],
)
def test_outcome_estimators_with_singletons(groups, name, want):
    got = [r[0] for r in advantage.compute_advantage(groups, name).orderBy("row_id").select("advantage").collect()]
    assert np.allclose(got, want)


def test_best_of_k_needs_two(groups):
    with pytest.raises(Exception, match="two samples"):
        advantage.best_of_k(groups).collect()
    got = [r[0] for r in advantage.best_of_k(groups.where("uid <> 'b'"), by_std=False).orderBy("row_id").select("advantage").collect()]
    assert got == [0.0, 2.0, 0.0, 0.0]


def test_registry_refuses_a_second_function():
    with pytest.raises(ValueError):
        advantage.estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        advantage.get_estimator("none")


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v, m = rng.normal(size=200), (rng.random(200) < 0.7).astype(int)
    df = spark.createDataFrame([(i, float(x), int(k)) for i, (x, k) in enumerate(zip(v, m, strict=True))], "t int, x double, mask int")
    got = np.array([r[0] for r in groupwise.whiten(df, "x").orderBy("t").select("x").collect()])
    mean = (v * m).sum() / (m.sum() + 1e-8)
    var = ((v - mean) ** 2 * m).sum() / (m.sum() + 1e-8) * m.sum() / (m.sum() - 1)
    assert np.allclose(got, (v - mean) / np.sqrt(var + 1e-8))


def test_adaptive_coefficient():
    c = advantage.AdaptiveCoefficient(0.1, 6.0, 10000)
    c.update(12.0, 100)
    assert math.isclose(c.value, 0.1 * (1 + 0.2 * 100 / 10000))


def test_resampling_follows_weights(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "row_id long, score double")
    got = advantage.resample(df, seed=1).select("row_id", "draw").collect()
    assert len(got) == 400 and len({r.draw for r in got}) == 400 and all(r.row_id % 2 for r in got)


def test_whitening_of_large_means(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=300) + 1e9
    n = rng.integers(1, 5, 300)
    df = spark.createDataFrame([(i, float(x), int(k), [float(x)] * int(k), [1] * int(k)) for i, (x, k) in enumerate(zip(v, n, strict=True))], "i int, advantage double, n int, a array<double>, response_mask array<int>")
    c = n.sum()
    mean = (v * n).sum() / (c + 1e-8)
    want = (v - mean) / np.sqrt(((v - mean) ** 2 * n).sum() / (c + 1e-8) * c / (c - 1))
    got = np.array([r[0] for r in advantage.whiten_samples(df).orderBy("i").select("advantage").collect()])
    assert np.allclose(got, want, atol=1e-3)
    arrays = np.array([r[0] for r in advantage.whiten_arrays(df, "a").orderBy("i").select(F.get("a", F.lit(0))).collect()])
    assert np.allclose(arrays, want, atol=1e-3)


def test_variance_of_a_row(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, float("nan")], [1, 1, 1, 0]), ([5.0], [0])], "v array<double>, m array<int>")
    some = df.where("size(v) = 4")
    assert some.select(tk.masked_var(F.col("v"), F.col("m")).alias("x")).first().x == pytest.approx(np.var([1, 2, 4], ddof=1))
    assert some.select(tk.masked_var(F.col("v"), F.col("m"), unbiased=False).alias("x")).first().x == pytest.approx(np.var([1, 2, 4]))
    with pytest.raises(Exception, match="variance needs two"):
        df.select(tk.masked_var(F.col("v"), F.col("m")).alias("x")).collect()


def test_resampling_of_a_heavy_row(spark):
    df = spark.createDataFrame([(i, 100.0 if i == 7 else 1.0) for i in range(1000)], "row_id long, score double")
    got = [r.row_id for r in advantage.resample(df, seed=4).select("row_id").collect()]
    assert len(got) == 1000 and 880 < got.count(7) < 940
    assert advantage.resample(df.where("false")).count() == 0
