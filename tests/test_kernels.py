import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidalframe.functions import indicators as I
from tidalframe.functions import metrics as M
from tidalframe.operators import detectors as D
from tidalframe.operators import features as T
from tidalframe.operators import forecast as P
from tidalframe.operators import kernels as K
from tidalframe.operators import series as S

#: Monthly airline passengers, 1949 to 1960, in thousands.
AIR = [
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140, 145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166,
    171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194, 196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306, 315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336,
    340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337, 360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432,
]


@pytest.fixture(scope="module")
def air(spark):
    d = pd.DataFrame({"ts": pd.date_range("1949-01-01", periods=144, freq="MS"), "value": np.array(AIR, float)})
    return spark.createDataFrame(d).select(F.lit("air").alias("series_id"), "ts", "value")


def test_known_features(air):
    want = dict(
        length=144, mean=280.298611, var=14291.973331, lumpiness=3041164.562906, stability=12303.627267, flat_spots=2, hurst=-0.080233, std1st_der=27.206288, crossing_points=7, binarize_mean=0.444444,
        unitroot_kpss=0.128475, histogram_mode=155.8, linearity=0.853638, level_shift_idx=118, level_shift_size=15.6, y_acf1=0.948047, y_acf5=3.392072, seas_acf1=0.662904,
    )
    got = T.features(air).collect()[0]
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-6), k
    k = D.structure_features(air).collect()[0]
    for name, v in dict(entropy=0.428737, heterogeneity=126.064506, y_pacf5=1.003288, seas_pacf1=0.15617, firstmin_ac=8, firstzero_ac=52).items():
        assert k[name] == pytest.approx(v, abs=1e-6), name


def test_fused_groups_equal_single_ones(spark):
    d = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=60), "value": np.random.default_rng(0).normal(size=60).round(2)})
    s = spark.createDataFrame(d).select(F.lit("a").alias("series_id"), "ts", "value")
    s = s.unionByName(s.limit(8).withColumn("series_id", F.lit("short"))).unionByName(s.limit(3).withColumn("series_id", F.lit("tiny")))
    one = {r.series_id: r.asDict() for r in T.fused(s).collect()}
    assert sorted(one) == ["a", "short"]
    for g in T.FUSED:
        for r in T.GROUPS[g](s).collect():
            for k, v in r.asDict().items():
                got = one[r.series_id][k]
                assert got == v or got == pytest.approx(v, rel=1e-9, abs=1e-12), (g, k)


def test_selection_rules(air):
    with pytest.raises(ValueError):
        T.features(air, ("basic", "nothing"))
    with pytest.raises(ValueError):
        T.features(air, ("basic",), ("basic",))


def test_order_and_partitions_do_not_matter(air):
    many = air.unionByName(air.withColumn("series_id", F.lit("twin")).withColumn("value", F.col("value") * 2)).orderBy(F.rand(3)).repartition(7)
    a = T.features(air).collect()[0].asDict()
    b = {r.series_id: r.asDict() for r in T.features(many).collect()}["air"]
    for k in a:
        assert a[k] == b[k] or a[k] == pytest.approx(b[k], rel=1e-9)


def test_special_functions():
    assert K.chi2_sf(5, 2) == pytest.approx(math.exp(-2.5))
    assert K.t_sf(1, 1) == pytest.approx(0.25) and K.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert K.chi2_ppf(0.95, 3) == pytest.approx(7.814727903, abs=1e-8) and K.beta_ppf(0.5, 1, 1) == pytest.approx(0.5)
    assert K.clopper_pearson(0, 10, 0.05)[0] == 0.0 and K.clopper_pearson(10, 10, 0.05)[1] == 1.0


def test_run_probability_by_counting():
    for n in range(1, 12):
        for m in range(1, n + 1):
            hit = sum("1" * m in format(i, f"0{n}b") for i in range(2**n))
            assert K.run_probability(0.5, n, m) == pytest.approx(hit / 2**n)


def test_level_shift_is_found():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(1, 0.2, 30), rng.normal(1.5, 0.2, 30)])
    r = K.cusum(x)
    assert r["detected"] and abs(r["index"] - 29) <= 2 and not K.cusum(x, increase=False)["detected"]
    assert abs(int(K.bocpd(x, aggregate=False).argmax()) - 30) <= 2
    assert abs(K.multi_cusum(np.column_stack([x, x[::-1] * 0 + x]))["index"] - 29) <= 2


def test_mann_kendall_by_definition():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 15).astype(float)
    s = sum(np.sign(x[j] - x[i]) for i in range(15) for j in range(i + 1, 15))
    assert K.mann_kendall(x)["tau"] == pytest.approx(s / 105)
    assert K.mann_kendall(np.arange(20.0))["trend"] == "increasing"


def test_decompositions_add_up():
    y = np.array(AIR, float)
    for parts in (K.stl(y, 12), K.classical(y, 12)):
        assert np.allclose(sum(parts), y)
    assert K.stl(y, 12)[2].std() < 12 and np.allclose(np.prod(K.classical(y, 12, True), axis=0), y)


def test_dtw_and_its_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=12), rng.normal(size=12)
        full = np.full((13, 13), np.inf)
        full[0, 0] = 0
        for i in range(1, 13):
            for j in range(max(1, i - 3), min(12, i + 3) + 1):
                full[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(full[i - 1, j], full[i, j - 1], full[i - 1, j - 1])
        assert K.dtw(a, b, 3) == pytest.approx(math.sqrt(full[12, 12])) and K.lb_keogh(a, b, 3) <= K.dtw(a, b, 3) + 1e-9


def test_seasons_are_found():
    x = np.sin(np.arange(300) * 2 * np.pi / 12) + np.random.default_rng(0).normal(0, 0.1, 300)
    assert K.fft_seasonality(x) == [12.0] and 12 in K.acf_seasonality(x)


def test_forecasts_of_simple_shapes():
    line = np.arange(40) * 2.0 + 5
    for name in ("linear", "quadratic", "holt_winters", "arima"):
        assert np.allclose(P.MODELS[name](line, 3, period=0)[0], [85, 87, 89], atol=0.7), name
    wave = 10 + np.sin(np.arange(84) * 2 * np.pi / 7)
    for name in ("harmonic", "stlf", "sarima", "autoregression"):
        assert np.allclose(P.MODELS[name](wave, 7, period=7)[0], 10 + np.sin(np.arange(84, 91) * 2 * np.pi / 7), atol=0.25), name


def test_linear_interval_matches_the_kernel(air):
    a = P.linear(air, 5).orderBy("step").toPandas()
    f, lo, hi = P.MODELS["linear"](np.array(AIR, float), 5)
    assert np.allclose(a.fcst, f) and np.allclose(a.fcst_lower, lo, rtol=1e-4) and np.allclose(a.fcst_upper, hi, rtol=1e-4)


def test_reconciled_levels_add_up():
    rng = np.random.default_rng(2)
    f = {k: rng.normal(10 * k, 1, 8 // k) for k in (1, 2, 4)}
    assert np.allclose(K.reconcile([1, 2, 4], 8, {k: v for k, v in f.items()}, "bu"), f[1])
    ok = {k: np.full(8 // k, 3.0 * k) for k in (1, 2, 4)}
    for m in ("struc", "median", "bu"):
        assert np.allclose(K.reconcile([1, 2, 4], 8, ok, m), 3.0)


def test_covariance_reconciliation_is_coherent():
    rng = np.random.default_rng(3)
    f = {k: rng.normal(10 * k, 1, 4 // k) for k in (1, 2, 4)}
    e = {k: rng.normal(0, k, (40, 4 // k)) for k in (1, 2, 4)}
    for m in ("svar", "hvar", "mint_sample", "mint_shrink"):
        b = K.reconcile([1, 2, 4], 4, f, m, e)
        assert b.shape == (4,) and abs(b.sum() - 40) < 8
    s = K.summing_matrix([1, 2, 4], 4)
    ok = {1: np.arange(4.0), 2: np.array([1.0, 5.0]), 4: np.array([6.0])}
    assert np.allclose(K.reconcile([1, 2, 4], 4, ok, "mint_shrink", e), np.arange(4.0)) and np.allclose(s @ np.arange(4.0), np.concatenate(list(ok.values())))
    assert K.inconsistent_levels([1, 2, 4], 4, {1: np.ones(4), 2: np.full(2, 2.02), 4: np.array([90.0])}) == [4]
    assert K.fold_offsets(10, 20, 3) == [10, 14, 17]


def test_indicators_against_pandas(air):
    y = pd.Series(AIR, dtype=float)
    e = I.ewm_frame(air, {"a": 5, "b": 40}).orderBy("ts").toPandas()
    assert np.allclose(e.a, y.ewm(span=5).mean()) and np.allclose(e.b, y.ewm(span=40).mean())
    arrays = S.to_arrays(air)
    m = I.exploded(arrays, I.macd_arrays(F.col("values"))).orderBy("ts").toPandas()
    want = y.ewm(span=12).mean() - y.ewm(span=21).mean()
    assert np.allclose(m.macd[19:], want[19:]) and m.macd[:19].isna().all()
    d = y.diff().fillna(0)
    rs = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() / (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    r = I.exploded(arrays, {"rsi": I.rsi_array(F.col("values"), 14)}).orderBy("ts").toPandas()
    assert np.allclose(r.rsi[5:], (100 - 100 / (1 + rs))[5:])


def test_long_ewm_is_stable(spark):
    n = 5000
    x = np.random.default_rng(0).normal(size=n)
    d = spark.createDataFrame(pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "value": x}))
    e = I.ewm_frame(d, {"a": 3, "b": 900}).orderBy("ts").toPandas()
    assert np.allclose(e.a, pd.Series(x).ewm(span=3).mean()) and np.allclose(e.b, pd.Series(x).ewm(span=900).mean())


def test_metric_values(spark):
    d = spark.createDataFrame([("s", 1.0, 4.0, 2.0), ("s", 2.0, 4.0, 1.0), ("s", 4.0, 2.0, 3.0)], "series_id string, y double, fcst double, w double")
    c = {k: F.col(k) for k in ("y", "fcst", "w")}
    assert [r[0] for r in d.select(M.error(c["y"], c["fcst"])).collect()] == [-3, -2, 2]
    assert [r[0] for r in d.select(M.safe_divide(c["y"], c["fcst"])).collect()] == [0.25, 0.5, 2]
    r = d.agg(M.mean_absolute_error(c["y"], c["fcst"]).alias("a"), M.mean_absolute_error(c["y"], c["fcst"], c["w"]).alias("b"), M.metric("smape")(c["y"], c["fcst"]).alias("c")).first()
    assert r.a == pytest.approx(7 / 3) and r.b == pytest.approx(14 / 6) and r.c == pytest.approx(2 * (3 / 5 + 2 / 6 + 2 / 6) / 3)
    assert M.inspect("mae")["better"] == "lower" and M.inspect("bias")["better"] == "zero"
    with pytest.raises(ValueError):
        M.metric("r3")


def test_bad_frames_are_refused(spark):
    with pytest.raises(ValueError):
        S.from_frame(spark.createDataFrame([("2020-01-01", "x")], "time string, value string"))
    with pytest.raises(ValueError):
        S.rename_by_prefix(spark.createDataFrame([(1, 2)], "a1 int, a2 int"), {"a": "b"})
    nan = S.from_frame(spark.createDataFrame([("2020-01-01", float("nan")), ("2020-01-02", 1.0)], "time string, value double"))
    assert {r.value for r in nan.collect()} == {None, 1.0}


def test_monthly_steps_are_regular(air):
    assert S.is_missing(air).first().missing is False
    assert S.is_missing(air.where("ts <> '1950-03-01'")).first().missing is True
