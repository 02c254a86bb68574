"""Operators over small lanes against brute force, so that every lane border is crossed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelane.operators.augment import add_noise, jitter, resample_cubic, resample_linear, rotate
from kinelane.operators.frames import integrate, moving_average, rolling, running_sum
from kinelane.operators.lanes import LANE, Lanes, number_rows, running_before, sample_slots
from kinelane.operators.savgol import savgol, savgol_nearest
from kinelane.operators.wide import frame_sums
from kinelane.operators.windows import concatenate, segment_rows, sequence_targets, sliding_windows
from series import by_series, frame, savgol as savgol_brute, shapes, spline

SMALL = Lanes(rows=16)


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark).cache()


def test_numbering_with_many_slots(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"series_id": rng.choice(["a", "b"], 900, p=[0.9, 0.1]), "t": rng.integers(0, 60, 900), "id": np.arange(900)})
    out = number_rows(spark.createDataFrame(rows), ["t", "id"], slot_rows=50).toPandas().sort_values(["series_id", "t", "id"])
    for _, g in out.groupby("series_id"):
        assert g.seq.tolist() == list(range(len(g)))
        assert set(g.n) == {len(g)}


def test_numbering_of_one_moment_and_missing_times(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5.0, 2), ("a", 5.0, 3), ("b", None, 4)], "series_id string, t double, id int")
    out = {r.id: r.seq for r in number_rows(rows, ["t", "id"], slot_rows=1).collect()}
    assert out == {1: 0, 2: 1, 3: 2, 4: 0}


@pytest.mark.parametrize("case", ["stray", "instant", "skewed", "nulls"])
def test_slots_are_bounded_whatever_the_times(spark, case):
    """One stray time, half of the rows at one instant, times crowded at one end, missing and NaN times."""
    rng = np.random.default_rng(4)
    t = rng.normal(size=3000)
    if case == "stray":
        t[17] = 1e15
    elif case == "instant":
        t[rng.permutation(3000)[:1500]] = 0.25
    elif case == "skewed":
        t = np.exp(8 * t)
    rows = [("a", None if case == "nulls" and i % 3 == 0 else float("nan") if case == "nulls" and i % 3 == 1 else float(x), i) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "series_id string, t double, id long").union(spark.createDataFrame([("b", 1.0, 1)], "series_id string, t double, id long"))
    sizes = sample_slots(df, ["t", "id"], ["series_id"], 200).groupBy("series_id", "_slot").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200
    got = {r.id: r.seq for r in number_rows(df, ["t", "id"], slot_rows=200).filter("series_id = 'a'").collect()}
    order = sorted(range(3000), key=lambda i: ((rows[i][1] is not None) + (rows[i][1] != rows[i][1]), 0 if rows[i][1] is None or rows[i][1] != rows[i][1] else rows[i][1], i))
    assert [got[i] for i in order] == list(range(3000))


def test_no_group_is_longer_than_a_lane_and_its_halo(df):
    sizes = SMALL.spread(df, 5, 7).groupBy("series_id", LANE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 16 + 5 + 7


def test_running_before_in_blocks(spark):
    rows = pd.DataFrame({"k": "a", "i": np.arange(100), "v": np.arange(100.0)})
    out = running_before(spark.createDataFrame(rows), ["k"], "i", ["v"], block=7).toPandas().sort_values("i")
    assert np.allclose(out.v_before, np.r_[0, np.cumsum(np.arange(99.0))])


@pytest.mark.parametrize("width", [5, 50, 101])
def test_moving_average_keeps_the_edge_ramp(df, width):
    got = by_series(moving_average(df, ["x"], width, lanes=SMALL), "x_smooth")
    for name, x in shapes().items():
        assert (name in got) == (len(x) >= width)
        if name in got:
            assert np.allclose(got[name][:, 0], np.convolve(x, np.ones(width) / width, "same"))


@pytest.mark.parametrize("width", [4, 20])
def test_rolling_statistics(df, width):
    stats = ["ma", "std", "skew", "kurt"]
    got = by_series(rolling(df, ["x"], width, stats, SMALL), *[f"x_{s}" for s in stats])
    w = width
    for name, x in shapes().items():
        want = np.full((len(x), 4), np.nan)
        for i in range(w - 1, len(x)):
            part = x[i - w + 1 : i + 1]
            d = part - part.mean()
            m2, m3, m4 = (np.mean(d**k) for k in (2, 3, 4))
            if np.ptp(part) == 0:
                want[i] = part[0], 0.0, 0.0, -3.0
                continue
            skew = np.sqrt(w * (w - 1)) / (w - 2) * m3 / m2**1.5
            kurt = (w - 1) / ((w - 2) * (w - 3)) * ((w + 1) * (m4 / m2**2 - 3) + 6)
            want[i] = part.mean(), np.sqrt(m2 * w / (w - 1)), skew, kurt
        assert np.allclose(got[name], want, equal_nan=True, atol=1e-8, rtol=1e-7), name


@pytest.mark.parametrize("width", [51, 100, 201, 202])
def test_savgol_against_polynomial_fits(df, width):
    got = by_series(savgol(df, ["x"], width, lanes=SMALL), "x_smooth")
    for name, x in shapes().items():
        assert (name in got) == (len(x) >= width)
        if name in got:
            assert np.allclose(got[name][:, 0], savgol_brute(x, width), atol=1e-9), name


@pytest.mark.parametrize("before,after", [(3, 3), (4, 3), (0, 6), (20, 21)])
def test_sums_of_wide_frames_equal_plain_ones(spark, before, after):
    rng = np.random.default_rng(5)
    values = {f"s{n}": rng.normal(size=n) for n in (1, before + after + 1, 95, 160)}
    values["spike"] = np.where(np.arange(100) == 50, 1e15, rng.normal(size=100))
    values["gaps"] = np.where((np.arange(100) > 30) & (np.arange(100) < 80), np.nan, rng.normal(size=100))
    rows = frame(spark, values).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    spread = SMALL.spread(rows, before, after)
    sums = {}
    for narrow in (0, 1000):
        made = SMALL.keep(frame_sums(spread, ["x"], before, after, 0, SMALL, narrow=narrow))
        made = made.select("series_id", "seq", "_x_m0").toPandas()
        sums[narrow] = made.sort_values(["series_id", "seq"]).reset_index(drop=True)
    assert (sums[0]["_x_m0"].isna() == sums[1000]["_x_m0"].isna()).all()
    far = sums[0]["series_id"] != "spike"
    assert np.allclose(sums[0]["_x_m0"][far], sums[1000]["_x_m0"][far], equal_nan=True, atol=1e-12)
    for r in sums[0][~far].itertuples():
        part = values["spike"][max(r.seq - before, 0) : r.seq + after + 1]
        assert abs(r[3] - part.sum()) < (1e-9 if part.max() < 1e9 else 8.0)


def test_savgol_returns_quadratics_unchanged(spark):
    t = np.arange(130.0)
    x = 0.5 * t * t - 3 * t + 2
    got = by_series(savgol(frame(spark, {"q": x}), ["x"], 101, lanes=SMALL), "x_smooth")["q"][:, 0]
    assert np.allclose(got, x, atol=1e-6)


def test_savgol_nearest(df):
    got = by_series(savgol_nearest(df, ["x"], 220, lanes=SMALL), "x_smooth")
    for name, x in shapes().items():
        padded = np.pad(x, (109, 110), mode="edge")
        assert np.allclose(got[name][:, 0], np.convolve(padded, np.ones(220) / 220, "valid")), name


def test_running_sum_and_integration(df):
    got = by_series(running_sum(df, {"x": "c"}, SMALL), "c")
    timed = df.withColumn("t", F.col("seq") * F.col("seq"))
    speed = by_series(integrate(timed, {"x": "v"}, "t", SMALL), "v")
    for name, x in shapes().items():
        assert np.allclose(got[name][:, 0], np.cumsum(x)), name
        dt = np.diff(np.arange(len(x)) ** 2, prepend=0)
        assert np.allclose(speed[name][:, 0], np.cumsum(x * dt)), name


@pytest.mark.parametrize("width,step", [(10, 3), (7, 20), (100, 50)])
def test_sliding_windows(df, width, step):
    out = sliding_windows(df, ["x"], width, step, lanes=SMALL).toPandas()
    for name, x in shapes().items():
        g = out[out.series_id == name].sort_values("start")
        assert g.start.tolist() == list(range(0, len(x) - width + 1, step)), name
        for start, features in zip(g.start, g.features):
            assert [f[0] for f in features] == x[start : start + width].tolist()


@pytest.mark.parametrize("trim", [False, True])
def test_sequence_targets(df, trim):
    out = sequence_targets(df, ["x"], "x", 12, trim, lanes=SMALL).toPandas()
    for name, x in shapes().items():
        g = out[out.series_id == name].sort_values("start")
        assert len(g) == max(0, len(x) - 23 if trim else len(x) - 12), name
        assert g.target.tolist() == [x[i + 12] for i in g.start]


def test_segments_lose_the_last_full_one(df):
    for keep, expect in ((False, {"exact": 2, "noise": 6}), (True, {"exact": 3, "noise": 6})):
        out = segment_rows(df, 64, keep).groupBy("series_id").agg(F.count_distinct("segment").alias("k")).collect()
        got = {r.series_id: r.k for r in out}
        assert {k: got[k] for k in expect} == expect


def test_concatenation_numbers_all_rows_once(df):
    out = concatenate(df, buckets_hex=1).select("series_id", "seq", "global_seq", "total").toPandas().sort_values("global_seq")
    assert out.global_seq.tolist() == list(range(len(out))) and set(out.total) == {len(out)}
    assert all((g.seq.diff().dropna() == 1).all() and g.seq.iloc[0] == 0 for _, g in out.groupby("series_id"))


def test_resampling(df):
    cubic = by_series(resample_cubic(df, ["x"], lanes=SMALL), "x")
    linear = by_series(resample_linear(df, ["x"], lanes=SMALL), "x")
    for name, x in shapes().items():
        n = len(x)
        assert (name in cubic) == (n >= 4)
        if name in cubic:
            assert np.allclose(cubic[name][:, 0], spline(x, 2 * n), atol=1e-9), name
            assert np.allclose(cubic[name][[0, -1], 0], x[[0, -1]])
        want = np.interp(np.linspace(0, 1, 2 * n), np.linspace(0, 1, n), x) if n > 1 else np.repeat(x, 2)
        assert np.allclose(linear[name][:, 0], want), name


def test_noise_is_normal_and_does_not_depend_on_partitions(spark):
    rows = spark.range(20000).selectExpr("'a' AS series_id", "id AS seq", "20000L AS n", "0.0D AS acc_x", "id * 1.0D AS acc_y")
    first = {r.seq: r.acc_x for r in add_noise(rows, ["acc_x"]).collect()}
    again = {r.seq: r.acc_x for r in add_noise(rows.repartition(7), ["acc_x"]).collect()}
    assert first == again
    z = np.array(list(first.values())) / 0.02
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.1 and abs((z**4).mean() - 3) < 0.3
    moved = jitter(rows, ["acc_y"]).selectExpr("acc_y - seq AS d").toPandas().d
    assert abs(moved.std() / (0.01 * np.std(np.arange(20000))) - 1) < 0.03


def test_rotation_back_is_identity(df):
    rows = df.selectExpr("series_id", "seq", "n", "x AS a", "x * 2 + 1 AS b")
    back = rotate(rotate(rows, [("a", "b")], 10.0), [("a", "b")], -10.0)
    for name, x in shapes().items():
        assert np.allclose(by_series(back, "a", "b")[name], np.column_stack([x, 2 * x + 1]))
        break
