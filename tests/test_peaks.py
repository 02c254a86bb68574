import numpy as np
import pytest

from kinelane.operators import peaks
from kinelane.operators.lanes import Lanes
from kinelane.operators.peaks import consensus_repetitions, count_peaks, find_peaks, local_maxima, prominences, windowed_peaks
from series import frame, maxima, prominence, shapes, spaced


@pytest.fixture(scope="module")
def df(spark):
    return frame(spark).cache()


@pytest.mark.parametrize("rows", [16, 4096])
def test_maxima_with_flat_tops_across_lanes(df, rows):
    out = local_maxima(df, "x", lanes=Lanes(rows=rows)).toPandas()
    for name, x in shapes().items():
        got = sorted(map(tuple, out[out.series_id == name][["seq", "left", "right"]].astype(int).values.tolist()))
        assert got == maxima(x), name


@pytest.mark.parametrize("distance", [5, 40])
def test_distance_is_the_greedy_choice(df, distance):
    out = find_peaks(df, "x", distance=distance, lanes=Lanes(rows=16)).toPandas()
    for name, x in shapes().items():
        assert sorted(out[out.series_id == name].seq) == spaced([m[0] for m in maxima(x)], x, distance), name


def test_distance_chain_longer_than_a_lane(spark):
    """Each peak waits for the next higher one: a chain over the whole series."""
    x = np.zeros(800)
    x[1::4] = np.arange(200) + 1.0
    x[-1] = 0
    got = sorted(find_peaks(frame(spark, {"c": x}), "x", distance=6, lanes=Lanes(rows=16)).toPandas().seq)
    assert got == spaced([m[0] for m in maxima(x)], x, 6)


def chains() -> dict[str, np.ndarray]:
    """Peaks that hang on each other over many lanes: up, down, to both sides, from both sides, and interleaved."""
    rng = np.random.default_rng(3)
    out = {k: np.zeros(800) for k in ("up", "down", "valley", "hill", "crossed", "ties", "drift", "loose")}
    at = np.arange(1, 798, 4)
    out["up"][at] = np.arange(len(at)) + 1.0
    out["down"][at] = np.arange(len(at))[::-1] + 1.0
    out["valley"][at] = np.abs(np.arange(len(at)) - 90.5) + 1
    out["hill"][at] = 300 - np.abs(np.arange(len(at)) - 90.5)
    out["crossed"][at] = np.where(np.arange(len(at)) % 2, np.arange(len(at)) + 1.5, np.arange(len(at))[::-1] + 1.0)
    out["ties"][at] = 1.0
    out["drift"][:] = np.arange(800) * 0.05 + rng.normal(size=800)
    out["loose"][np.cumsum(rng.integers(2, 9, size=140))[:130]] = np.arange(130) + 1.0
    for x in out.values():
        x[-1] = -1
    return out


@pytest.mark.parametrize("distance", [5, 6, 13])
def test_distance_over_chains_of_many_lanes(spark, monkeypatch, distance):
    rounds = []
    maps = peaks._border_maps
    monkeypatch.setattr(peaks, "_border_maps", lambda *a: rounds.append(a) or maps(*a))
    single = {k: x for k, x in chains().items() if k != "crossed"}
    lanes = Lanes(rows=16)
    for values, most in ((single, 1), ({"crossed": chains()["crossed"]}, 50)):
        rounds.clear()
        out = find_peaks(frame(spark, values), "x", distance=distance, lanes=lanes).toPandas()
        for name, x in values.items():
            assert sorted(out[out.series_id == name].seq) == spaced([m[0] for m in maxima(x)], x, distance), name
        assert len(rounds) <= most
        assert all(rows == max(16, 2 * distance) for *_, rows in rounds)


@pytest.mark.parametrize("rows,fan", [(16, 2), (64, 8)])
def test_prominence_over_a_deep_tree(df, rows, fan):
    lanes = Lanes(rows=rows)
    out = prominences(df, local_maxima(df, "x", lanes=lanes), "x", lanes=lanes, fan=fan).toPandas()
    for name, x in shapes().items():
        g = out[out.series_id == name]
        want = {m[0]: prominence(x, m[0]) for m in maxima(x)}
        got = dict(zip(g.seq.astype(int), g.prominence))
        assert got.keys() == want.keys(), name
        assert np.allclose([got[k] for k in want], list(want.values())), name


def test_windowed_peaks_keep_repeats(df):
    out = windowed_peaks(df, "x", 9, height=1.0, lanes=Lanes(rows=16)).toPandas()
    for name, x in shapes().items():
        want = sorted((i, m[0] + i) for i in range(len(x) - 8) for m in maxima(x[i : i + 9]) if x[m[0] + i] >= 1.0)
        got = sorted(map(tuple, out[out.series_id == name][["start", "seq"]].astype(int).values.tolist()))
        assert got == want, name


def test_counts_keep_series_without_peaks(df):
    got = {r.series_id: r.peaks for r in count_peaks(df, find_peaks(df, "x", height=0.5, distance=60)).collect()}
    assert got["sine"] == 5 and got["const"] == 0 and got["one"] == 0


def test_consensus_of_axes(spark):
    t = np.arange(1000)
    base = frame(spark, {"five": np.sin(t * 2 * np.pi / 200 - 1.5), "three": np.sin(t * 2 * np.pi / 333 - 1.5)})
    axes = base.selectExpr("series_id", "seq", "n", "x AS a", "x * 2 AS b", "x + 1 AS c", "-x AS d")
    got = {r.series_id: r.repetitions for r in consensus_repetitions(axes, ["a", "b", "c", "d"], width=100).collect()}
    assert got == {"five": 5, "three": 3}
