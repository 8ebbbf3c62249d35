"""Streams that hold state: any cut into files and batches, late rows, restarts and repeated deliveries give the same rows."""

import datetime as dt
import json
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from barspark.operators import band
from barspark.queries import evaluations
from barspark.streaming import bars as S
from barspark.streaming import folds as L
from barspark.streaming.ordered import Row, _Ordered, advanced

UTC = dt.UTC


def events(n=120, seed=0, symbols=("a", "b")):
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 60, "s")
    frame = pd.DataFrame({"event_id": np.arange(n), "ts": ts.astype("datetime64[us]"), "user_id": 1, "event_type": rng.choice(symbols, n), "value": np.exp(rng.normal(4, 0.6, n)).round(2), "props": ""})
    last = frame.iloc[-1:].assign(event_id=10_000, ts=ts[-1] + pd.Timedelta("1D"), event_type="end")
    return pd.concat([frame, last.astype(frame.dtypes)], ignore_index=True)


def put(frame, folder, parts):
    """Files of the given rows, the oldest first; what is late within ten minutes stays so."""
    folder.mkdir(exist_ok=True)
    start = len(list(folder.iterdir()))
    for k, rows in enumerate(parts):
        frame.iloc[rows].to_parquet(folder / f"f{start + k:03d}.parquet", index=False)


def shuffled(n, size=8, seed=1):
    """Rows dealt to files so that neighbours come in different ones, and the end by itself."""
    order = np.argsort(np.arange(n - 1) + np.random.default_rng(seed).uniform(0, 8, n - 1))
    return [*np.array_split(order, n // size), np.array([n - 1])]


BUILT = {
    "signals": lambda t: S.crossing_signals(t, 2, 6),
    "stops": lambda t: S.stops(t.where("event_id % 6 = 0").selectExpr("*", "IF(event_id % 12 = 0, 1, -1) AS side", "1 + event_id % 3 AS quantity"), t.where("event_id % 6 <> 0"), L.LiveStops(20, 15, 60, 45)),
    "notices": lambda t: S.notices(evaluations(t), L.Notices()),
    "gate": lambda t: S.once_a_day(t, 30),
}


def result(spark, build, folder, where):
    ticks = S.tick_stream(spark, str(folder), "*.parquet", 1)
    return sorted(map(tuple, S.run_to_end(build(ticks), str(where)).collect()), key=str)


@pytest.mark.parametrize("name", ["signals", "stops"])
def test_files_and_batches_do_not_matter(spark, tmp_path, name):
    frame = events()
    put(frame, tmp_path / "one", [np.arange(len(frame))])
    put(frame, tmp_path / "many", shuffled(len(frame), 30))
    whole = result(spark, BUILT[name], tmp_path / "one", tmp_path / "w1")
    assert len(whole) > 5
    assert result(spark, BUILT[name], tmp_path / "many", tmp_path / "w2") == whole


@pytest.mark.parametrize("name", ["notices", "stops"])
def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path, name):
    frame, parts = events(60), shuffled(61, 30)
    put(frame, tmp_path / "one", [np.arange(61)])
    put(frame, tmp_path / "some", parts[:1])
    before = result(spark, BUILT[name], tmp_path / "some", tmp_path / "w")
    put(frame, tmp_path / "some", parts[1:])
    after = result(spark, BUILT[name], tmp_path / "some", tmp_path / "w")
    whole = result(spark, BUILT[name], tmp_path / "one", tmp_path / "w1")
    assert after == whole and set(map(str, before)) < set(map(str, after))


def test_a_batch_may_be_delivered_twice(spark, tmp_path):
    for _ in range(2):
        S.delivered(spark.range(3), 7, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def at(minutes, kind=None, value=None, side=None, seq=0, label=None):
    return Row(round(minutes * 60e6), seq, kind, label, value, side)


def stops(rule, *rows):
    return [x[1:] for x in advanced(rule, rule.start(), rows, 10**18)[1]]


def test_stops_by_hand():
    fill = at(0, "fill", 44402.0, 1.0)
    assert stops(L.LiveStops(stop_points=70), fill, at(1, value=44350.0)) == []
    assert stops(L.LiveStops(stop_points=70), fill, at(1, value=44277.0)) == [("sell", 1.0, 44277.0, 44402.0, "stop_points")]
    assert stops(L.LiveStops(stop_points=70), at(1, value=40000.0)) == []
    short = at(0, "fill", 200.0, -2.0)
    assert stops(L.LiveStops(take_pct=1), short, at(1, value=198.0), at(2, value=100.0)) == [("buy", 2.0, 198.0, 200.0, "take_pct")]
    assert stops(L.LiveStops(stop_pct=1, stop_points=1), short, at(1, value=202.0))[0][-1] == "stop_pct"
    # A second fill moves the average, a part sold keeps it, a turn starts anew.
    more = (at(0, "fill", 100.0, 1.0), at(1, "fill", 110.0, 1.0), at(2, "fill", 50.0, -1.0))
    assert stops(L.LiveStops(stop_points=5), *more, at(3, value=100.0)) == [("sell", 1.0, 100.0, 105.0, "stop_points")]
    assert stops(L.LiveStops(stop_points=5), *more, at(3, "fill", 90.0, -3.0), at(4, value=95.0)) == [("buy", 2.0, 95.0, 90.0, "stop_points")]
    assert stops(L.LiveStops(stop_points=5), fill, at(1, value=0.0), at(1, value=None), at(2, "fill", 1.0, -1.0), at(3, value=1.0)) == []


def told(*rows):
    rule = L.Notices()
    return [(u // L.DAY, p, t) for u, p, t in advanced(rule, rule.start(), rows, 10**18)[1]]


def test_notices_by_hand():
    day = 24 * 60
    spike = lambda d, seq: at(d * day, "spike", label="s", seq=seq)
    regime = lambda d, label, seq=0: at(d * day, "regime", label=label, seq=seq)
    assert told(spike(0, 0), regime(0, "range"), spike(0, 1), regime(0, "range", 1), spike(1, 0)) == [(0, "regime", "range"), (0, "spike", "s"), (1, "spike", "s")]
    assert told(regime(0, "range"), regime(1, "range"), regime(2, "up")) == [(0, "regime", "range"), (2, "regime", "up")]
    assert told(regime(0, "range"), at(day), regime(2, "range")) == [(0, "regime", "range"), (2, "regime", "range")]


class Handle:
    """State of one key, as bytes where the store has bytes."""

    def __init__(self):
        self.timers = []

    def registerTimer(self, at):
        self.timers.append(at)

    def _state(self, *_):
        held = {}
        return SimpleNamespace(
            exists=lambda: bool(held), get=lambda: held.get("x"), update=lambda x: held.update(x=x), getValue=held.get, updateValue=held.__setitem__, removeKey=held.pop,
            keys=lambda: iter(list(held)), clear=held.clear, appendList=lambda rows: held.setdefault("x", []).extend(rows), put=lambda rows: held.update(x=rows),
        )

    getMapState = getValueState = getListState = _state


def test_a_timer_holds_a_slice_of_its_key_and_not_all_that_waits():
    rng, n = np.random.default_rng(3), 200_000
    frame = pd.DataFrame({"us": rng.integers(0, 30 * L.DAY, n), "seq": np.arange(n), "kind": None, "label": None, "value": rng.uniform(1, 100, n), "side": np.nan})
    fold, handle = L.DailyGate(), Handle()
    keyed = _Ordered(fold, ["key", "us", "seq", "value"])
    keyed.init(handle)
    keyed.handleInputRows(("a",), (frame.iloc[i : i + 10_000] for i in range(0, n, 10_000)), None)
    assert handle.timers == [frame["us"].min() // 1000]
    got, peaks = [], []
    # The first watermark is within a slice: the rest of it waits for the second.
    for until in (int(14.5 * L.DAY) + 12_345_000, 31 * L.DAY):
        tracemalloc.start()
        for out in keyed.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda until=until: until // 1000), None):
            got += out.itertuples(index=False, name=None)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert handle.timers[1:] == [frame["us"][frame["us"] > int(14.5 * L.DAY) + 12_345_000].min() // 1000]
    rows = [Row(u, s, None, None, v, None) for u, s, v in frame[["us", "seq", "value"]].itertuples(index=False)]
    assert got == [("a", *x) for x in advanced(fold, fold.start(), rows, 31 * L.DAY)[1]] and len(got) == 30
    assert max(peaks) < 8 << 20


def noon(day, second, value):
    return Row((day * 86400 + 12 * 3600 + second) * 1_000_000, 0, None, None, value, None)


def test_an_order_grows_stale_without_a_price():
    fold = L.BandOrders(band.Band(line=10, stop=5, arm=5, step=1))
    days = [noon(d, 3600, 20.0) for d in range(21)]
    confirmed = noon(21, 0, 20.0)
    state, out = advanced(fold, fold.start(), [*days, confirmed], confirmed.us)
    assert out == [] and fold.due(state) == confirmed.us + 600_000_000
    assert advanced(fold, state, [], confirmed.us + 599_999_999)[1] == []
    assert advanced(fold, state, [], confirmed.us + 600_000_000)[1] == [(confirmed.us + 600_000_000, "stale", "open", 0, None)]
    assert advanced(fold, state, [noon(21, 60, 21.0)], confirmed.us + 10**10)[1] == [(confirmed.us + 60_000_000, "open", "buy", 1, 21.0)]
    assert json.loads(advanced(fold, state, [], 10**18)[0][0])["machine"]["discarded"] == ["open"]


def test_the_band_stream_sends_and_discards_over_batches(spark, tmp_path):
    rows = [("x", d, 3600, 20.0) for d in range(21)] + [("x", 21, 30, 20.0)] + [("y", d, 3600, 20.0) for d in range(21)] + [("y", 21, 10, 20.0), ("y", 21, 75, 22.0), ("end", 22, 0, 1.0)]
    frame = pd.DataFrame([{"event_id": k, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(days=d, hours=12, seconds=s), "user_id": 1, "event_type": e, "value": v, "props": ""} for k, (e, d, s, v) in enumerate(rows)])
    frame["ts"] = frame["ts"].astype("datetime64[us]")
    by_time = frame.sort_values("ts", ignore_index=True)
    put(by_time, tmp_path / "in", [np.arange(30), np.arange(30, len(frame) - 1), np.array([len(frame) - 1])])
    got = result(spark, lambda t: S.band_orders(t, band.Band(line=10, stop=5, arm=5, step=1)), tmp_path / "in", tmp_path / "w")
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [("x", "stale", "open", None), ("y", "open", "buy", 22.0)]
    assert got[0][1] == dt.datetime(2024, 1, 22, 12, 10, 30)
