"""User code in a child process, and sweeps that can be cancelled."""

import datetime as dt
import os

import pytest

from barspark.operators import isolated as I
from barspark.operators.progress import SweepJob
from barspark.operators.strategy import Strategy, run_custom
from barspark.operators.sweep import run_all

CROSS = "def on_bar(ctx):\n    return ctx.buy() if ctx.cross_up(ctx.close, 10.0) else ctx.close_position() if ctx.cross_down(ctx.close, 10.0) else ctx.hold()\n"


@pytest.fixture(scope="module")
def bars(spark):
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=k), *[10.0 + (k % 5) - 2 + j] * 4, 1.0) for j, s in enumerate("abcdef") for k in range(40)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double").repartition(2).cache()


def decided(df):
    return sorted(tuple(r)[:5] for r in df.collect())


def test_decisions_are_those_of_the_task_itself(bars):
    found = I.run_isolated(bars, CROSS)
    assert decided(found) == decided(run_custom(bars, CROSS)) and found.where("fault IS NOT NULL").count() == 0


@pytest.mark.parametrize(
    ("harm", "told"),
    [("while True: pass", "no answer within"), ("ctx._bars.__class__", None), ("x = np.ones(10**10); return x", "out of memory"), ("raise SystemExit(3)", "SystemExit")],
)
def test_harm_stays_with_its_symbol(bars, harm, told):
    source = f"def on_bar(ctx):\n    if ctx.close.iloc[0] == 10.0:\n        {harm}\n    return ctx.buy()\n"
    if told is None:
        with pytest.raises(ValueError, match="__class__"):
            I.run_isolated(bars, source)
        return
    rows = I.run_isolated(bars, source, limits=I.Limits(seconds=4.0, memory=1 << 30)).collect()
    bad = [r for r in rows if r.fault]
    assert [r.symbol for r in bad] == ["c"] and told in bad[0].fault and bad[0].decision is None and bad[0].ts == dt.date(2024, 2, 9)
    assert {r.symbol for r in rows if r.decision == "BUY"} == set("abdef")


def test_a_crash_of_the_child_is_told():
    child = I.Child(I.Limits(seconds=5.0))
    os.kill(child.process.pid, 9)
    with pytest.raises(I.Fault, match="ended"):
        child.ask({"bars": {}})
        child.ask({"bars": {}})
    child.kill()


@pytest.mark.parametrize(
    ("source", "told"),
    [
        ("", "no code"),
        ("def on_bar(ctx):\n  return (", "line 2"),
        ("def other(ctx): pass", "missing"),
        ("def on_bar(): pass", "takes ctx"),
        ("async def on_bar(ctx): pass", "plain function"),
        ("import schedule\ndef on_bar(ctx): pass", "import of schedule"),
        ("def on_bar(ctx): pass\nwhile True:\n  pass", "a loop outside"),
        ("def on_bar(ctx): pass\nif __name__ == '__main__':\n  on_bar(1)", "main block"),
        ("def on_bar(ctx): return eval('1')", "use of eval"),
        ("import time\ndef on_bar(ctx): time.sleep(1)", "call of sleep"),
        ("def on_bar(ctx): return ().__class__.__bases__", "__bases__"),
    ],
)
def test_what_is_found_without_running(source, told):
    assert any(told in x for x in I.problems(source))
    assert I.problems(CROSS) == []


def make(p):
    return Strategy(entry=(("ma_cross_up", {"fast": p["fast"], "slow": 6}),), exit=(("ma_cross_down", {"fast": p["fast"], "slow": 6}),))


RUNS = [{"fast": f} for f in (2, 3, 4, 5)]


def figures(df):
    return sorted(tuple(r)[:7] for r in df.collect())


def test_a_sweep_in_parts_is_the_sweep(bars):
    told = []
    job = SweepJob(bars, make, RUNS, per_job=3, on_progress=lambda done, n: told.append((done, n))).start()
    assert job.wait() and told == [(3, 4), (4, 4)] and not job.cancelled
    assert figures(job.results()) == figures(run_all(bars, make, RUNS))


def test_a_cancelled_sweep_keeps_the_runs_that_ended(bars):
    job = SweepJob(bars, make, RUNS, per_job=1)
    job.on_progress = lambda done, n: job.cancel() if done == 2 else None
    assert job.start().wait(120) and job.cancelled and job.ended == 2
    assert figures(job.results()) == figures(run_all(bars, make, RUNS[:2]))
    none = SweepJob(bars, make, RUNS, per_job=1)
    none.cancel()
    assert none.start().wait(120) and none.results().count() == 0


def test_an_error_of_a_part_is_raised(bars):
    with pytest.raises(Exception, match="(?i)nothing|resolve|column"):
        SweepJob(bars.drop("open"), make, RUNS).start().wait(120)
