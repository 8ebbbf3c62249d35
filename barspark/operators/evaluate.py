"""All chart patterns on every bar, inside the JVM: swings as folds over candidate extremes, detectors on the last swings of each bar's window.

A bar is a candidate high (low) if it is the extreme of the bars around it; that does not hang on the window it is seen in. In a window
of a bar, candidates alternate: of neighbours of one kind the more extreme stays. Runs of neighbours are the same in every window but at its ends, so
they are folded once a series, and a bar takes the last few. Bearish patterns are written once; bullish ones are the same on negated prices.
Series that one task can hold go through kernels instead (operators/detect.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.recurrence import CHUNK, Blocks, as_bars, blocks_of
from barspark.operators.patterns import Settings, range_signals

#: Names by detector, the bearish one first.
NAMES = {"double": ("double_top", "double_bottom"), "shoulders": ("head_shoulders_top", "head_shoulders_bottom"), "n": ("n_down", "n_up")}
WEDGES = {(-1, 1): "triangle_symmetrical", (0, 1): "triangle_ascending", (-1, 0): "triangle_descending", (1, 1): "wedge_rising", (-1, -1): "wedge_falling"}
FRAMES = ("range_breakout", "range_breakdown", "undercut_reverse", "false_breakout", "island_reversal_down", "island_reversal_up")
PATTERNS = ("regime", "near_range_high", "near_range_low", *(n for pair in NAMES.values() for n in pair), *WEDGES.values(), *FRAMES)
#: Bars that a detector needs besides the two reaches of a swing.
NEED = {"double": 3, "shoulders": 5, "n": 3, "wedge": 6}
_SIGNAL = "struct<pattern:string,label:string,line:double>"
_SWINGS = "array<struct<i:int,k:int,p:double>>"
SIDES = {1: "highs", -1: "lows"}
#: Swings that detectors look at: of doubles two a side, of the others four.
NEAR, FAR = 4, 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _signal(pattern: str | Column, label: Column | None = None, line: Column | None = None) -> Column:
    none = F.lit(None)
    name = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.struct(name.alias("pattern"), (none if label is None else label).cast("string").alias("label"), (none if line is None else line).cast("double").alias("line"))


def _states(xs: str, zero: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The states of a fold behind each element of an array column. A fold copies what it has at each step, so it goes over chunks."""
    one = lambda out, x: F.array_append(out, step(F.element_at(out, -1), x))
    chunk = lambda k, last: F.slice(F.aggregate(F.slice(xs, k, CHUNK), F.array(last), one), 2, CHUNK)
    starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(starts, F.array().cast(f"array<{kind}>"), lambda out, k: F.concat(out, chunk(k, F.coalesce(F.try_element_at(out, F.lit(-1)), zero))))


def _candidates(blocks: Blocks, reach: int) -> Blocks:
    """_cand: (i, k, p) of all candidates in order, a high before a low of one bar; _upto: how many come up to each bar.

    Neighbours of one kind are a run, of which one is a swing: _early has for each candidate its run's number and the swing of the run so far, _late the swing
    of the run from there on, _runs that of each whole run.
    """
    inside = lambda i: (i >= reach) & (i + reach < F.size("_x_close"))
    around = lambda xs, i: F.slice(xs, i - reach + 1, 2 * reach + 1)
    one = lambda i, k, p: F.struct(i.alias("i"), F.lit(k).alias("k"), p.alias("p"))

    def at(_: Column, i: Column) -> Column:
        high, low = F.get("_x_high", i), F.get("_x_low", i)
        top = F.when(inside(i), F.when(high >= F.array_max(around("_x_high", i)), one(i, 1, high)))
        return F.array_compact(F.array(top, F.when(inside(i), F.when(low <= F.array_min(around("_x_low", i)), one(i, -1, low)))))

    def swing(n: Column, keep: Column, last: Column, x: Column) -> Column:
        chosen = lambda c: F.when(keep, last[c]).otherwise(x[c]).alias(c)
        return F.struct(n.cast("int").alias("n"), chosen("i"), x["k"].alias("k"), chosen("p"))

    same = lambda last, x: last["k"] == x["k"]
    # The more extreme stays, the first of equal ones.
    early = lambda last, x: swing(last["n"] + F.when(same(last, x), 0).otherwise(1), same(last, x) & (x["k"] * x["p"] <= x["k"] * last["p"]), last, x)
    late = lambda last, x: swing(F.lit(0), same(last, x) & (x["k"] * x["p"] < x["k"] * last["p"]), last, x)
    none = F.struct(F.lit(-1).alias("n"), F.lit(-1).alias("i"), F.lit(0).alias("k"), F.lit(0.0).alias("p"))
    kind = "struct<n:int,i:int,k:int,p:double>"
    per = blocks.let(_per=F.transform("_x_close", at))
    per = per.let(_cand=F.flatten("_per"), _sizes=F.transform("_per", F.size)).let(_back=F.reverse("_cand"))
    per = per.let(_upto=_states("_sizes", F.lit(0), "int", lambda n, x: n + x), _early=_states("_cand", none, kind, early), _late=F.reverse(_states("_back", none, kind, late)))
    return per.let(_runs=F.filter("_early", lambda x, c: ~F.coalesce(F.get("_early", c + 1)["n"] == x["n"], F.lit(False))))


def _swings(t: Column, size: int, reach: int, last: int) -> Column:
    """The last few alternating swings of the window of `size` bars that ends with bar t: highs and lows apart.

    Runs inside the window are whole; only its first may have begun before, and its last may go on.
    """
    first = F.greatest(t - size + 1, F.lit(0))
    start, end = F.get("_upto", first + reach - 1), F.get("_upto", t - reach)

    def merge(found: Column, x: Column) -> Column:
        return F.when(found.isNull() | (x["k"] * x["p"] > x["k"] * found["p"]), x).otherwise(found)

    def runs(w: Column) -> Column:
        a, z = w["a"], w["z"]
        inner = F.greatest(a + 1, z["n"] - (last - 1))
        only = F.array(F.aggregate(F.slice("_cand", w["start"] + 1, w["end"] - w["start"]), F.lit(None).cast("struct<i:int,k:int,p:double>"), merge))
        head = F.when(a > z["n"] - last, F.array(plain(F.get("_late", w["start"])))).otherwise(F.array().cast(_SWINGS))
        more = F.concat(head, F.transform(F.slice("_runs", inner + 1, z["n"] - inner), plain), F.array(plain(z)))
        return F.when(a == z["n"], only).otherwise(more)

    plain = lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["p"].alias("p"))
    bounds = F.struct(start.alias("start"), end.alias("end"), F.get("_early", start)["n"].alias("a"), F.get("_early", end - 1).alias("z"))
    return F.when((t - first >= 2 * reach) & (end > start), _let(bounds, runs)).otherwise(F.array().cast(_SWINGS))


def _sides(swings: Column) -> Column:
    side = lambda x, k: F.filter(x, lambda s: s["k"] == k).alias(SIDES[k])
    return _let(swings, lambda x: F.struct(*(side(x, k) for k in SIDES)))


def _side(swings: Column, k: int, sign: int) -> Column:
    """Swings of kind k with prices of the given sign."""
    found = swings[SIDES[k]]
    return found if sign == 1 else F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), (-x["p"]).alias("p")))


def _first_below(t: Column, start: Column, line: Column, m: int) -> Column:
    """Whether the close of t is under the line and none from start on was, prices of sign m."""
    return (F.get("_x_close", t) * m < line) & ~F.coalesce(F.exists(F.slice("_x_close", start + 1, F.greatest(t - start, F.lit(0))), lambda c: c * m < line), F.lit(False))


def _when_broken(t: Column, start: Column, line: Column, m: int, name: str) -> Column:
    return _let(line, lambda at: F.when(_first_below(t, start, at, m), _signal(name, line=at * m)))


def _double(t: Column, swings: Column, m: int, s: Settings, name: str) -> Column:
    def look(tops: Column) -> Column:
        i, a, j, b = tops[0]["i"], tops[0]["p"], tops[1]["i"], tops[1]["p"]
        between = F.array_min(F.slice("_x_low", i + 2, j - i - 1)) if m > 0 else -F.array_max(F.slice("_x_high", i + 2, j - i - 1))
        alike = (j > i + 1) & (a != 0) & (F.try_divide(F.abs(b - a), F.abs(a)) * 100 <= s.tolerance_pct)
        return F.when((F.size(tops) == 2), F.when(alike, _when_broken(t, j + 1, between, m, name)))

    return _let(F.slice(_side(swings, m, m), -2, 2), look)


def _shoulders(t: Column, swings: Column, m: int, s: Settings, name: str) -> Column:
    margin, tolerance = s.head_margin_pct / 100, max(s.tolerance_pct, 5.0)

    def look(both: Column) -> Column:
        tops, lows = both["tops"], both["lows"]
        (i, left), (j, head), (k, right) = ((tops[n]["i"], tops[n]["p"]) for n in range(3))
        between = lambda a, b: F.filter(lows, lambda x: (x["i"] > a) & (x["i"] < b))
        tall = (head > left + F.abs(left) * margin) & (head > right + F.abs(right) * margin)
        even = (left != 0) & (F.try_divide(F.abs(right - left), F.abs(left)) * 100 <= tolerance)
        neck = (F.try_element_at(between(i, j), F.lit(-1))["p"] + F.get(between(j, k), F.lit(0))["p"]) / 2
        return F.when((F.size(tops) == 3), F.when(tall & even, _let(neck, lambda at: F.when(at.isNotNull(), _when_broken(t, k + 1, at, m, name)))))

    return _let(F.struct(F.slice(_side(swings, m, m), -3, 3).alias("tops"), _side(swings, -m, m).alias("lows")), look)


def _n(t: Column, swings: Column, m: int, s: Settings, name: str) -> Column:
    def look(both: Column) -> Column:
        tops, lows = both["tops"], both["lows"]
        i, a, j, b = tops[0]["i"], tops[0]["p"], tops[1]["i"], tops[1]["p"]
        line = F.try_element_at(F.filter(lows, lambda x: (x["i"] > i) & (x["i"] < j)), F.lit(-1))["p"]
        return F.when((F.size(tops) == 2), F.when(b < a, _let(line, lambda at: F.when(at.isNotNull(), _when_broken(t, j + 1, at, m, name)))))

    return _let(F.struct(F.slice(_side(swings, m, m), -2, 2).alias("tops"), _side(swings, -m, m).alias("lows")), look)


def _sum(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda n, x: n + f(x))


def _slope(points: Column) -> Column:
    """Of the least squares line; places count from the first point."""
    x = lambda p: (p["i"] - points[0]["i"]).cast("double")
    n = F.size(points)
    sx, sy, sxx, sxy = _sum(points, x), _sum(points, lambda p: p["p"]), _sum(points, lambda p: x(p) * x(p)), _sum(points, lambda p: x(p) * p["p"])
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def _wedge(swings: Column, s: Settings) -> Column:
    last = lambda k: _let(_side(swings, k, 1), lambda x: F.slice(x, F.greatest(F.size(x) - 3, F.lit(1)), 4))

    def look(both: Column) -> Column:
        tops, lows = both["tops"], both["lows"]
        level = (_sum(tops, lambda p: p["p"]) + _sum(lows, lambda p: p["p"])) / (F.size(tops) + F.size(lows))
        way = lambda v, flat: F.when(F.abs(v) <= flat, 0).otherwise(F.signum(v).cast("int"))

        def named(x: Column) -> Column:
            flat = x["level"] * s.flat_pct / 100
            kinds = [F.when((way(x["up"], flat) == a) & (way(x["down"], flat) == b), name) for (a, b), name in WEDGES.items()]
            return F.when(x["level"] > 0, F.coalesce(*kinds))

        name = _let(F.struct(level.alias("level"), _slope(tops).alias("up"), _slope(lows).alias("down")), named)
        return F.when((F.size(tops) >= 3) & (F.size(lows) >= 3), _let(name, lambda n: F.when(n.isNotNull(), _signal(n))))

    return _let(F.struct(last(1).alias("tops"), last(-1).alias("lows")), look)


def _regime(t: Column, s: Settings) -> list[Column]:
    """Regime and nearness to the ends of the range, of windows of 10 bars or more; the first half of a window has half its bars, rounded down."""
    size = F.least(F.lit(s.lookback), t + 1)
    closes = F.slice("_x_close", t - size + 2, size)
    half = F.floor(size / 2).cast("int")
    mean = lambda xs: _let(F.array_compact(xs), lambda known: F.try_divide(_sum(known, lambda x: x), F.size(known).cast("double")))
    facts = F.struct(F.array_max(closes).alias("high"), F.array_min(closes).alias("low"), mean(F.slice(closes, 1, half)).alias("a"), mean(F.slice(closes, half + 1, size)).alias("b"), F.get("_x_close", t).alias("now"))

    def look(x: Column) -> Column:
        change = F.coalesce(F.try_divide(x["b"] - x["a"], x["a"]) * 100, F.lit(0.0))
        near = lambda d: F.coalesce(F.try_divide(d, x["high"] - x["low"]) * 100 <= s.near_pct, F.lit(False))
        label = F.when(change > 2 * s.near_pct, "up").when(change < -2 * s.near_pct, "down").otherwise("range")
        return F.array(_signal("regime", label), F.when(near(x["high"] - x["now"]), _signal("near_range_high", line=x["high"])), F.when(near(x["now"] - x["low"]), _signal("near_range_low", line=x["low"])))

    return F.when(size >= 10, _let(facts, look)).otherwise(F.array().cast(f"array<{_SIGNAL}>"))


def evaluated(bars: DataFrame, s: Settings = Settings(), enabled: tuple[str, ...] = PATTERNS) -> DataFrame:
    """symbol, ts, pattern, label, line of all enabled patterns on every bar, as seen on that bar: nothing later is looked at.

    bars has symbol, ts, high, low, close. line is the neckline or the end of a range that a pattern rests on, label the regime. Doubles are sought in lookback
    bars, other swings in 90 or more. A series of fewer than 10 bars has no pattern on its first nine; null prices are no extremes. Series of any
    length are cut into blocks that overlap by a window.
    """
    unknown = set(enabled) - set(PATTERNS)
    if unknown:
        raise ValueError(f"no such patterns: {', '.join(sorted(unknown))}")
    rows = bars.select("symbol", "ts", "high", "low", "close")
    blocks = _candidates(blocks_of(rows, "symbol", "ts", ["high", "low", "close"], s.long - 1), s.swing_window)
    places = F.transform("_rows", lambda _, k: k + F.col("_halo"))
    swings = lambda t: F.struct(t.alias("t"), _sides(_swings(t, s.lookback, s.swing_window, NEAR)).alias("near"), _sides(_swings(t, s.long, s.swing_window, FAR)).alias("far"))
    blocks = blocks.let(_at=F.transform(places, swings))

    def detect(w: Column) -> Column:
        t, enough = w["t"], lambda what: F.least(w["t"] + 1, F.lit(s.lookback if what == "double" else s.long)) >= 2 * s.swing_window + NEED[what]
        made = []
        for what, f in (("double", _double), ("shoulders", _shoulders), ("n", _n)):
            for m, name in zip((1, -1), NAMES[what], strict=True):
                if name in enabled:
                    made.append(F.when(enough(what), f(t, w["near"] if what == "double" else w["far"], m, s, name)))
        if set(WEDGES.values()) & set(enabled):
            made.append(F.when(enough("wedge"), _wedge(w["far"], s)))
        found = F.array_compact(F.array(*made)) if made else F.array().cast(f"array<{_SIGNAL}>")
        return F.when(t >= 9, F.concat(found, F.array_compact(_regime(t, s)))).otherwise(F.array().cast(f"array<{_SIGNAL}>"))

    flat = as_bars(blocks.let(_signals=F.transform("_at", detect)), {"_s": "_signals"})
    swinging = flat.select("symbol", "ts", F.explode("_s").alias("_s")).select("symbol", "ts", "_s.pattern", "_s.label", "_s.line").where(F.col("pattern").isin(*enabled))
    frames = [n for n in FRAMES if n in enabled]
    if not frames:
        return swinging
    # The same rule of ten bars for patterns of frames; their own frames ask for more but for the islands.
    seen = range_signals(rows, s)
    fired = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in frames)))
    framed = seen.select("symbol", "ts", F.explode(fired).alias("pattern"))
    return swinging.union(framed.select("symbol", "ts", "pattern", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("line")))
