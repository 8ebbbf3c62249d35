"""Exponential averages over long series, without Python: affine maps of blocks, carried from block to block.

An exponential average is a chain of affine maps y -> c * y + (1 - c) * x, one a bar, so a run of bars is one such map. The bars of a
series are cut into blocks by quantiles of their time; every block is folded on its own, the maps of a long series' blocks are
chained in one small fold, and each block is then run through with the value that enters it. A series of at most BLOCK bars is
one block and needs no chain. The blocks of one series are as many tasks as Spark likes.

The first value weighs fully. A bar without a value keeps the average and decays what came before it: after a gap of g bars the
old average weighs (1 - alpha) ** (g + 1) against alpha.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.sources.scratch import attached, written

#: Bars of a block, about, and of the chunks that are folded at once.
BLOCK = 1024
CHUNK = 32
#: Quantiles that cut a long series: one less than a power of two, for the search.
EDGES = 1023


@dataclass
class Blocks:
    """Series cut into blocks: a row each, with arrays along the bars. halo is how many bars before a block its arrays begin with."""

    rows: DataFrame
    key: str
    long: bool
    columns: list[str] = field(default_factory=list)

    def let(self, **arrays: Column) -> Blocks:
        """With more arrays, computed from those that are there."""
        return Blocks(self.rows.withColumns(arrays), self.key, self.long, self.columns)


def long_series(bars: DataFrame, key: str, made_of: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """The keys of series of more than bound bars, BLOCK if there is none, and their bars as _n, as a saved table.

    made_of has the key of each row that bars are made from, at least one a bar. Bars are then counted only where those are more than that,
    as counting bars means making them.
    """
    bound = BLOCK if bound is None else bound
    counted = lambda rows: rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
    if made_of is None:
        return written(counted(bars), "long-series")
    most = written(counted(made_of), "most-bars")
    if most.isEmpty():
        return most
    # Null keys are a series, too.
    held = attached(bars.withColumn("_key", F.struct(key)), most.select(F.struct(key).alias("_key")), ["_key"], "left_semi")
    return written(counted(held.drop("_key")), "long-series")


def _numbered(bars: DataFrame, key: str, ts: str, counts: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """bars with _block, rising in time along each series, and whether any series has more than one; counts is long_series, if that is known."""
    counts = long_series(bars, key) if counts is None else counts
    if counts.isEmpty():
        return bars.withColumn("_block", F.lit(0)), False
    # Null keys are a series, too.
    cuts = [(k + 1) / (EDGES + 1) for k in range(EDGES)]
    held = attached(bars.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.struct(key).alias("_key")), counts.select(F.struct(key).alias("_key"), "_n"), ["_key"])
    edges = held.groupBy("_key").agg(F.percentile_approx("_t", cuts, 20 * EDGES).alias("_edges"), F.max("_n").alias("_n"))
    edges = written(edges, "series-edges")
    steps, before = (EDGES + 1).bit_length() - 1, F.lit(0)
    found = F.aggregate(
        F.array(*(F.lit(1 << s) for s in reversed(range(steps)))), before, lambda at, s: at + F.when(F.element_at("_edges", at + s) < F.col(ts), s).otherwise(F.lit(0))
    )
    stride = F.greatest(F.lit(1), F.floor(F.lit((EDGES + 1) * BLOCK) / F.col("_n")))
    placed = attached(bars.withColumn("_key", F.struct(key)), edges, ["_key"], "left")
    number = F.coalesce(F.floor(found / stride).cast("int"), F.lit(0))
    return placed.withColumn("_block", number).drop("_key", "_edges", "_n"), True


def blocks_of(bars: DataFrame, key: str, ts: str, inputs: Sequence[str], halo: int, counts: DataFrame | None = None) -> Blocks:
    """bars as blocks with _rows (structs of all columns, in order of ts) and an array of doubles for each input, which begins with up to halo earlier bars.

    Ties of ts are put in order by the other columns. NaN counts as null.
    """
    columns = list(bars.columns)
    numbered, long = _numbered(bars, key, ts, counts)
    item = F.struct(F.col(f"`{ts}`").alias("_at"), *(F.col(f"`{c}`") for c in columns))
    rows = numbered.groupBy(key, "_block").agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    value = lambda c: lambda r: F.nanvl(r[c].cast("double"), F.lit(None).cast("double"))
    if not long:
        arrays = {f"_x_{c}": F.transform("_rows", value(c)) for c in inputs}
        return Blocks(_told_whole(rows.withColumns(arrays | {"_halo": F.lit(0)}), inputs), key, False, columns)
    rows = written(rows, "series-blocks")
    tail = F.struct("_block", F.slice("_rows", F.greatest(F.size("_rows") - halo + 1, F.lit(1)), max(halo, 1)).alias("_tail"))
    # Only blocks of long series have any before them; their tails are a few bars each.
    behind = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.select(key, "_block", tail.alias("_t")).withColumn("_tails", F.collect_list("_t").over(behind))
    before = F.flatten(F.transform("_tails", lambda t: t["_tail"]))
    before = F.slice(before, F.greatest(F.size(before) - halo + 1, F.lit(1)), halo) if halo else F.slice(before, 1, 0)
    tails = tails.select(F.struct(key, "_block").alias("_key"), before.alias("_before"))
    joined = rows.withColumn("_key", F.struct(key, "_block")).join(tails, "_key").drop("_key")
    joined = joined.withColumn("_both", F.concat("_before", "_rows")).withColumn("_halo", F.size("_before"))
    arrays = {f"_x_{c}": F.transform("_both", value(c)) for c in inputs}
    return Blocks(_told_whole(joined.withColumns(arrays), inputs).drop("_both", "_before"), key, True, columns)


def _told_whole(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"_whole_{c}": ~F.exists(f"_x_{c}", lambda x: x.isNull()) for c in inputs}) if inputs else rows


def before(xs: str, i: Column, n: int = 1) -> Column:
    """The value n bars before index i of an array column; null before its start."""
    return F.when(i >= n, F.get(xs, i - n))


def along(xs: str, f: Callable[[Column, Column], Column] | None = None) -> Column:
    """f(value, index), or the value itself, along an array column that begins with a halo, the halo left out."""
    return F.slice(F.col(xs) if f is None else F.transform(xs, f), F.col("_halo") + 1, F.size("_rows"))


def extreme(xs: str, i: Column, n: int, of: Callable[[Column], Column]) -> Column:
    """The least or greatest of n values up to index i; null where one is missing."""
    window = F.slice(F.col(xs), i - (n - 1) + 1, n)
    # _whole_<input>: that the whole array has no gap, so that windows need not be looked through.
    return F.when((i >= n - 1) & (F.col(xs.replace("_x_", "_whole_")) | (F.size(F.array_compact(window)) == n)), of(window))


def running_sums(xs: str) -> Column:
    """Along an array column with its halo: n gaps, s sum of values and t sum of values by place, up to and with each place; gaps count as 0."""
    none = F.array().cast("array<struct<n:int,s:double,t:double>>")
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def step(out: Column, p: Column) -> Column:
        last, x = F.element_at(out, -1), p["x"]
        value = F.coalesce(x, F.lit(0.0))
        new = F.struct((last["n"] + F.when(x.isNull(), 1).otherwise(0)).alias("n"), (last["s"] + value).alias("s"), (last["t"] + value * p["i"]).alias("t"))
        return F.array_append(out, new)

    places = F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    chunk = lambda k, last: F.slice(F.aggregate(F.slice(places, k, CHUNK), F.array(last), step), 2, CHUNK)
    starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(starts, none, lambda out, k: F.concat(out, chunk(k, F.coalesce(F.try_element_at(out, F.lit(-1)), zero))))


def trailing(xs: str, sums: str, n: int, weighted: bool = False) -> Column:
    """Mean of n values along an array column, or the one whose weights rise from 1 to n, from its running sums; null where a value is missing."""

    def at(_: Column, i: Column) -> Column:
        now, old = F.get(sums, i), F.get(sums, i - n)
        before_ = lambda name, none: F.coalesce(old[name], F.lit(none))
        total = now["s"] - before_("s", 0.0)
        if weighted:
            value = (now["t"] - before_("t", 0.0) - (i - n) * total) / (n * (n + 1) / 2)
        else:
            value = total / n
        return F.when((i >= n - 1) & (now["n"] == before_("n", 0)), value)

    return along(xs, at)


def _weight(alpha: float | Smoothing, gap: Column) -> Column:
    """The share of the old average at a value behind a gap of so many bars."""
    alpha = alpha.alpha if isinstance(alpha, Smoothing) else alpha
    w = 1.0 - alpha
    old = F.when(gap == 0, F.lit(w)).otherwise(F.pow(F.lit(w), gap + 1))
    return old / (old + alpha)


@dataclass(frozen=True)
class Smoothing:
    """The average of m bars, alpha 1 / m, in one of two forms that differ in their rounding only, which decides where lines that touch cross.

    mean: (w * y + x / m) / (w + 1 / m), w the share of what is old; otherwise y + (x - y) / m.
    """

    m: int
    mean: bool = False

    @property
    def alpha(self) -> float:
        return 1.0 / self.m

    def plain(self, y: Column, x: Column) -> Column:
        return self.weighed(y, x, F.lit(1.0 * (self.m - 1) / self.m)) if self.mean else y + (x - y) / float(self.m)

    def behind(self, y: Column, x: Column, gap: Column) -> Column:
        """Next average behind a gap of so many bars, each of which decays the old share by itself."""
        decay = lambda w, _: w * (self.m - 1) / self.m
        return self.weighed(y, x, F.aggregate(F.sequence(F.lit(0), gap), F.lit(1.0), decay))

    def weighed(self, y: Column, x: Column, w: Column) -> Column:
        return (w * y + x / float(self.m)) / (w + 1.0 / self.m)


def _run(xs: Column, alpha: float | Smoothing, y: Column, gap: Column) -> Column:
    """The averages along xs, when y enters behind a gap of so many bars; y is null at the start.

    A fold copies what it has at each bar, so it goes over chunks of CHUNK bars, and an outer fold over the chunks.
    """

    def step(s: Column, x: Column) -> Column:
        y = F.element_at(s["out"], -1)
        plain = x.isNotNull() & y.isNotNull() & (s["g"] == 0)
        if isinstance(alpha, Smoothing):
            new = F.when(plain, alpha.plain(y, x)).when(x.isNull(), y).when(y.isNull(), x).otherwise(alpha.behind(y, x, s["g"]))
        else:
            c = _weight(alpha, s["g"])
            new = F.when(plain, y + alpha * (x - y)).when(x.isNull(), y).when(y.isNull(), x).otherwise(c * y + (1 - c) * x)
        return F.struct(F.when(x.isNull(), s["g"] + 1).otherwise(F.lit(0)).alias("g"), F.array_append(s["out"], new).alias("out"))

    # Each chunk starts with the average before it, which is what it goes on from.
    chunk = lambda k, y, g: F.aggregate(F.slice(xs, k, CHUNK), F.struct(g.alias("g"), F.array(y).alias("out")), step)
    start = F.struct(gap.cast("int").alias("g"), F.array(y.cast("double")).alias("out"))

    def chunks(s: Column, k: Column) -> Column:
        done = F.transform(F.array(chunk(k, F.element_at(s["out"], -1), s["g"])), lambda r: F.struct(r["g"].alias("g"), F.concat(s["out"], F.slice(r["out"], 2, CHUNK)).alias("out")))
        return done[0]

    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK)), start, chunks, lambda s: s["out"])
    return F.slice(whole, 2, F.greatest(F.size(xs), F.lit(1)))


def _map(xs: Column, alpha: float | Smoothing) -> Column:
    """What a block does to the average: lead (bars before its first value), first (that value), then y -> c * y + d, and gap (bars behind its last value).

    first is null where the block has no value; lead is then its length.
    """
    number = lambda v: F.lit(v).cast("double")
    start = F.struct(F.lit(0).alias("lead"), number(None).alias("first"), number(1.0).alias("c"), number(0.0).alias("d"), F.lit(0).alias("gap"))

    def step(s: Column, x: Column) -> Column:
        fresh, c = s["first"].isNull(), _weight(alpha, s["gap"])
        return F.struct(
            F.when(fresh & x.isNull(), s["lead"] + 1).otherwise(s["lead"]).alias("lead"),
            F.when(fresh, x).otherwise(s["first"]).alias("first"),
            F.when(fresh | x.isNull(), s["c"]).otherwise(c * s["c"]).alias("c"),
            F.when(fresh | x.isNull(), s["d"]).otherwise(c * s["d"] + (1 - c) * x).alias("d"),
            F.when(x.isNull(), F.when(fresh, F.lit(0)).otherwise(s["gap"] + 1)).otherwise(F.lit(0)).alias("gap"),
        )

    return F.aggregate(xs, start, step)


def _entering(maps: Column, alpha: float | Smoothing) -> Column:
    """The average and the gap that the maps of the blocks before leave."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("g"))

    def step(s: Column, m: Column) -> Column:
        c = _weight(alpha, s["g"] + m["lead"])
        first = F.when(s["y"].isNull(), m["first"]).otherwise(c * s["y"] + (1 - c) * m["first"])
        y = F.when(m["first"].isNull(), s["y"]).otherwise(m["c"] * first + m["d"])
        return F.struct(y.alias("y"), F.when(m["first"].isNull(), s["g"] + m["lead"]).otherwise(m["gap"]).alias("g"))

    return F.aggregate(maps, start, step)


def averaged(blocks: Blocks, wanted: dict[str, tuple[str, float | Smoothing]]) -> Blocks:
    """With an array of exponential averages for each name: of an array column, by its alpha."""
    nothing = (F.lit(None).cast("double"), F.lit(0))
    if not blocks.long:
        return blocks.let(**{name: _run(F.col(xs), alpha, *nothing) for name, (xs, alpha) in wanted.items()})
    rows = written(blocks.rows, "series-level")
    maps = F.struct(*(_map(F.col(xs), alpha).alias(name) for name, (xs, alpha) in wanted.items()))
    # A row a block, a few numbers each: the chain of a series is one short fold.
    behind = Window.partitionBy(blocks.key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chain = rows.select(blocks.key, "_block", maps.alias("_map")).withColumn("_maps", F.collect_list("_map").over(behind))
    enter = F.struct(*(_entering(F.col("_maps")[n], alpha).alias(n) for n, (_, alpha) in wanted.items()))
    carried = chain.select(F.struct(blocks.key, "_block").alias("_key"), enter.alias("_enter"))
    joined = rows.withColumn("_key", F.struct(blocks.key, "_block")).join(carried, "_key").drop("_key")
    new = {name: _run(F.col(xs), alpha, F.col("_enter")[name]["y"], F.col("_enter")[name]["g"]) for name, (xs, alpha) in wanted.items()}
    return Blocks(joined.withColumns(new).drop("_enter"), blocks.key, True, blocks.columns)


def as_bars(blocks: Blocks, outputs: dict[str, str]) -> DataFrame:
    """The bars again, with an output column for each array column."""
    zipped = F.explode(F.arrays_zip(F.col("_rows"), *(F.col(a).alias(f"_o{k}") for k, a in enumerate(outputs.values())))).alias("_z")
    flat = blocks.rows.select(zipped)
    return flat.select(*(F.col("_z._rows")[c].alias(c) for c in blocks.columns), *(F.col(f"_z._o{k}").alias(o) for k, o in enumerate(outputs)))
