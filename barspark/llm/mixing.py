"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document i of source s gets a rate r_i, the expected number of its copies in the mix. Of all rates that give
source s its target of words, the chosen ones are closest to taking every document once, in relative entropy
that weighs each document by w_i:

    minimise   sum_i w_i (r_i log r_i - r_i)     subject to   sum_(i in s) size_i r_i = target_s,   0 <= r_i <= MAX_COPIES

with w_i = size_i / x_i and the token measure x_i = 1 + log(1 + size_i) / (1 + log(1 + largest)). Setting the derivative
w_i log r_i - lambda_s size_i to zero gives the exponential tilt r_i = min(MAX_COPIES, exp(lambda_s x_i)). As x is between 1 and
2, a document of 20,000 words is tilted at most twice as strongly, in the exponent, as one of a single word. The
convex dual has one multiplier a source; Newton iterations solve it, and each one is a pass of partial sums over the
distinct sizes of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.storage import attached, discard, documents, saved

MAX_COPIES = 3
#: A run of characters other than the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target for a table with a row (source, source_size) for each source.

    Sources are ordered by code point, null last, and weigh 1, 2, 3 in turn. A target stops at MAX_COPIES times
    the source's size; what is over goes to the others by weight, until none is above. Filling is the same as finding
    the level t with sum(min(3 size, weight t)) = total: sources by rising 3 size / weight are capped one by one,
    so a running sum over that order finds the level without a loop. The order needs all sources in one task: a narrow row a source,
    which streams through sorts that spill.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1).withColumn("_weight", pick.cast("double"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(MAX_COPIES))
    full = Window.orderBy(F.col("_cap") / F.col("_weight"), "_n")
    upto, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double")).withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_weight").over(rest),
    )
    # The level is right from the first source on that stays under its cap.
    candidate = F.struct((F.col("_cap") / F.col("_weight")).alias("at"), "_n", F.col("_level").alias("level"))
    under = F.col("_level") * F.col("_weight") <= F.col("_cap")
    found = levels.withColumn("_found", F.min(F.when(under, candidate)).over(everything)["level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_found"), F.lit(float("inf"))) * F.col("_weight"))
    return found.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _rate(multiplier: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.lit(50.0), multiplier * F.col("_x"))))


def _key(source: Column) -> Column:
    """A key that is never null: the null source and the empty one differ."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def solve_rates(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-6, most_iterations: int = 200) -> DataFrame:
    """_key, _multiplier: the solution of the dual for every source, by safeguarded Newton iterations.

    sizes has a row (_key, size, _x, _times) for the documents of a source with equal size. The steps are those of the logarithm of
    the words, which is nearly linear in the multiplier; a step that leaves the bracket is replaced by its middle, so the bracket of width
    120 halves at least every second time and all sources converge. Only the largest error comes to the driver. Sources that do not
    reach the tolerance after most_iterations raise an error.
    """
    none = F.lit(None).cast("double")
    state = saved(
        targets.select(
            "_key",
            "target",
            # Equal tilt of all documents is the first guess.
            F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("source_size"))).otherwise(0.0).alias("_multiplier"),
            F.lit(-60.0).alias("_low"),
            F.lit(60.0).alias("_high"),
            none.alias("_error"),
        ),
        "mixing-state",
    )
    for k in range(most_iterations):
        rate = _rate(F.col("_multiplier"))
        words = F.col("_times") * F.col("size") * rate
        slope = F.when(rate < MAX_COPIES, words * F.col("_x")).otherwise(0.0)
        sums = attached(sizes, state, ["_key"]).groupBy("_key").agg(F.sum(words).alias("_words"), F.sum(slope).alias("_slope"))
        over = F.coalesce(F.col("_words"), F.lit(0.0)) - F.col("target")
        done = F.abs(over) <= tolerance * F.col("target")
        low = F.when(over <= 0, F.col("_multiplier")).otherwise(F.col("_low"))
        high = F.when(over > 0, F.col("_multiplier")).otherwise(F.col("_high"))
        newton = F.col("_multiplier") - F.try_divide(F.col("_words") * F.log(F.try_divide("_words", "target")), F.col("_slope"))
        # Every second step halves the bracket if the other one did not get far.
        inside = newton.isNotNull() & (newton > low) & (newton < high) & (F.lit(k % 2 == 0) | (F.abs(over) <= 0.5 * F.col("_error") * F.col("target")) | F.col("_error").isNull())
        older, state = state, saved(
            attached(state, sums, ["_key"], "left").select(
                "_key",
                "target",
                F.when(done, F.col("_multiplier")).when(inside, newton).otherwise((low + high) / 2).alias("_multiplier"),
                low.alias("_low"),
                high.alias("_high"),
                F.try_divide(F.abs(over), F.col("target")).alias("_error"),
            ),
            "mixing-state",
        )
        discard(older)
        worst = state.agg(F.max(F.when(F.col("target") > 0, F.col("_error")))).first()[0]
        if worst is None or worst <= tolerance:
            return state.select("_key", "_multiplier")
    raise RuntimeError(f"the multipliers did not converge: a source is off by {worst:.2g} of its target")


def _copies(rows: DataFrame, rows_per_block: int) -> DataFrame:
    """Rounds rates to whole copies by systematic sampling along each source's documents in order of size.

    Blocks (source, class of sizes, part by hash) have about rows_per_block rows, whatever their source or id; running sums over the
    blocks carry the rates from one to the next. So the copies of the first k documents of a source differ from the sum of their rates by less than
    one, and the words taken by about one document.
    """
    kind = ["_key", "_class"]
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    counts = saved(rows.groupBy(*kind).agg(F.ceil(F.count("*") / rows_per_block).cast("long").alias("_parts")), "mixing-classes")
    # Rows that are alike in id and text would all be in one part; where they fill one, their numbers part them.
    alike = rows.groupBy("doc_id", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_block)
    alike = saved(alike.select("_hash").distinct().withColumn("_many", F.lit(True)), "mixing-alike")
    rows = attached(attached(rows, counts, kind), alike, ["_hash"], "left")
    part = F.pmod(F.xxhash64("doc_id", "_hash", F.when(F.col("_many"), F.col("_row")), F.lit(7)), F.col("_parts"))
    rows = saved(rows.withColumn("_part", part).drop("_parts", "_many"), "mixing-blocks")
    sums = rows.groupBy(*kind, "_part").agg(F.sum("_rate").alias("_sum"))
    # A row a block: the one sum whose order is that of a whole source.
    earlier = Window.partitionBy("_key").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    starts = saved(sums.select(*kind, "_part", (start + F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).alias("_start")), "mixing-starts")
    block = Window.partitionBy(*kind, "_part").orderBy("size", "doc_id", "_hash", "_row")
    upto = F.sum("_rate").over(block.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_rate").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumns({"_upto": upto, "_before": before})
    rows = attached(rows, starts, [*kind, "_part"])
    at = lambda c: F.floor(F.col("_start") + F.col(c) + 1e-9)
    copies = F.when(F.col("size") > 0, F.least(F.lit(MAX_COPIES), at("_upto") - at("_before"))).otherwise(1)
    return rows.withColumn("_copies", F.greatest(F.lit(0), copies).cast("long")).drop("_upto", "_before", "_start")


def _moves(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """_row, _move: copies to add (or, if negative, to take) so that what is left of each source's gap fits no document any more.

    Sizes are tried from the largest that fits downwards, as many copies of each as fit and as there are; once passed, a size can never fit
    again, so one fold over the distinct sizes within the gap finds all moves. That gap is about one document, so a source has no more
    entries than its longest document has words, whatever its number of documents.
    """
    taken = rows.groupBy("_key").agg(F.sum(F.col("size") * F.col("_copies")).alias("_taken"))
    gaps = saved(attached(targets, taken, ["_key"]).select("_key", (F.col("target") - F.col("_taken")).alias("_gap")), "mixing-gaps")
    room = F.when(F.col("_gap") > 0, MAX_COPIES - F.col("_copies")).otherwise(F.col("_copies"))
    fit = attached(rows, gaps, ["_key"]).where((F.col("size") > 0) & (F.col("size") <= F.abs("_gap"))).withColumn("_room", room).where("_room > 0")
    sizes = fit.groupBy("_key", "size").agg(F.sum("_room").alias("n"), F.first("_gap").alias("_gap"))
    lists = sizes.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("_sizes"), F.first("_gap").alias("_gap"))
    nothing = F.array().cast("array<struct<size:bigint,k:bigint>>")
    start = F.struct(F.abs("_gap").alias("left"), nothing.alias("moves"))

    def step(s: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor(s["left"] / x["size"]))
        move = F.array(F.struct(x["size"].alias("size"), k.alias("k")))
        return F.when(k > 0, F.struct((s["left"] - k * x["size"]).alias("left"), F.concat(s["moves"], move).alias("moves"))).otherwise(s)

    wanted = lists.select("_key", F.signum("_gap").cast("long").alias("_sign"), F.explode(F.aggregate("_sizes", start, step, lambda s: s["moves"])).alias("m"))
    wanted = saved(wanted.select("_key", "_sign", F.col("m.size").alias("size"), F.col("m.k").alias("_k")), "mixing-wanted")
    # Each block offers its first rows by hash; of what all blocks offer the first serve.
    offers = attached(fit.drop("_gap"), wanted, ["_key", "size"])
    by_hash = F.xxhash64("doc_id", "_hash", F.lit(13))
    block = Window.partitionBy("_key", "size", "_part").orderBy(by_hash, "_row")
    offers = offers.withColumn("_before", F.coalesce(F.sum("_room").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before < _k")
    every = Window.partitionBy("_key", "size").orderBy(by_hash, "_row")
    offers = offers.withColumn("_before", F.coalesce(F.sum("_room").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before < _k")
    return offers.select("_row", (F.col("_sign") * F.least("_room", F.col("_k") - F.col("_before"))).alias("_move"))


def mix(docs: DataFrame, rows_per_block: int = 5_000, text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate, source, and row, a number of its own.

    size counts the words (null text: 0), taken = size * copies. No document has more than MAX_COPIES copies.
    Documents without words get no tilt and are kept once (taken 0). A null source is a source of its own, the
    last one. Repeated rows are documents of their own; ties of size are ordered by doc_id, then by row. Empty
    tables give empty results; reruns over the same files agree. Columns other than doc_id, source and the text are ignored, but for
    one named row_number, which numbers the rows if there is one.
    """
    number = F.col("row_number") if "row_number" in docs.columns else F.monotonically_increasing_id()
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        _key(F.col("source")).alias("_key"),
        n_words(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("_hash"),
        number.alias("_row"),
    )
    # The numbers of rows are fixed once they are written.
    narrow = saved(narrow, "mixing")
    per_source = narrow.groupBy("source", "_key").agg(F.sum("size").alias("source_size"), F.max("size").alias("_largest"))
    per_source = saved(per_source, "mixing-sources")
    top = per_source.agg(F.max("_largest")).first()[0] or 1
    targets = source_targets(per_source.select("source", "source_size")).withColumn("_key", _key(F.col("source")))
    targets = saved(targets.select("_key", "source_size", "target"), "mixing-targets")
    discard(per_source)
    measure = 1 + F.log1p(F.col("size").cast("double")) / (1 + F.log1p(F.lit(float(top))))
    sizes = saved(narrow.groupBy("_key", "size").agg(F.count("*").alias("_times")).withColumn("_x", measure), "mixing-sizes")
    rates = solve_rates(sizes, targets)
    discard(sizes)
    rows = attached(narrow.withColumn("_x", measure), rates, ["_key"])
    rows = rows.withColumn("_rate", F.when(F.col("size") > 0, _rate(F.col("_multiplier"))).otherwise(1.0)).drop("_multiplier", "_x")
    rows = saved(_copies(rows, rows_per_block), "mixing-copies")
    discard(narrow)
    rows = attached(rows, saved(_moves(rows, targets), "mixing-moves"), ["_row"], "left")
    copies = F.col("_copies") + F.coalesce("_move", F.lit(0))
    return attached(rows, targets, ["_key"]).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.alias("copies"),
        F.col("_rate").alias("rate"),
        "source",
        F.col("_row").alias("row"),
    )


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents, without the numbers of rows. Nulls, empty texts, ties and repeated rows as there."""
    return mix(documents(spark, sf_dir)).drop("row")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents repeated as often as the mix takes them; documents that it takes 0 times go.

    Null and empty texts count as 0 words and stay once. Repeated rows each have their own number of copies. All columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    # Rows are numbered once, in a table, so that both readers of it agree.
    numbered = saved(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row_number")), "mixing-rows")
    mixed = mix(numbered.select("d.doc_id", "d.source", "d.text", "row_number")).where("copies > 0").select(F.col("row").alias("row_number"), "copies")
    rows = numbered.join(mixed, "row_number").select("d", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("d.*")
