"""Jump consistent hashing of documents to shards, with DataFrame functions only.

The shard of a row depends on its key and on the number of shards, on nothing else: no ring table,
no shuffle and no state. Going from n to n + 1 shards moves a row only into the new shard, and
moves about 1 / (n + 1) of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.storage import attached, documents, saved

#: Fixed values of the published algorithm (Lamping and Veach, 2014): the multiplier of its linear
#: congruential generator, split into high and low 32 bits.
MULTIPLIER = 2862933555777941757
_MULT_HI, _MULT_LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW = 0xFFFFFFFF


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, in halves of 32 bits so that no product overflows."""
    low16, high16 = lo.bitwiseAND(F.lit(0xFFFF)), F.shiftright(lo, 16)
    # lo * MULT_LO is below 2**64, so it is built from 16-bit parts of lo, each product below 2**48.
    a = low16 * F.lit(_MULT_LO) + F.lit(1)
    b = high16 * F.lit(_MULT_LO)
    low_sum = a.bitwiseAND(F.lit(_LOW)) + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(a, 32) + F.shiftright(b, 16) + F.shiftright(low_sum, 32)
    # Of the cross products only the low 32 bits count.
    cross = [
        (low16 * F.lit(_MULT_HI)).bitwiseAND(F.lit(_LOW)),
        F.shiftleft((high16 * F.lit(_MULT_HI)).bitwiseAND(F.lit(0xFFFF)), 16),
        (hi.bitwiseAND(F.lit(0xFFFF)) * F.lit(_MULT_LO)).bitwiseAND(F.lit(_LOW)),
        F.shiftleft((F.shiftright(hi, 16) * F.lit(_MULT_LO)).bitwiseAND(F.lit(0xFFFF)), 16),
    ]
    high = reduce(lambda x, y: x + y, cross, carry).bitwiseAND(F.lit(_LOW))
    return high, low_sum.bitwiseAND(F.lit(_LOW))


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard (0 to n_shards - 1) of a 64-bit key; a null key counts as 0.

    A key jumps about ln(n_shards) times, so a fold of few steps nearly always ends; after the last jump it keeps its state. The bucket rises with
    every jump, so n_shards further steps, which only a key that has not ended takes, suffice for all.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_LOW)).alias("lo"),
        F.lit(-1).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        # (key >> 33) + 1 are the upper 31 bits of the high half.
        jump = F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["jump"].alias("bucket"), jump.alias("jump"))
        return F.when(s["jump"] < n_shards, moved).otherwise(s)

    few = min(n_shards, 16 + 4 * n_shards.bit_length())
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    if few == n_shards:
        return F.aggregate(steps(few), start, step, lambda s: s["bucket"]).cast("int")
    rest = lambda s: F.aggregate(steps(n_shards), s, step, lambda z: z["bucket"])
    return F.aggregate(steps(few), start, step, lambda s: F.when(s["jump"] >= n_shards, s["bucket"]).otherwise(rest(s))).cast("int")


def with_slots(df: DataFrame, shard: str, key: str, tie: str, rows_per_block: int = 5_000) -> DataFrame:
    """Adds slot: 0, 1, 2 ... within each shard without gaps.

    Rows are numbered in blocks of about rows_per_block (blocks by a hash of key and tie, so a shard of any size is
    spread over many tasks); a running count of the blocks of a shard gives each block its first slot.
    Repeated rows get different slots; where they would fill a block, they are parted by their numbers (_row of df).
    """
    counts = saved(df.groupBy(shard).agg(F.count("*").alias("_rows")), "sharding-counts")
    alike = df.groupBy(key, tie).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_block)
    alike = saved(alike.select(tie).distinct().withColumn("_many", F.lit(True)), "sharding-alike")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_block)).cast("long")
    rows = attached(attached(df, counts, [shard]), alike, [tie], "left")
    part = F.pmod(F.xxhash64(key, tie, F.when(F.col("_many"), F.col("_row"))), blocks)
    keyed = saved(rows.withColumn("_block", part).drop("_rows", "_many"), "sharding-blocks")
    per_block = keyed.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_block.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_block").orderBy(key, tie, "_row")
    return (
        attached(keyed.withColumn("_at", F.row_number().over(inside) - 1), saved(firsts, "sharding-firsts"), [shard, "_block"])
        .withColumn("slot", (F.col("_first") + F.col("_at")).cast("long"))
        .drop("_first", "_at", "_block", "_row")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, rows_per_block: int = 5_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide. A null text has size 1 and the checksum of an
    empty text; a null doc_id has the shard of key 0; repeated rows share a shard and get different slots.
    An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_shard(F.col("doc_id"), n_shards).alias("shard"),
        jump_shard(F.col("doc_id"), n_shards + 1).alias("grown_shard"),
    )
    # The narrow rows are read three times below, the texts once.
    narrow = narrow.withColumn("_row", F.monotonically_increasing_id())
    rows = with_slots(saved(narrow, "sharding"), "shard", "doc_id", "text_crc32", rows_per_block)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_documents() of all documents to 8 shards. Nulls, ties and repeated rows as there."""
    return shard_documents(documents(spark, sf_dir))
