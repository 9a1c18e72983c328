"""Jump consistent hashing in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.operators.ranks import quantile_bounds, with_bucket

#: Multiplier of the published generator.
_STEP = 2862933555777941757
#: Jumps are about ln(shards); a key that needed more would raise an error, not be misplaced.
_MOST_JUMPS = 128


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key: the last jump of its pseudo-random walk that stays below ``shards``.

    Going from n to n + 1 shards, a key either stays or goes to the new shard.  No table is
    kept.  The generator works modulo 2^64; decimals hold its products without overflow.
    """
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    seed = F.pmod(key.cast("long").cast("decimal(20,0)"), whole).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), seed.alias("k"))

    def step(s: Column, _: Column) -> Column:
        k = F.pmod(s["k"] * F.lit(_STEP).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"), whole).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(20,0)")).cast("long")
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), jump.alias("j"), k.alias("k"))).otherwise(s)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, _MOST_JUMPS) + 1)), start, step)
    found = F.when(walk["j"] >= shards, walk["b"]).otherwise(F.raise_error(F.lit("a key needs more jumps than allowed")))
    return found.cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes, null as none, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; 0 for null, as for no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def with_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add ``shard``, and in ``grown`` the shard with one shard more; nothing is shuffled.

    A null id is placed as id 0.  Equal ids, so also repeated rows, share a shard.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(0))
    out = docs.withColumn(shard, jump_hash(key, shards))
    return out.withColumn(grown, jump_hash(key, shards + 1)) if grown else out


def with_slots(rows: DataFrame, doc_id: str, shard: str = "shard", slot: str = "slot", ties: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in order of id, nulls last, then ``ties``.

    Ids are cut into ranges; a range is numbered by itself and shifted by the sizes of the
    earlier ranges of its shard.  The table of sizes has shards x ranges rows.
    """
    at = F.coalesce(F.col(doc_id).cast("double"), F.lit(1.7e308))
    binned = with_bucket(rows.withColumn("_at", at), "_at", quantile_bounds(rows.select(at.alias("_at")), "_at"), "_range")
    sizes = binned.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(shard, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    order = [F.col(doc_id).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    inside = F.row_number().over(Window.partitionBy(shard, "_range").orderBy(*order))
    return (
        binned.withColumn("_row", inside).join(shifts, [shard, "_range"])
        .withColumn(slot, F.col("_row") - 1 + F.col("_shift")).drop("_at", "_range", "_row", "_shift")
    )


def shard_table(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): where each document goes.

    Null text: size 1 and checksum 0.  An empty table gives no rows.  Only these narrow
    columns are shuffled.
    """
    placed = with_shards(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_size(F.col(text).cast("string")).alias("size"), text_crc32(F.col(text).cast("string")).alias("text_crc32")),
        shards,
        grown="grown_shard",
    )
    return with_slots(placed, "doc_id", ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
