"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots. Bytes are added up per slot, and a versioned
map says which shard a slot belongs to. Rebalancing writes the next version of the map: slots stay where they are
as long as their shard has room, so only records of moved slots move.

A slot that alone is a sizeable part of a shard (``SPLIT`` of its mean) is mapped lane by lane; a lane is a second
hash over id and size. Slot, lane and map sizes are bounded by ``n_slots * LANES`` whatever the data.

Defined results: a null text has no bytes; a null id hashes by the text's checksum instead. Rows equal in id and size
share slot and lane and so cannot be told apart. An empty table gives a map without slots and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.llm.frames import stored

N_SLOTS = 4096
LANES = 16
#: A slot above this part of the mean bytes of a shard is mapped by lane.
SPLIT = 1 / 8
#: Bytes a record takes besides its text.
RECORD_BYTES = 16


def _hash(key: Column, modulus: int) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, lane of each row."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    return sized.select(
        "*",
        _hash(key.cast("binary"), n_slots).alias("virtual_slot"),
        _hash(F.concat_ws(":", key, F.col("size").cast("string")).cast("binary"), LANES).alias("lane"),
    )


def slot_bytes(slots: DataFrame, n_shards: int) -> DataFrame:
    """virtual_slot, lane, bytes, rows: one row per slot, or per lane of a slot too large to move as one (lane -1: all lanes)."""
    lanes = slots.groupBy("virtual_slot", "lane").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # at most n_slots * LANES rows reach the windows
    slot, everything = F.sum("bytes").over(W.partitionBy("virtual_slot")), F.sum("bytes").over(W.partitionBy())
    unit = F.when(slot > everything * (SPLIT / n_shards), F.col("lane")).otherwise(-1)
    return (
        lanes.select("virtual_slot", unit.alias("unit"), "bytes", "rows")
        .groupBy("virtual_slot", F.col("unit").alias("lane"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    )


def _deal(units: Column, loads: Column, room: Column | None) -> Column:
    """Fold over units, largest first: (loads, placed, left). With ``room`` a unit goes home while its shard has room
    and is left otherwise; without, it goes to the least loaded shard."""

    def step(acc: Column, unit: Column) -> Column:
        if room is None:
            to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
            fits = F.lit(True)
        else:
            to = unit["home"]
            fits = F.coalesce(F.get(acc["loads"], to) + unit["bytes"] <= room, F.lit(False))
        grown = F.transform(acc["loads"], lambda v, i: F.when(fits & (i == to), v + unit["bytes"]).otherwise(v))
        put = F.struct(unit["virtual_slot"].alias("virtual_slot"), unit["lane"].alias("lane"), unit["bytes"].alias("bytes"), to.alias("shard"))
        return F.struct(
            grown.alias("loads"),
            F.when(fits, F.array_append(acc["placed"], put)).otherwise(acc["placed"]).alias("placed"),
            F.when(fits, acc["left"]).otherwise(F.array_append(acc["left"], unit)).alias("left"),
        )

    placed = "array<struct<virtual_slot:int,lane:int,bytes:bigint,shard:int>>"
    left = "array<struct<neg:bigint,virtual_slot:int,lane:int,bytes:bigint,home:int>>"
    start = F.struct(loads.alias("loads"), F.array().cast(placed).alias("placed"), F.array().cast(left).alias("left"))
    return F.aggregate(units, start, step)


def shard_map(units: DataFrame, n_shards: int, version: int = 1, current: DataFrame | None = None, slack: float = 0.02) -> DataFrame:
    """version, virtual_slot, lane, bytes, shard: a map of shards near equal in bytes.

    With ``current`` (the map before), units keep their shard while it stays within the mean and ``slack``;
    the rest go, largest first, to the least loaded shard. All in one row of at most n_slots * LANES units.
    """
    home = F.lit(None).cast("int").alias("home")
    if current is not None:
        by_lane = current.where("lane >= 0").select("virtual_slot", "lane", F.col("shard").alias("lane_home"))
        whole = current.where("lane < 0").select("virtual_slot", F.col("shard").alias("slot_home"))
        units = units.join(by_lane, ["virtual_slot", "lane"], "left").join(whole, "virtual_slot", "left")
        home = F.coalesce("lane_home", "slot_home").alias("home")
        home = F.when(home < n_shards, home).alias("home")
    unit = F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", F.col("lane").cast("int").alias("lane"), "bytes", home)
    one = units.agg(F.sort_array(F.collect_list(unit)).alias("units"), F.sum("bytes").alias("total")).where("total is not null")
    zero = F.array_repeat(F.lit(0).cast("long"), n_shards)
    kept = one.select("total", _deal(F.col("units"), zero, F.col("total") / n_shards * (1 + slack)).alias("kept"))
    full = kept.select(F.col("kept.placed").alias("stay"), _deal(F.col("kept.left"), F.col("kept.loads"), None)["placed"].alias("go"))
    rows = full.select(F.explode(F.concat("stay", "go")).alias("u"))
    return rows.select(F.lit(version).alias("version"), "u.virtual_slot", "u.lane", "u.bytes", "u.shard")


def write_map(shards: DataFrame, folder: str) -> None:
    """Add a version of the map to ``folder``; versions already there stay."""
    shards.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The named version, or the newest."""
    every = spark.read.parquet(folder)
    wanted = version if version is not None else every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == wanted).select("version", "virtual_slot", "lane", "bytes", "shard")


def place(slots: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of ``slotted`` with their shard and their slot there: 0, 1, 2, ... in every shard, without gaps.

    Counts per lane give each lane its first number; within a lane rows are numbered by id and checksum.
    """
    # both sides of these joins have at most n_slots * LANES rows
    lanes = slots.groupBy("virtual_slot", "lane").agg(F.count("*").alias("rows"))
    split = shards.where("lane >= 0").select("virtual_slot", "lane", F.col("shard").alias("lane_shard"))
    whole = shards.where("lane < 0").select("virtual_slot", F.col("shard").alias("slot_shard"))
    numbered = W.partitionBy("shard").orderBy("virtual_slot", "lane")
    lanes = (
        lanes.join(F.broadcast(split), ["virtual_slot", "lane"], "left")
        .join(F.broadcast(whole), "virtual_slot", "left")
        .select("virtual_slot", "lane", "rows", F.coalesce("lane_shard", "slot_shard").alias("shard"))
        .select("virtual_slot", "lane", "shard", (F.sum("rows").over(numbered) - F.col("rows")).alias("first"))
    )
    within = W.partitionBy("virtual_slot", "lane").orderBy("doc_id", "text_crc32", "size")
    return (
        slots.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(lanes), ["virtual_slot", "lane"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), "virtual_slot")
    )


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, virtual_slot of every row, by the newest map in ``folder`` or a new one."""
    slots = stored(slotted(docs, n_slots), "slots")
    if folder is None:
        shards = stored(shard_map(slot_bytes(slots, n_shards), n_shards).coalesce(1), "shard-map")
    else:
        shards = read_map(docs.sparkSession, folder)
    return place(slots, shards)
