"""Which files of a table may hold a key: zone maps and Bloom filters as rows, and lookups that open no other file.

A zone map is a file's least and greatest key. A Bloom filter is kept as rows (name, word, bits) of 64 bits each, so it is built by a grouped bit_or, merged by another, and asked by a join; bits of a file that no key
sets take no room. The number of places is one for all files of an index, from the rows of its largest file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.plans.lineage import cut
from frostline.sources import store
from frostline.sources.versions import file_of_row

#: Bits to a key and places to set for it: about one file in a hundred is opened in vain.
BITS_PER_KEY, PLACES = 10, 7
TILE = 1000


def zone_maps(named: DataFrame, key: str) -> DataFrame:
    """(name, low, high, n_rows) of rows with the name of their file; files of null keys alone have no zone."""
    return named.groupBy("name").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n_rows"))


def places(key: str, bits: int) -> DataFrame:
    """The places of a key in a filter of so many bits, by two hashes."""
    one, two = F.xxhash64(F.lit(1), F.col(key)), F.xxhash64(F.lit(2), F.col(key)).bitwiseOR(F.lit(1))
    at = lambda i: F.pmod(F.shiftright(one, 1) + F.shiftright(two, 8) * i, F.lit(bits)).cast("long")
    return F.array(*(at(i) for i in range(PLACES)))


def bloom_filters(named: DataFrame, key: str, bits: int) -> DataFrame:
    """(name, word, bits), combined before they are shuffled."""
    each = named.where(F.col(key).isNotNull()).select("name", F.explode(places(key, bits)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    return each.select("name", F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("name", "word").agg(F.bit_or("bit").alias("bits"))


def build_index(spark: SparkSession, data: str, key: str, uri: str) -> None:
    """Writes zones and filters of the Parquet files at data to uri, which must not be there; one scan of the key column for each."""
    named = spark.read.parquet(data).select(key, file_of_row().alias("name"))
    zone_maps(named, key).write.mode("errorifexists").parquet(f"{uri}/zones")
    zones = spark.read.parquet(f"{uri}/zones")
    bits = max(64, -(-(zones.agg(F.max("n_rows")).first()[0] or 1) * BITS_PER_KEY // 64) * 64)
    filters = bloom_filters(named, key, bits).repartitionByRange("name", "word").sortWithinPartitions("name", "word")
    filters.withColumn("n_bits", F.lit(bits).cast("long")).write.mode("errorifexists").parquet(f"{uri}/filters")
    store.create_once(spark, f"{uri}/bits.txt", str(bits))


def within(keys: DataFrame, key: str, zones: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, name) for each key and each zone (name, low, high) that it falls into.

    Keys meet tiles of so many zones first, in order of their least keys, so what is broadcast has one row for so many zones; then zones of their tile by an equi-join.
    """
    numbered = zones.where(F.col("low").isNotNull()).withColumn("tile", (F.row_number().over(Window.orderBy("low", "name")) / tile).cast("int"))  # a row per file
    tiles = numbered.groupBy("tile").agg(F.min("low").alias("tile_low"), F.max("high").alias("tile_high"))
    near = keys.select(F.col(key).alias("asked")).join(F.broadcast(tiles), F.col("asked").between(F.col("tile_low"), F.col("tile_high")))
    held = near.select("asked", "tile").join(numbered, "tile").where(F.col("asked").between(F.col("low"), F.col("high")))
    return held.select(F.col("asked").alias(key), "name")


def candidates(spark: SparkSession, uri: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, name): the files that may hold each key, by zone and filter; a null key is in none."""
    asked = within(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, spark.read.parquet(f"{uri}/zones"))
    bits = int(store.read_text(spark, f"{uri}/bits.txt"))
    each = asked.select(key, "name", F.explode(places(key, bits)).alias("at")).withColumn("word", F.shiftright("at", 6))
    hit = each.join(spark.read.parquet(f"{uri}/filters").select("name", "word", "bits"), ["name", "word"])
    hit = hit.where(F.call_function("getbit", "bits", F.col("at").bitwiseAND(F.lit(63)).cast("int")) == 1)
    # two of a key's places may be one, so places are counted as they came
    return hit.groupBy(key, "name").count().where(F.col("count") == PLACES).select(key, "name")


def lookup_indexed(spark: SparkSession, data: str, uri: str, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of data with one of the keys, projected, read from the files that may hold them and no others; the driver learns the names of those files."""
    schema = spark.read.parquet(data).schema
    names = [r.name for r in cut(candidates(spark, uri, keys, key)).select("name").distinct().collect()]
    rows = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return rows.join(keys.select(key).distinct(), key, "left_semi").select(*columns)
