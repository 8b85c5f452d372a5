"""Problem 3: has this key been seen before?

`keep_firsts` runs both tables as one stream into a keyed state store on disk (RocksDB), partitioned by key, with
checkpoints in the shared folder, without watermark, so nothing expires. The state of a key is its earliest record.
Partial aggregation reduces every micro-batch to one row per key before it is shuffled, so a key with a third of all
rows is one row per task. An earliest record is a minimum, so the answers do not depend on how files fall into
micro-batches. Memory holds RocksDB's caches only; the keys are on disk.

`answers` reads the state back: a record is first if the state names it, else a repeat. The answers are exact, which
`rate` measures against a batch computation over all records.

Defined results: a record with a null (or something that is no address) in its key is no case and no earlier
occurrence; repeated ids of one origin with one key count as one record; empty tables give no row.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.net import packed
from engine.session import shared_dir
from engine.sources.tables import table

KEY = ["pair", "ports", "wide"]
ORIGINS = ("flow_index", "flow_arrivals")
#: Bounds a micro-batch; any value gives the same answers.
BYTES_PER_BATCH = 256 << 30
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _v4(src: Column, dst: Column) -> Column:
    return F.shiftleft(src, 32).bitwiseOR(dst)


def _ports() -> Column:
    return F.shiftleft(F.col("sp").cast("bigint"), 32).bitwiseOR(F.col("dp").cast("bigint"))


def index_records(df: DataFrame) -> DataFrame:
    """(origin, id, pair, ports, wide) of flow_index: two 32-bit addresses in one BIGINT."""
    rows = df.select(F.col("seq").alias("id"), "srcip", "dstip", F.col("srcport").alias("sp"), F.col("dstport").alias("dp")).dropna()
    rows = rows.where(" AND ".join(f"{c} BETWEEN 0 AND {2**32 - 1}" for c in ("srcip", "dstip")))
    return rows.select(F.lit(0).alias("origin"), "id", _v4(F.col("srcip"), F.col("dstip")).alias("pair"), _ports().alias("ports"), F.lit("").alias("wide"))


def arrival_records(df: DataFrame) -> DataFrame:
    """The same of flow_arrivals, addresses by value; keys with an IPv6 address stand in `wide` as hexadecimal digits."""
    rows = df.select(F.col("arrival_id").alias("id"), packed("source_address").alias("s"), packed("destination_address").alias("d"), F.col("source_port").alias("sp"), F.col("destination_port").alias("dp")).dropna()
    short = (F.length("s") == 4) & (F.length("d") == 4)
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("bigint")
    return rows.select(
        F.lit(1).alias("origin"), "id", F.when(short, _v4(number("s"), number("d"))).otherwise(F.lit(0)).alias("pair"), _ports().alias("ports"),
        F.when(short, "").otherwise(F.concat_ws("-", F.hex("s"), F.hex("d"))).alias("wide"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_records(table(spark, sf_dir, ORIGINS[0])).unionAll(arrival_records(table(spark, sf_dir, ORIGINS[1])))


def _stream(spark: SparkSession, sf_dir: str, name: str, bytes_per_batch: int) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    pattern = f"{sf_dir}/{name}.[p]arquet"  # a table may be one file, which a stream takes only as a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(pattern)


def keep_firsts(spark: SparkSession, stream: DataFrame, checkpoint: str) -> None:
    """Feeds all available records (origin, id, KEY) into the state under `checkpoint`; a later call goes on where the last one ended."""
    mine = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        own = lambda o: F.when(F.col("origin") == o, F.col("id"))
        # The state names its values by function only: the second minimum is held as the maximum of the complement.
        kept = stream.groupBy(*KEY).agg(F.min(own(0)).alias("first_0"), F.max(F.bitwise_not(own(1))).alias("first_1"))
        kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def firsts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(origin, id) of every key's earliest record, from the state."""
    value = spark.read.format("statestore").load(checkpoint).select("value.min", "value.max")
    return value.select(F.when(F.col("min").isNotNull(), 0).otherwise(1).alias("origin"), F.coalesce("min", F.bitwise_not("max")).alias("id"))


def answers(spark: SparkSession, sf_dir: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """(origin, id) of the repeats."""
    at = shared_dir(spark, "seen")
    both = index_records(_stream(spark, sf_dir, ORIGINS[0], bytes_per_batch)).unionAll(arrival_records(_stream(spark, sf_dir, ORIGINS[1], bytes_per_batch)))
    keep_firsts(spark, both, at)
    return records(spark, sf_dir).select("origin", "id").join(firsts(spark, at), ["origin", "id"], "left_anti")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("origin") == 0, ORIGINS[0]).otherwise(ORIGINS[1])
    return answers(spark, sf_dir).select(name.alias("origin"), F.col("id").alias("record_id"))


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrong answers of the state, over all records, against a sort of all of them by key."""
    first = F.min(F.struct("origin", "id")).over(Window.partitionBy(*KEY))
    true = records(spark, sf_dir).withColumn("before", F.struct("origin", "id") > first).select("origin", "id", "before")
    said = answers(spark, sf_dir).withColumn("yes", F.lit(True))
    both = true.join(said, ["origin", "id"], "left").withColumn("yes", F.coalesce("yes", F.lit(False)))
    wrong = F.count_if(F.col("yes") != F.col("before"))
    return both.agg(F.count("*").alias("n_records"), F.count_if(F.col("yes")).alias("n_repeats"), F.count_if(F.expr("yes AND NOT before")).alias("wrong_yes"), F.count_if(F.expr("before AND NOT yes")).alias("wrong_no"), F.coalesce(wrong / F.count("*"), F.lit(0.0)).alias("wrong_rate"))
