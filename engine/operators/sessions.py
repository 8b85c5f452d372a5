"""Problem 6: the sessions of each key, separated by pauses.

`sessions` divides time into chunks: the rows of one (key, chunk) make local sessions, of which only start, end and
number of rows go on; then neighbouring partial sessions of a key are joined wherever the pause at the border is short
enough, over as many chunks as a session spans. A hot key is thus spread over its chunks, and what meets in one task
afterwards is at most one partial session per pause length of time, however many rows there were.

Defined results: rows with a null time or a null in the key are left out; equal times make one session; a pause of
exactly `pause_us` does not end a session; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.net import canonical
from engine.sources.tables import micros, table

FLOW = ["srcip", "dstip", "srcport", "dstport"]
PAUSE_US = 900_000_000
CHUNK_US = 4 * 3600 * 1_000_000


def sessions(df: DataFrame, keys: list[str], us: str, pause_us: int = PAUSE_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Rows (keys..., start_us, end_us, duration_us, n_events)."""
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(us).alias("s")).dropna()
    rows = rows.select(*k, F.expr(f"s div {chunk_us}").alias("chunk"), "s", F.col("s").alias("e"), F.lit(1).cast("bigint").alias("n"))
    local = _merge(rows, [*k, "chunk"], pause_us).drop("chunk")
    whole = _merge(local, k, pause_us)
    return whole.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), F.col("s").alias("start_us"), F.col("e").alias("end_us"), (F.col("e") - F.col("s")).alias("duration_us"), F.col("n").alias("n_events"))


def _merge(parts: DataFrame, by: list[str], pause_us: int) -> DataFrame:
    """Joins partial sessions (s, e, n), of which no two overlap, where the pause between them is at most `pause_us`."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    head = F.when(F.col("s") - F.lag("e").over(order) <= pause_us, 0).otherwise(1)
    numbered = parts.withColumn("head", head).withColumn("g", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("g")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with a time and a whole flow key, each (node_id, pkt_offset) once, addresses in canonical spelling."""
    rows = table(spark, sf_dir, "packets").dropna(subset=["ts", *FLOW]).dropDuplicates(["node_id", "pkt_offset"])
    return rows.select(canonical("srcip").alias("srcip"), canonical("dstip").alias("dstip"), *(F.col(c).cast("bigint").alias(c) for c in FLOW[2:]), micros("ts").alias("us"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(packets(spark, sf_dir), FLOW, "us").select(*FLOW, "start_us", "end_us", F.col("n_events").alias("n_packets"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each flow was active and idle: sessions, packets, active time and longest session."""
    s = sessions(packets(spark, sf_dir), FLOW, "us")
    return s.groupBy(*FLOW).agg(
        F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_packets"), F.sum("duration_us").alias("active_us"), F.max("duration_us").alias("longest_us"),
        (F.max("end_us") - F.min("start_us") - F.sum("duration_us")).alias("idle_us"),
    )
