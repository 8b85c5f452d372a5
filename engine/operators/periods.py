"""Problem 1: the continuous periods of each entity and the gaps between them.

`continuous` merges closed ranges in two levels, so that an entity with any share of the rows is never one task's work:

1. `session_window` with each row's own length merges the ranges of one (entity, bucket of start time). Its windows are
   half-open and whole microseconds lie next to each other, so the time scale is doubled: [2s, 2e + 1) and
   [2(e + 1), ...) do not touch, [2s, 2e + 1) and [2e, ...) do.
2. Of each bucket only its latest end is carried along the entity; a partial period opens a new period when it starts
   after every earlier end. The windows over entities see one row per bucket that has rows.

Defined results: a row with a null time or an end before its start is left out; a null entity is an entity of its own;
repeated rows, instants (start = end) and ranges that share one instant fall into one period; an empty table gives no
row; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.sources.tables import micros, table

#: Ranges are first merged among those that start in the same bucket of this length.
BUCKET_US = 6 * 3600 * 1_000_000


def continuous(df: DataFrame, keys: list[str], start: str, end: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Rows (kind, keys..., start_us, end_us) from ranges whose `start` and `end` are microseconds."""
    k = [f"k{i}" for i in range(len(keys))]
    r = df.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(start).alias("s"), F.col(end).alias("e"))
    r = r.where("s IS NOT NULL AND e IS NOT NULL AND e >= s").withColumn("b", F.expr(f"s div {bucket_us}"))
    own = F.session_window(F.expr("timestamp_micros(2 * s)"), F.expr("concat(2 * (e - s) + 1, ' microseconds')"))
    part = r.groupBy(*k, "b", own.alias("w")).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("w")

    along = Window.partitionBy(*k).orderBy("b")
    carried = part.groupBy(*k, "b").agg(F.max("e").alias("be")).select(
        *k, "b", F.max("be").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("be").over(Window.partitionBy(*k)).alias("last_end")
    )
    within = Window.partitionBy(*k, "b").orderBy("s")
    heads = _join(part, carried, [*k, "b"]).withColumn("until", F.greatest("carry", F.lag("e").over(within))).where("until IS NULL OR s > until")
    # All that lies between two heads belongs to the first, so the second's `until` is the first one's end.
    first = heads.groupBy(*k, "b").agg(F.min_by("until", "s").alias("fu")).withColumn("next_until", F.lead("fu").over(along)).drop("fu")
    ended = _join(heads, first, [*k, "b"]).withColumn("e", F.coalesce(F.lead("until").over(within), "next_until", "last_end"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_us"), F.col("e").alias("end_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("until").alias("start_us"), F.col("s").alias("end_us")),
    )
    out = ended.select(*k, F.explode(rows).alias("r")).where("r.start_us IS NOT NULL")
    return out.select("r.kind", *(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), "r.start_us", "r.end_us")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A null-safe equi-join that keeps the left columns and the right ones that are not keys."""
    other = right.select(*(F.col(c).alias(f"{c}_") if c in on else F.col(c) for c in right.columns))
    return left.join(other, [left[c].eqNullSafe(other[f"{c}_"]) for c in on]).drop(*(f"{c}_" for c in on))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of nodes and the flushes of regions as (entity, entity_id, start_us, end_us)."""
    parts = [
        table(spark, sf_dir, name).select(F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), micros("start_time").alias("start_us"), micros("end_time").alias("end_us"))
        for name, entity, key in (("capture_blocks", "node", "node_id"), ("block_meta", "region", "region_id"))
    ]
    return parts[0].unionAll(parts[1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous(ranges(spark, sf_dir), ["entity", "entity_id"], "start_us", "end_us")


SQL = """
WITH r AS (
  SELECT 'node' AS entity, node_id AS entity_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e FROM capture_blocks
  UNION ALL SELECT 'region', region_id, epoch_us(start_time), epoch_us(end_time) FROM block_meta),
v AS (SELECT * FROM r WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY entity, entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head FROM v),
g AS (SELECT *, sum(head) OVER (PARTITION BY entity, entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT entity, entity_id, n, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT 'period' AS kind, entity, entity_id, s AS start_us, e AS end_us FROM p
UNION ALL
SELECT 'gap', a.entity, a.entity_id, a.e, b.s FROM p a JOIN p b ON a.entity = b.entity AND a.entity_id = b.entity_id AND b.n = a.n + 1
"""
