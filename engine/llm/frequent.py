"""Problem 5: the most frequent values of a column, by combinatorial group testing.

Every value falls into one bucket in each of DEPTH rows; a bucket keeps the total of its values and, for each of the
64 bits, the total of those with that bit set. If one value has more than half of a bucket, the bits with more than
half of the total spell it. Sketches are filled per partition, added up by Spark (with partial sums before the
shuffle) and decoded; a last pass over the rows counts the decoded candidates exactly and drops false ones.

A value with a share of SHARE is lost only if in all rows the others of its bucket together reach its own count. The
others' expected share of a bucket is 1 / WIDTH, so by Markov one row fails with at most 1 / (SHARE * WIDTH) and all of
them with that to the power DEPTH: 0.0977 ** 7 = 8.5e-8 a value, and at most 1 / SHARE values can have that share.

Memory: DEPTH * WIDTH * 65 counters of 8 bytes a field and task (3.7 MB), whatever the number of distinct values.

Defined results: null is no value but its row belongs to the total; ties and repeated rows count; empty tables give no
row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.sources.tables import table

FIELDS = ("srcip", "dstip", "dstport")
SHARE, DEPTH, WIDTH, BITS = 0.01, 7, 1024, 64
#: Values of a field that a task collects before it counts them.
PENDING = 1 << 19


def _bucket(u, row: int, width: int):
    """A 64-bit mix of the value and the row's own odd constant (the finaliser of splitmix64), reduced to a bucket."""
    import numpy as np

    z = (u + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(2 * row + 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(20)).astype(np.int64) % width


def sketch(df: DataFrame, fields: tuple[str, ...], depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(f, d, bucket, total, b0 .. b63); d = -1 holds the number of rows."""
    bucket_of, bits, pending = _bucket, BITS, PENDING

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros((len(fields), depth, width, bits + 1), dtype=np.int64)
        waiting: list[list] = [[] for _ in fields]
        n_rows = 0

        def count(f):
            if not waiting[f]:
                return
            values, times = np.unique(np.concatenate(waiting[f]), return_counts=True)
            waiting[f] = []
            u, w = values.view(np.uint64), times.astype(np.float64)
            used = int(np.bitwise_or.reduce(u)) if len(u) else 0
            for d in range(depth):
                at = bucket_of(u, d, width)
                counts[f, d, :, bits] += np.bincount(at, w, width).astype(np.int64)
                for j in range(used.bit_length()):
                    on = (u >> np.uint64(j)) & np.uint64(1) == 1
                    counts[f, d, :, j] += np.bincount(at[on], w[on], width).astype(np.int64)

        for batch in batches:
            n_rows += batch.num_rows
            for f in range(len(fields)):
                waiting[f].append(batch.column(f).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                if sum(map(len, waiting[f])) >= pending:
                    count(f)
        names = ["f", "d", "bucket", "total", *(f"b{j}" for j in range(bits))]
        for f in range(len(fields)):
            count(f)
            if n_rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((f, pa.int32()), (-1, pa.int32()), (0, pa.int32()), (n_rows, pa.int64()))] + [pa.array([0], pa.int64())] * bits, names=names)
            for d in range(depth):
                at = np.flatnonzero(counts[f, d, :, bits])
                if len(at):
                    own = counts[f, d, at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)) for x in (f, d)] + [pa.array(at.astype(np.int32)), pa.array(own[:, bits].copy())] + [pa.array(own[:, j].copy()) for j in range(bits)], names=names)

    schema = "f int, d int, bucket int, total bigint, " + ", ".join(f"b{j} bigint" for j in range(BITS))
    parts = df.select(*(F.col(c).cast("bigint").alias(f"v{i}") for i, c in enumerate(fields))).mapInArrow(fill, schema)
    return parts.groupBy("f", "d", "bucket").agg(*(F.sum(c).alias(c) for c in ("total", *(f"b{j}" for j in range(BITS)))))


def decode(sketches: DataFrame, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """(f, item, approx_count, n_rows): the items that a bucket spells and whose count in every row is large enough. One group a field, of fixed size."""
    bucket_of, bits = _bucket, BITS

    def read(t):
        import numpy as np
        import pyarrow as pa

        c = {n: t.column(n).to_numpy() for n in t.schema.names}
        rows = c["d"] < 0
        n = int(c["total"][rows].sum())
        heavy = ~rows & (c["total"] >= share * n)
        spelled = np.zeros(int(heavy.sum()), dtype=np.uint64)
        for j in range(bits):
            spelled |= (2 * c[f"b{j}"][heavy] > c["total"][heavy]).astype(np.uint64) << np.uint64(j)
        items = np.unique(spelled)
        totals = {(int(d), int(b)): int(x) for d, b, x in zip(c["d"], c["bucket"], c["total"], strict=True)}
        least = [min((totals.get((d, int(bucket_of(items[i : i + 1], d, width)[0])), 0) for d in range(int(c["d"].max()) + 1)), default=0) for i in range(len(items))]
        keep = [i for i, x in enumerate(least) if x >= share * n]
        f = int(c["f"][0])
        return pa.table({"f": pa.array([f] * len(keep), pa.int32()), "item": pa.array(items.view(np.int64)[keep], pa.int64()), "approx_count": pa.array([least[i] for i in keep], pa.int64()), "n_rows": pa.array([n] * len(keep), pa.int64())})

    return sketches.groupBy("f").applyInArrow(read, "f int, item bigint, approx_count bigint, n_rows bigint")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's frequent values with the sketch's count (never too small) and the exact one."""
    rows = table(spark, sf_dir, "flow_index")
    likely = decode(sketch(rows, FIELDS))  # at most DEPTH / SHARE rows a field
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("bigint").alias("item")) for i, c in enumerate(FIELDS)))).alias("v")).select("v.*").where("item IS NOT NULL")
    exact = cells.join(F.broadcast(likely), ["f", "item"]).groupBy("f", "item", "n_rows", "approx_count").agg(F.count("*").alias("exact_count"))
    name = F.element_at(F.array(*(F.lit(c) for c in FIELDS)), F.col("f") + 1)
    return exact.where(F.col("exact_count") >= SHARE * F.col("n_rows")).select(name.alias("field"), "item", "approx_count", "exact_count", "n_rows")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select("field", "item")


SQL = """
WITH v AS (SELECT 'srcip' AS field, srcip AS item FROM flow_index UNION ALL SELECT 'dstip', dstip FROM flow_index UNION ALL SELECT 'dstport', CAST(dstport AS BIGINT) FROM flow_index)
SELECT field, item FROM v WHERE item IS NOT NULL GROUP BY field, item HAVING count(*) * 100 >= (SELECT count(*) FROM flow_index)
"""
