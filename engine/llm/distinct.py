"""Problem 7: distinct counts over huge sets, from set registers with logarithmic levels.

A sketch has M registers. An item chooses one register and a level that exceeds k with probability BASE ** -k; a
register keeps the largest level. Sketches are merged by maximum, so day, node and set-of-nodes sketches come from the
same partial results, and Spark's partial aggregation keeps the registers, never the items. The base tunes the
registers: the nearer to 1, the more levels and the smaller the joint estimates' error.

With items a register arriving as a Poisson process the likelihood of the registers is known exactly (also for small
sets, whose registers are partly empty), so all estimates are maximum likelihood:

* number n: relative standard error about 1 / sqrt(M) = 1.6 %;
* intersection of two sets, and with it union and Jaccard index J: from the numbers of registers that are greater,
  less and equal, given both n; the standard error of J is about sqrt(J * (1 - J) / M), at most 0.8 points.

Pairs of sets are compared only if they share the top item (register, level) in two of GROUPS groups of registers;
two sets share a top item with probability J, so a pair with J of 1/3 is missed with (2/3)**48 * (1 + 24) = 9e-8. That
holds for sets that fill all groups. Two sets of at most SMALL used registers are therefore also compared if half as
many registers agree as J of 1/3 asks for. A shared item is seen unless an item of only one set hides it in its register:
for one shared item beside two others 2.4e-4, and less for more shared items, as half of them must be hidden.

Defined results: rows with a null time or item are left out; repeated rows change nothing; a null node is a node of its
own in the daily numbers but in no pair; empty tables give no row; other columns are ignored.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.sources.tables import micros, table

M, BASE, GROUPS, SMALL = 4096, 1.08, 48, 512
PEAK, OVERLAP = 2.0, 0.75


def register(item: str, m: int = M) -> Column:
    return F.xxhash64(item).bitwiseAND(F.lit(m - 1)).cast("int")


def level(item: str, base: float = BASE) -> Column:
    """1 or more; from the 52 bits of the hash that do not choose the register."""
    import math

    u = (F.shiftrightunsigned(F.xxhash64(item), 12) + 0.5) / float(2**52)
    return (F.floor(-F.log(u) / math.log(base)) + 1).cast("smallint")


def registers(df: DataFrame, by: list, item: str) -> DataFrame:
    """(by..., reg, lev): the sketch of each group, a row for each register in use."""
    return df.groupBy(*by, register(item).alias("reg")).agg(F.max(level(item)).alias("lev"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "reg").agg(F.max("lev").alias("lev"))


def _rates(levels, counts, base, m):
    """Maximum likelihood items a register for each row of counts (sets x levels): bisection on the logarithm."""
    import numpy as np

    y, x = base ** -levels, base ** -(levels - 1)
    empty = m - counts.sum(1)
    right = empty + counts @ y
    lo, hi = np.full(len(counts), -40.0), np.full(len(counts), 60.0)
    for _ in range(90):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            left = (counts * ((x - y) / np.expm1(np.minimum(np.exp(mid)[:, None] * (x - y), 700)))).sum(1)
        up = left > right
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(counts.sum(1) > 0, np.exp((lo + hi) / 2), 0.0)


def _joint(a, b, la, lb, base, m):
    """(n_a, n_b, n_both) by maximum likelihood, from the two sets' registers (dense arrays of levels) and their rates."""
    import numpy as np

    top = int(max(a.max(), b.max(), 1))
    levels = np.arange(1, top + 1, dtype=float)
    more, less = int((a > b).sum()), int((a < b).sum())
    y, x = base**-levels, base ** -(levels - 1)

    def fit(lj):  # more precisely: the log-likelihood of greater, less, equal; levels beyond the top by their first order
        both = np.exp(-(la + lb - lj) * x)
        p = max(1e-300, float((np.exp(-(la - lj) * y - lb * x) - both).sum() + (la - lj) * y[-1]))
        q = max(1e-300, float((np.exp(-(lb - lj) * y - la * x) - both).sum() + (lb - lj) * y[-1]))
        return more * np.log(p) + less * np.log(q) + (m - more - less) * np.log(max(1e-300, 1 - p - q))

    lo, hi, g = 0.0, min(la, lb), (5**0.5 - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = fit(c), fit(d)
    for _ in range(60):
        if fc >= fd:
            hi, d, fd = d, c, fc
            c = hi - g * (hi - lo)
            fc = fit(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + g * (hi - lo)
            fd = fit(d)
    return la * m, lb * m, (lo + hi) / 2 * m


def number(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n): the estimated number of distinct items of each sketch."""
    base, m, rates = BASE, M, _rates

    @F.pandas_udf("double")
    def estimate(levels: pd.Series, counts: pd.Series) -> pd.Series:
        import numpy as np

        top = max((int(x.max()) for x in levels), default=1)
        c = np.zeros((len(levels), top))
        for i, (x, k) in enumerate(zip(levels, counts, strict=True)):
            c[i, np.asarray(x) - 1] = k
        return pd.Series(rates(np.arange(1, top + 1, dtype=float), c, base, m) * m)

    histogram = sketches.groupBy(*by, "lev").agg(F.count("*").alias("c"))
    lists = histogram.groupBy(*by).agg(F.collect_list(F.struct(F.col("lev").cast("int").alias("lev"), "c")).alias("h"))  # a row a level, some hundreds at most
    return lists.select(*by, estimate(F.col("h.lev"), F.col("h.c")).alias("n"))


def alike(sketches: DataFrame, node: str) -> DataFrame:
    """(a, b) with a < b: the pairs of nodes that share the top item in two groups of registers or more, or, if both are small, enough registers."""
    item = F.struct("lev", "reg")
    used = F.count("*").over(Window.partitionBy(node))  # M registers at most
    top = F.max(item).over(Window.partitionBy(node, F.col("reg") % GROUPS)) == item
    items = sketches.select(node, "reg", "lev", used.alias("used"), top.alias("top")).where(F.col("top") | (F.col("used") <= SMALL))
    a, b = (items.select(F.col(node).alias(n), "reg", "lev", F.col("used").alias(f"u{n}"), F.col("top").alias(f"t{n}")) for n in "ab")
    shared = a.join(b, ["reg", "lev"]).where("a < b").groupBy("a", "b", "ua", "ub").agg(F.count_if(F.col("ta") & F.col("tb")).alias("tops"), F.count("*").alias("n"))
    small = (F.greatest("ua", "ub") <= SMALL) & (F.col("n") >= (1 - OVERLAP) / 2 * (F.col("ua") + F.col("ub")))
    return shared.where((F.col("tops") >= 2) | small).select("a", "b")


def compared(sketches: DataFrame, pairs: DataFrame, node: str) -> DataFrame:
    """(a, b, n_a, n_b, n_union, n_both, jaccard) of the given pairs."""
    base, m, joint, rates = BASE, M, _joint, _rates

    @F.pandas_udf("double")
    def rate(levels: pd.Series) -> pd.Series:
        import numpy as np

        top = max((int(x.max()) for x in levels), default=1)
        counts = np.array([np.bincount(x, minlength=top + 1)[1:] for x in levels], dtype=float).reshape(-1, top)
        return pd.Series(rates(np.arange(1, top + 1, dtype=float), counts, base, m))

    @F.pandas_udf("n_a double, n_b double, n_both double")
    def together(ra: pd.Series, ka: pd.Series, la: pd.Series, rb: pd.Series, kb: pd.Series, lb: pd.Series) -> pd.DataFrame:
        import numpy as np

        def dense(r, k):
            d = np.zeros(m, dtype=np.int64)
            d[np.asarray(r)] = k
            return d

        return pd.DataFrame([joint(dense(w, x), dense(y, z), u, v, base, m) for w, x, u, y, z, v in zip(ra, ka, la, rb, kb, lb, strict=True)], columns=["n_a", "n_b", "n_both"])

    whole = sketches.groupBy(node).agg(F.collect_list(F.struct("reg", F.col("lev").cast("int").alias("lev"))).alias("s"))  # M registers at most
    whole = whole.withColumn("rate", rate("s.lev"))
    a, b = (whole.select(F.col(node).alias(n), F.col("s").alias(f"s{n}"), F.col("rate").alias(f"r{n}")) for n in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", together("sa.reg", "sa.lev", "ra", "sb.reg", "sb.lev", "rb").alias("t")).select("a", "b", "t.*")
    both = both.withColumn("n_union", F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return both.withColumn("jaccard", F.col("n_both") / F.col("n_union"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial results: the sketch of each UTC day and node."""
    rows = table(spark, sf_dir, "flow_index").where("ts IS NOT NULL AND srcip IS NOT NULL")
    day = F.date_from_unix_date(F.expr("floor(us / 86400000000)").cast("int"))
    return registers(rows.select(micros("ts").alias("us"), "node_id", "srcip").withColumn("day", day), ["day", "node_id"], "srcip")


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily numbers with their stated standard error."""
    n = number(daily(spark, sf_dir), ["day", "node_id"])
    return n.select(F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "node_id", F.col("n").alias("n_sources"), (F.col("n") / M**0.5).alias("standard_error"))


def _met(days: DataFrame) -> DataFrame:
    """The similar pairs of nodes that have rows on a common day."""
    seen = days.groupBy("node_id").agg(F.collect_set("day").alias("days"))  # a node's days
    a, b = (seen.select(F.col("node_id").alias(n), F.col("days").alias(f"d{n}")) for n in "ab")
    pairs = alike(merged(days, ["node_id"]), "node_id").join(a, "a").join(b, "b").where(F.arrays_overlap("da", "db")).select("a", "b")
    return compared(merged(days, ["node_id"]), pairs, "node_id")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and Jaccard index of the nodes' sources over all days, for the pairs of alike nodes."""
    return _met(daily(spark, sf_dir)).withColumn("jaccard_error", F.sqrt(F.col("jaccard") * (1 - F.col("jaccard")) / M))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily(spark, sf_dir)
    n = number(days, ["day", "node_id"]).withColumn("median", F.percentile("n", F.lit(0.5)).over(Window.partitionBy("node_id")))  # one row a day and node
    peaks = n.where(F.col("n") >= PEAK * F.col("median")).select(F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "node_id", F.lit(0).cast("bigint").alias("other_node_id"))
    a, b, both = (F.round(n) for n in ("n_a", "n_b", "n_both"))  # numbers of items are whole: few items at the threshold stay in
    close = _met(days).where(a + b - both <= OVERLAP * (a + b))
    return peaks.unionAll(close.select(F.lit("").alias("day_utc"), F.col("a").alias("node_id"), F.col("b").alias("other_node_id")))


SQL = """
WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS d, node_id AS n, srcip AS s FROM flow_index WHERE ts IS NOT NULL AND srcip IS NOT NULL),
day AS (SELECT d, n, count(DISTINCT s) AS c FROM r GROUP BY d, n),
med AS (SELECT n, median(c) AS m FROM day GROUP BY n),
own AS (SELECT DISTINCT n, s FROM r),
tot AS (SELECT n, count(*) AS c FROM own GROUP BY n),
met AS (SELECT DISTINCT x.n AS a, y.n AS b FROM day x JOIN day y ON x.d = y.d AND x.n < y.n),
both_ AS (SELECT x.n AS a, y.n AS b, count(*) AS c FROM own x JOIN own y ON x.s = y.s AND x.n < y.n GROUP BY 1, 2)
SELECT d AS day_utc, n AS node_id, CAST(0 AS BIGINT) AS other_node_id FROM day JOIN med USING (n) WHERE c >= 2 * m
UNION ALL
SELECT '', met.a, met.b FROM met JOIN both_ USING (a, b) JOIN tot t ON t.n = met.a JOIN tot u ON u.n = met.b WHERE t.c + u.c - both_.c <= 0.75 * (t.c + u.c)
"""
