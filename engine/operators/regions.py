"""The regions' write path: validation, lifecycle, typed rows, row sizes, block cuts, block metadata and pruning.

All queries read the whole table `region_requests` or `block_meta`. Ordered folds (lifecycle, block cut) run over sorted
partitions with constant state: only admin requests are folded for the lifecycle; a memtable starts anew at OPEN, so
blocks are cut for each (region, epoch), where an epoch is the time from an OPEN to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engine.operators.changes import split_json
from engine.sources.tables import micros, table

#: Usage limit of a memtable and what an empty one of the columns id, value, description takes (names and 4 a column).
THRESHOLD, HEADER = 1024, 30
#: A block's fixed head, and the head for three columns: types, sizes, name offsets, names.
BLOCK_HEAD, COLUMN_HEAD = 56, 86
WORKERS, AGENTS, RANGE = 2, 4, 1 << 16
FROM_US, TO_US = 1_641_204_000_000_000, 1_641_207_600_000_000


def validated(requests: DataFrame) -> DataFrame:
    """Adds `reason`: null for a request that can be carried out."""
    missing = lambda *cs: F.greatest(*(F.col(c).isNull() for c in cs)) if len(cs) > 1 else F.col(cs[0]).isNull()
    return requests.withColumn(
        "reason",
        F.when(F.col("req_type").isNull() | ~F.col("req_type").isin("WRITE", "ADMIN"), "type")
        .when(missing("region_id"), "region_id")
        .when(F.col("req_type") == "WRITE", F.when(missing("ts"), "timestamp").when(missing("json_data"), "json_data"))
        .when(F.col("operation").isNull() | ~F.col("operation").isin("CREATE", "OPEN", "CLOSE", "DROP"), "operation")
        .when((F.col("operation") == "CREATE") & missing("region_name", "expr", "attrs"), "create_fields"),
    )


def request_validation(spark, sf_dir):
    return validated(table(spark, sf_dir, "region_requests")).select("request_id", F.coalesce("reason", F.lit("")).alias("reason"))


def request_ids(spark, sf_dir):
    """The place of each request in its file."""
    n = F.row_number().over(Window.partitionBy("file_name").orderBy("request_id"))
    return table(spark, sf_dir, "region_requests").select("request_id", "file_name", n.cast("bigint").alias("place"))


def region_route(spark, sf_dir):
    """Each region's worker and engine."""
    r = table(spark, sf_dir, "region_requests").where("region_id IS NOT NULL").groupBy("region_id").agg(F.count("*").alias("n_requests"))
    return r.withColumn("worker", F.pmod("region_id", F.lit(WORKERS))).withColumn("engine", F.lit("main"))


def lifecycle(requests: DataFrame) -> DataFrame:
    """(request_id, region_id, operation, accepted, state, epoch) of the valid admin requests: the state after each, and the number of OPENs so far."""
    admin = validated(requests).where("reason IS NULL AND req_type = 'ADMIN'").select("request_id", "region_id", "operation")
    allowed = {("ABSENT", "CREATE"): "CLOSED", ("CLOSED", "OPEN"): "OPEN", ("OPEN", "CLOSE"): "CLOSED", ("CLOSED", "DROP"): "ABSENT"}

    def fold(batches):
        import pyarrow as pa

        region, state, epoch = None, "ABSENT", 0
        for b in batches:
            out = []
            for q, r, op in zip(*(b.column(c).to_pylist() for c in ("request_id", "region_id", "operation")), strict=True):
                if r != region:
                    region, state, epoch = r, "ABSENT", 0
                after = allowed.get((state, op))
                state = after or state
                epoch += after == "OPEN"
                out.append((q, r, op, after is not None, state, epoch))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["request_id", "region_id", "operation", "accepted", "state", "epoch"])

    ordered = admin.repartition("region_id").sortWithinPartitions("region_id", "request_id")
    return ordered.mapInArrow(fold, "request_id bigint, region_id bigint, operation string, accepted boolean, state string, epoch bigint")


def region_lifecycle(spark, sf_dir):
    return lifecycle(table(spark, sf_dir, "region_requests"))


def admitted(requests: DataFrame) -> DataFrame:
    """(request_id, region_id, epoch, us, cells): the valid writes that meet an open region, by an as-of look-up.

    Requests are windowed in ranges of RANGE ids of a region; what a range begins with comes from a window over ranges.
    """
    states = lifecycle(requests).select("request_id", "region_id", F.struct("state", "epoch").alias("now"))
    wr = validated(requests).where("reason IS NULL AND req_type = 'WRITE'").select("request_id", "region_id", micros("ts").alias("us"), "json_data")
    rng = F.expr(f"request_id div {RANGE}")
    last = states.groupBy("region_id", rng.alias("part")).agg(F.max_by("now", "request_id").alias("end"))
    parts = wr.select("region_id", rng.alias("part")).distinct().join(last, ["region_id", "part"], "full")
    along = Window.partitionBy("region_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("region_id", "part", F.last("end", ignorenulls=True).over(along).alias("begin"))
    both = wr.withColumn("now", F.lit(None).cast("struct<state:string,epoch:bigint>")).unionByName(states.select("*", F.lit(None).cast("bigint").alias("us"), F.lit(None).cast("string").alias("json_data")))
    seen = F.last("now", ignorenulls=True).over(Window.partitionBy("region_id", "part").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1))
    known = both.withColumn("part", rng).withColumn("seen", seen).where("json_data IS NOT NULL").join(begins, ["region_id", "part"])
    state = F.coalesce("seen", "begin")
    return known.withColumn("s", state).where("s.state = 'OPEN'").select("request_id", "region_id", F.col("s.epoch").alias("epoch"), "us", split_json("json_data").alias("cells"))


def region_catalog_join(spark, sf_dir):
    """How many valid writes each region has, and how many met it open."""
    r = table(spark, sf_dir, "region_requests")
    total = validated(r).where("reason IS NULL AND req_type = 'WRITE'").groupBy("region_id").agg(F.count("*").alias("n_writes"))
    return total.join(admitted(r).groupBy("region_id").agg(F.count("*").alias("n_admitted")), "region_id", "left").withColumn("n_admitted", F.coalesce("n_admitted", F.lit(0)))


def sized(writes: DataFrame) -> DataFrame:
    """Adds fixed_bytes, var_bytes (of all fields given, declared or not), stored_bytes and typed: whether every value is a number or a string."""
    number = lambda f: F.size(F.filter("cells", f)).cast("bigint")
    numeric, text = number(lambda c: c["type"] != "string"), number(lambda c: c["type"] == "string")
    var = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.when(c["type"] == "string", F.octet_length(c["value"])).otherwise(0))
    ok = (F.size("cells") > 0) & ~F.exists("cells", lambda c: c["type"].isNull())
    return writes.withColumn("fixed_bytes", 8 + 8 * numeric).withColumn("var_bytes", var).withColumn("stored_bytes", 8 * numeric + 16 * text).withColumn("typed", ok)


def request_fields(spark, sf_dir):
    """The typed fields of every admitted write."""
    w = admitted(table(spark, sf_dir, "region_requests"))
    return w.select("request_id", F.explode("cells").alias("c")).select("request_id", F.col("c.field").alias("field"), F.col("c.type").alias("type"))


def region_row_size(spark, sf_dir):
    """The size of every admitted row; a row beyond the threshold is refused."""
    s = sized(admitted(table(spark, sf_dir, "region_requests"))).where("typed")
    return s.select("request_id", (F.col("fixed_bytes") + F.col("var_bytes")).alias("row_bytes"), (F.col("fixed_bytes") + F.col("var_bytes") <= THRESHOLD).alias("fits"))


def blocks(rows: DataFrame, threshold: int = THRESHOLD, header: int = HEADER) -> DataFrame:
    """Adds block to (request_id, region_id, epoch, size, ...): a row that would take the memtable beyond the threshold opens the next block."""
    schema = rows.withColumn("block", F.lit(0).cast("bigint")).schema

    def cut(batches):
        import pyarrow as pa

        at, block, usage = None, 0, 0
        for b in batches:
            out = []
            for r, e, size in zip(*(b.column(c).to_pylist() for c in ("region_id", "epoch", "size")), strict=True):
                if (r, e) != at:
                    at, block, usage = (r, e), 0, header
                elif usage + size > threshold:
                    block, usage = block + 1, header
                usage += size
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "block"])

    return rows.repartition("region_id", "epoch").sortWithinPartitions("region_id", "epoch", "request_id").mapInArrow(cut, schema)


def _cut(spark, sf_dir):
    s = sized(admitted(table(spark, sf_dir, "region_requests"))).where("typed").withColumn("size", F.col("fixed_bytes") + F.col("var_bytes"))
    return blocks(s.where(F.col("size") <= THRESHOLD).select("request_id", "region_id", "epoch", "us", "size", "var_bytes", "stored_bytes"))


def region_blocks(spark, sf_dir):
    return _cut(spark, sf_dir).select("request_id", "region_id", "epoch", "block")


def block_table(cut: DataFrame) -> DataFrame:
    m = cut.groupBy("region_id", "epoch", "block").agg(F.count("*").alias("row_count"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.sum("var_bytes").alias("var_bytes"), (F.sum("stored_bytes") + F.sum("var_bytes") + BLOCK_HEAD + COLUMN_HEAD).alias("disk_bytes"))
    before = F.sum("disk_bytes").over(Window.partitionBy("region_id").orderBy("epoch", "block").rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("file_offset", F.coalesce(before, F.lit(0)))


def region_block_meta(spark, sf_dir):
    return block_table(_cut(spark, sf_dir))


def _meta(spark, sf_dir):
    return table(spark, sf_dir, "block_meta").select("region_id", "block_id", "file_name", "file_offset", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), "row_count", "disk_bytes").distinct()


def region_block_prune(spark, sf_dir):
    """The blocks a query over a time range has to read, and those it can skip, by region."""
    hit = (F.col("start_us") <= TO_US) & (F.col("end_us") >= FROM_US)
    m = _meta(spark, sf_dir).where("start_us IS NOT NULL AND end_us IS NOT NULL AND end_us >= start_us")
    return m.groupBy("region_id").agg(F.count_if(hit).alias("n_read"), F.count_if(~hit).alias("n_skipped"), F.coalesce(F.sum(F.when(hit, F.col("disk_bytes"))), F.lit(0)).alias("bytes_read"))


def block_meta_line(spark, sf_dir):
    return _meta(spark, sf_dir).dropna().select("region_id", "block_id", F.concat_ws(",", "file_name", "file_offset", "start_us", "end_us").alias("line"))


def block_bounds(spark, sf_dir):
    """Blocks that reach beyond the place where the next one of their file starts."""
    m = _meta(spark, sf_dir).where("file_offset IS NOT NULL AND disk_bytes IS NOT NULL").groupBy("file_name", "file_offset").agg(F.max("disk_bytes").alias("disk_bytes"))
    nxt = F.lead("file_offset").over(Window.partitionBy("file_name").orderBy("file_offset"))
    return m.withColumn("next_offset", nxt).groupBy("file_name").agg(F.count("*").alias("n_blocks"), F.max(F.col("file_offset") + F.col("disk_bytes")).alias("file_bytes"), F.count_if(F.col("file_offset") + F.col("disk_bytes") > F.col("next_offset")).alias("n_overlapping"))


def block_agent_route(spark, sf_dir):
    c = table(spark, sf_dir, "capture_blocks").where("block_id IS NOT NULL").select("node_id", "block_id").distinct()
    return c.groupBy("node_id", F.pmod("block_id", F.lit(AGENTS)).alias("agent")).agg(F.count("*").alias("n_blocks"))


def raw_block_range(spark, sf_dir):
    """The bytes' places of the blocks 10 to 19 of each node."""
    return table(spark, sf_dir, "capture_blocks").where("block_id >= 10 AND block_id < 20").select("node_id", "block_id", "write_pos").distinct()


def _beats(spark, sf_dir):
    h = table(spark, sf_dir, "heartbeats").where("node_id <> '' AND ts IS NOT NULL").groupBy("node_id").agg(F.max(micros("ts")).alias("last_us"))
    return h.withColumn("alive", F.max("last_us").over(Window.partitionBy(F.lit(0))) - F.col("last_us") <= 15_000_000)  # one row a node


def node_liveness(spark, sf_dir):
    return _beats(spark, sf_dir)


def nodes_json(spark, sf_dir):
    return _beats(spark, sf_dir).select(F.to_json(F.struct(F.col("node_id").alias("id"), "alive")).alias("node"))


QUERIES = {
    f.__name__: f
    for f in (
        request_validation, request_ids, region_route, region_lifecycle, region_catalog_join, request_fields, region_row_size, region_blocks, region_block_meta, region_block_prune,
        block_meta_line, block_bounds, block_agent_route, raw_block_range, node_liveness, nodes_json,
    )
}
_VALID = """WITH RECURSIVE v AS (SELECT *, CASE WHEN req_type IS NULL OR req_type NOT IN ('WRITE', 'ADMIN') THEN 'type' WHEN region_id IS NULL THEN 'region_id'
  WHEN req_type = 'WRITE' THEN CASE WHEN ts IS NULL THEN 'timestamp' WHEN json_data IS NULL THEN 'json_data' END
  WHEN operation IS NULL OR operation NOT IN ('CREATE', 'OPEN', 'CLOSE', 'DROP') THEN 'operation'
  WHEN operation = 'CREATE' AND (region_name IS NULL OR expr IS NULL OR attrs IS NULL) THEN 'create_fields' END AS reason FROM region_requests),"""
_NEXT = "CASE WHEN {s} = 'ABSENT' AND a.operation = 'CREATE' THEN 'CLOSED' WHEN {s} = 'CLOSED' AND a.operation = 'OPEN' THEN 'OPEN' WHEN {s} = 'OPEN' AND a.operation = 'CLOSE' THEN 'CLOSED' WHEN {s} = 'CLOSED' AND a.operation = 'DROP' THEN 'ABSENT' END"
_LIFE = _VALID + f"""
a AS (SELECT request_id, region_id, operation, row_number() OVER (PARTITION BY region_id ORDER BY request_id) AS n FROM v WHERE reason IS NULL AND req_type = 'ADMIN'),
l AS (SELECT request_id, region_id, operation, n, {_NEXT.format(s="'ABSENT'")} IS NOT NULL AS accepted, coalesce({_NEXT.format(s="'ABSENT'")}, 'ABSENT') AS state, CAST(0 AS BIGINT) AS epoch FROM a WHERE n = 1
  UNION ALL SELECT a.request_id, a.region_id, a.operation, a.n, {_NEXT.format(s="l.state")} IS NOT NULL, coalesce({_NEXT.format(s="l.state")}, l.state), l.epoch + CASE WHEN {_NEXT.format(s="l.state")} = 'OPEN' THEN 1 ELSE 0 END FROM l JOIN a ON a.region_id = l.region_id AND a.n = l.n + 1)"""
_ADMIT = _LIFE + """,
w AS (SELECT v.request_id, v.region_id, l.epoch, epoch_us(v.ts) AS us, v.json_data FROM v ASOF JOIN l ON v.region_id = l.region_id AND v.request_id > l.request_id WHERE v.reason IS NULL AND v.req_type = 'WRITE' AND l.state = 'OPEN'),
c AS (SELECT request_id, region_id, epoch, us, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END AS type, e.atom AS atom, e.value AS value FROM w, json_each(w.json_data) e WHERE json_valid(w.json_data)),
z AS (SELECT request_id, region_id, epoch, us, CAST(8 + 8 * count(*) FILTER (type <> 'string') AS BIGINT) AS fixed_bytes, CAST(coalesce(sum(strlen(value ->> '$')) FILTER (type = 'string'), 0) AS BIGINT) AS var_bytes, CAST(8 * count(*) FILTER (type <> 'string') + 16 * count(*) FILTER (type = 'string') AS BIGINT) AS stored_bytes FROM c GROUP BY 1, 2, 3, 4)"""
_BLOCKS = _ADMIT + f""",
o AS (SELECT *, fixed_bytes + var_bytes AS size, row_number() OVER (PARTITION BY region_id, epoch ORDER BY request_id) AS n FROM z WHERE fixed_bytes + var_bytes <= {THRESHOLD}),
b AS (SELECT o.*, CAST(0 AS BIGINT) AS block, {HEADER} + size AS used FROM o WHERE n = 1
  UNION ALL SELECT o.*, b.block + CASE WHEN b.used + o.size > {THRESHOLD} THEN 1 ELSE 0 END, CASE WHEN b.used + o.size > {THRESHOLD} THEN {HEADER} + o.size ELSE b.used + o.size END FROM b JOIN o ON o.region_id = b.region_id AND o.epoch = b.epoch AND o.n = b.n + 1)"""
_BM = "WITH m AS (SELECT DISTINCT region_id, block_id, file_name, file_offset, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, row_count, disk_bytes FROM block_meta)"
_ALIVE = "SELECT node_id, last_us, max(last_us) OVER () - last_us <= 15000000 AS alive FROM (SELECT node_id, max(epoch_us(ts)) AS last_us FROM heartbeats WHERE node_id <> '' AND ts IS NOT NULL GROUP BY 1)"
SQL = {
    "request_validation": _VALID + " x AS (SELECT 1) SELECT request_id, coalesce(reason, '') AS reason FROM v",
    "request_ids": "SELECT request_id, file_name, row_number() OVER (PARTITION BY file_name ORDER BY request_id) AS place FROM region_requests",
    "region_route": f"SELECT region_id, count(*) AS n_requests, region_id % {WORKERS} AS worker, 'main' AS engine FROM region_requests WHERE region_id IS NOT NULL GROUP BY 1",
    "region_lifecycle": _LIFE + " SELECT request_id, region_id, operation, accepted, state, epoch FROM l",
    "region_catalog_join": _ADMIT + " SELECT region_id, count(*) AS n_writes, count(w.request_id) AS n_admitted FROM v LEFT JOIN w USING (request_id, region_id) WHERE reason IS NULL AND req_type = 'WRITE' GROUP BY 1",
    "request_fields": _ADMIT + " SELECT request_id, field, type FROM c",
    "region_row_size": _ADMIT + f" SELECT request_id, fixed_bytes + var_bytes AS row_bytes, fixed_bytes + var_bytes <= {THRESHOLD} AS fits FROM z",
    "region_blocks": _BLOCKS + " SELECT request_id, region_id, epoch, block FROM b",
    "region_block_meta": _BLOCKS + f""", m AS (SELECT region_id, epoch, block, count(*) AS row_count, min(us) AS start_us, max(us) AS end_us, CAST(sum(var_bytes) AS BIGINT) AS var_bytes, CAST(sum(stored_bytes + var_bytes) + {BLOCK_HEAD + COLUMN_HEAD} AS BIGINT) AS disk_bytes FROM b GROUP BY 1, 2, 3)
SELECT *, CAST(coalesce(sum(disk_bytes) OVER (PARTITION BY region_id ORDER BY epoch, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM m""",
    "region_block_prune": _BM + f" SELECT region_id, count(*) FILTER (start_us <= {TO_US} AND end_us >= {FROM_US}) AS n_read, count(*) FILTER (NOT (start_us <= {TO_US} AND end_us >= {FROM_US})) AS n_skipped, CAST(coalesce(sum(disk_bytes) FILTER (start_us <= {TO_US} AND end_us >= {FROM_US}), 0) AS BIGINT) AS bytes_read FROM m WHERE end_us >= start_us GROUP BY 1",
    "block_meta_line": _BM + " SELECT region_id, block_id, concat_ws(',', file_name, file_offset, start_us, end_us) AS line FROM m WHERE region_id IS NOT NULL AND block_id IS NOT NULL AND file_name IS NOT NULL AND file_offset IS NOT NULL AND start_us IS NOT NULL AND end_us IS NOT NULL AND row_count IS NOT NULL AND disk_bytes IS NOT NULL",
    "block_bounds": _BM + ", f AS (SELECT file_name, file_offset, max(disk_bytes) AS disk_bytes FROM m WHERE file_offset IS NOT NULL AND disk_bytes IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, lead(file_offset) OVER (PARTITION BY file_name ORDER BY file_offset) AS nx FROM f) SELECT file_name, count(*) AS n_blocks, max(file_offset + disk_bytes) AS file_bytes, count(*) FILTER (file_offset + disk_bytes > nx) AS n_overlapping FROM n GROUP BY 1",
    "block_agent_route": f"SELECT node_id, block_id % {AGENTS} AS agent, count(*) AS n_blocks FROM (SELECT DISTINCT node_id, block_id FROM capture_blocks WHERE block_id IS NOT NULL) GROUP BY 1, 2",
    "raw_block_range": "SELECT DISTINCT node_id, block_id, write_pos FROM capture_blocks WHERE block_id >= 10 AND block_id < 20",
    "node_liveness": _ALIVE,
    "nodes_json": f"SELECT CAST(json_object('id', node_id, 'alive', alive) AS VARCHAR) AS node FROM ({_ALIVE})",
}
