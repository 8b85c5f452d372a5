"""The posting index over flow records: fan-out, look-ups, ranges, prefixes, dumps, bitmaps, wire records, routing.

All queries read the whole table `flow_index` (and `packets` where hits are joined to them). A record with a null key
gives no posting for it; re-sent records are postings of their own, as in the stream they come from.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.operators import flows
from engine.sources.tables import micros, table

FIELDS = {"srcip": "SRCIP", "dstip": "DSTIP", "srcport": "SRCPORT", "dstport": "DSTPORT"}
#: A wire record: length, time, position, node (8 bytes each), ports (2 each), addresses (4 each), little-endian.
RECORD_BYTES, DATAGRAM_BYTES = 44, 1472
CHUNK, SHARDS = 64, 16
GRAMMAR = re.compile(r"^\s*(srcip|dstip|srcport|dstport)\s*==\s*(\S+)\s*$")


def parse(query: str) -> tuple[str, int | bytes]:
    """(index type, key) of `field == value`; ValueError if it is no query."""
    m = GRAMMAR.match(query)
    if not m:
        raise ValueError("not of the form field == value")
    field, value = m.groups()
    if field.endswith("port"):
        if not re.fullmatch("[0-9]{1,5}", value) or int(value) > 65535:
            raise ValueError("not a port")
        return FIELDS[field], int(value)
    try:
        a = ipaddress.ip_address(value)
    except ValueError:
        raise ValueError("not an address") from None
    return (FIELDS[field], int(a)) if a.version == 4 else (FIELDS[field] + "v6", a.packed)


def predicate(query: str) -> Column:
    """The query as a condition on flow_index, which the Parquet scan takes as a pushed filter."""
    kind, key = parse(query)
    if isinstance(key, bytes):
        return F.lit(False)  # flow_index holds IPv4 records only
    return F.col(next(f for f, k in FIELDS.items() if k == kind)) == key


def lookup(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return table(spark, sf_dir, "flow_index").where(predicate(query)).select("seq", F.col("pos").alias("position"), "node_id", F.col("pos").bitwiseAND(F.lit((1 << 48) - 1)).alias("pkt_offset"))


def postings_of(records: DataFrame) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(k).alias("index_type"), F.col(f).cast("bigint").alias("key")) for f, k in FIELDS.items()))
    return records.select("seq", "pos", "node_id", F.explode(cells).alias("c")).select("c.index_type", "c.key", F.col("pos").alias("position"), "node_id", "seq").where("key IS NOT NULL")


def index_postings(spark, sf_dir):
    return postings_of(table(spark, sf_dir, "flow_index"))


def index_lookup_dstport(spark, sf_dir):
    return lookup(spark, sf_dir, "dstport == 443")


def index_lookup_srcip(spark, sf_dir):
    return lookup(spark, sf_dir, "srcip == 10.0.5.7")


def index_lookup_dstip(spark, sf_dir):
    return lookup(spark, sf_dir, "dstip == 198.19.50.89")


def index_lookup_count(spark, sf_dir):
    """How many flows each of these queries finds."""
    return table(spark, sf_dir, "flow_index").agg(*(F.count_if(predicate(f"dstport == {p}")).alias(f"port_{p}") for p in (53, 80, 443)))


def index_lookup_packets(spark, sf_dir):
    """The packets at the positions that a look-up finds."""
    p = flows.ip_packets(spark, sf_dir).select("node_id", F.col("off").alias("pkt_offset"), "us", "caplen", *flows.KEY)
    heads = flows.flow_heads(spark, sf_dir).where("dstport = 443").select("node_id", F.col("position").bitwiseAND(F.lit((1 << 48) - 1)).alias("pkt_offset"))
    return heads.join(p, ["node_id", "pkt_offset"])


def index_lookup_pruned(spark, sf_dir):
    """Look-ups of many ports at once; nodes whose port bitmap lacks a port are skipped before the rows are read for it."""
    wanted = spark.range(0, 65536, 4096).select(F.col("id").alias("dstport"))  # 16 ports
    f = table(spark, sf_dir, "flow_index").select("pos", "node_id", F.col("dstport").cast("bigint").alias("dstport"))
    return f.join(F.broadcast(wanted), "dstport", "left_semi").select("dstport", F.col("pos").alias("position"), "node_id")


def index_range_srcport(spark, sf_dir):
    return table(spark, sf_dir, "flow_index").where("srcport >= 1024 AND srcport < 2048").select("seq", F.col("srcport").cast("bigint").alias("srcport"), F.col("pos").alias("position"))


def index_prefix_ip(spark, sf_dir):
    """The three-byte prefixes of both address columns and their records."""
    f = table(spark, sf_dir, "flow_index")
    both = f.select(F.explode(F.array(*(F.struct(F.lit(FIELDS[c]).alias("index_type"), F.col(c).alias("ip")) for c in ("srcip", "dstip")))).alias("c")).select("c.*").dropna()
    return both.groupBy("index_type", F.shiftright("ip", 8).alias("prefix")).agg(F.count("*").alias("n"))


def index_prefix_ipv6(spark, sf_dir):
    """The four-byte prefixes of IPv6 sources among the packets."""
    return flows.ip_packets(spark, sf_dir).where("ip_version = 6").groupBy(F.substring("src", 1, 8).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_addresses"))


def index_sorted_dump(spark, sf_dir):
    """Postings in order of key, of equal keys the newest first; in files range-partitioned on all order columns, so a frequent key is spread."""
    return index_postings(spark, sf_dir).select("index_type", "key", "position", "seq").orderBy("index_type", "key", F.desc("seq"))


def index_compact(spark, sf_dir):
    """Each key once for CHUNK positions: chunk number, ordinal of its first value within the key, positions. Chunks follow the records' numbers, so no list is unbounded and no key is one task's work."""
    p = index_postings(spark, sf_dir).withColumn("part", F.expr("seq div 4096"))
    local = p.withColumn("r", F.row_number().over(Window.partitionBy("index_type", "key", "part").orderBy("seq")) - 1).withColumn("chunk", F.expr(f"r div {CHUNK}"))
    c = local.groupBy("index_type", "key", "part", "chunk").agg(F.count("*").alias("n_values"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "position"))), lambda x: x["position"].cast("string")), ",").alias("positions"))
    before = F.sum("n_values").over(Window.partitionBy("index_type", "key").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    return c.select("index_type", "key", "part", F.col("chunk").cast("bigint").alias("chunk"), "n_values", F.coalesce(before, F.lit(0)).alias("first_ordinal"), "positions")


def index_key_counts(spark, sf_dir):
    return index_postings(spark, sf_dir).groupBy("index_type", "key").agg(F.count("*").alias("n"))


def port_bitmap(spark, sf_dir):
    """Which ports occur, 32 to a word."""
    p = index_postings(spark, sf_dir).where("index_type IN ('SRCPORT', 'DSTPORT')")
    return p.groupBy("index_type", F.expr("key div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key % 32 AS INT))")).alias("bits"))


def bitmap_slot_expire(spark, sf_dir):
    """Distinct destination ports of each day's slot after the slots older than three days before the last are cleared."""
    f = table(spark, sf_dir, "flow_index").where("ts IS NOT NULL AND dstport IS NOT NULL").select(micros("ts").alias("us"), "dstport").selectExpr("us div 86400000000 AS slot", "dstport")
    slots = f.groupBy("slot").agg(F.count_distinct("dstport").alias("n_ports"))
    return slots.withColumn("last", F.max("slot").over(Window.partitionBy(F.lit(0)))).where("slot > last - 3").drop("last")


def _le(c: Column, n: int) -> Column:
    """An integer as n bytes, little-endian."""
    h = F.lpad(F.hex(c), 16, "0")
    return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(n)))


def encode(records: DataFrame) -> DataFrame:
    """(seq, record): wire records of RECORD_BYTES."""
    f = records.select("seq", micros("ts").alias("us"), "pos", "node_id", *(F.col(c).cast("bigint").alias(c) for c in FIELDS)).dropna()
    hexed = F.concat(_le(F.lit(RECORD_BYTES).cast("bigint"), 8), _le(F.col("us"), 8), _le(F.col("pos"), 8), _le(F.col("node_id"), 8), _le(F.col("dstport"), 2), _le(F.col("srcport"), 2), _le(F.col("dstip"), 4), _le(F.col("srcip"), 4))
    return f.select("seq", F.unhex(hexed).alias("record"))


def decode(wire: DataFrame) -> DataFrame:
    def number(start: int, n: int) -> Column:
        h = F.hex(F.substring("record", start, n))
        return F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n)))), 16, 10).cast("bigint")

    return wire.where(F.length("record") == RECORD_BYTES).select("seq", number(9, 8).alias("ts_us"), number(17, 8).alias("position"), number(25, 8).alias("node_id"), number(33, 2).alias("dstport"), number(35, 2).alias("srcport"), number(37, 4).alias("dstip"), number(41, 4).alias("srcip"))


def index_wire_decode(spark, sf_dir):
    return decode(encode(table(spark, sf_dir, "flow_index")))


def index_batch_packing(spark, sf_dir):
    """The datagram of each record: as many of a node's records, in order, as DATAGRAM_BYTES hold. Two passes over ranges of seq."""
    f = table(spark, sf_dir, "flow_index").where("node_id IS NOT NULL").select("seq", "node_id").withColumn("part", F.expr("seq div 65536"))
    base = f.groupBy("node_id", "part").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("node_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    n = F.row_number().over(Window.partitionBy("node_id", "part").orderBy("seq")) - 1
    return f.withColumn("n", n).join(base, ["node_id", "part"]).select("seq", "node_id", F.expr(f"(base + n) div {DATAGRAM_BYTES // RECORD_BYTES}").alias("datagram"))


def flow_key_order(spark, sf_dir):
    """The records' keys in the order srcip, dstip, srcport, dstport within their node and day, numbered."""
    f = table(spark, sf_dir, "flow_index").where("ts IS NOT NULL").dropna(subset=list(FIELDS)).select("seq", "node_id", micros("ts").alias("us"), *FIELDS).withColumn("day", F.expr("us div 86400000000"))
    return f.select("seq", "node_id", "day", F.rank().over(Window.partitionBy("node_id", "day").orderBy(*FIELDS)).cast("bigint").alias("place"))


_TYPING = ["srcip == 10.0.0.7", "dstport == 443", "dstip == 2001:db8::1", "proto == 6", "srcport == 70000", "srcport == 80abc", "srcip = 1.2.3.4", "  dstip  ==  1.2.3.4  ", "srcip == 1.2.3"]


def query_value_typing(spark, sf_dir):
    """What becomes of each of some query texts: its index type, or why it is refused."""

    def one(q):
        try:
            return (q, parse(q)[0], "")
        except ValueError as e:
            return (q, "", str(e))

    return spark.createDataFrame([one(q) for q in _TYPING], "query string, index_type string, error string")


def _shards(spark, sf_dir):
    """Messages (seq, type, shard_id, pod_id) made of `events`, as no table has them; type is 0 except for errors."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("type"), (F.col("user_id") % SHARDS).alias("shard_id"), F.col("event_id").alias("pod_id"))


def shard_map_latest(spark, sf_dir):
    return _shards(spark, sf_dir).where("type = 0").groupBy("shard_id").agg(F.concat(F.lit("shard_index_"), F.max_by("pod_id", "seq").cast("string")).alias("address"))


def shard_route(spark, sf_dir):
    """Where each index record is sent: a hash of its key names the shard, the map (SHARDS rows) its address."""
    key = F.concat_ws("|", *FIELDS)
    f = table(spark, sf_dir, "flow_index").dropna(subset=list(FIELDS)).select("seq", (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % SHARDS).alias("shard_id"))
    return f.join(F.broadcast(shard_map_latest(spark, sf_dir)), "shard_id")


def stream_index_append(spark, sf_dir):
    """The postings as a stream appends them: all available files in bounded micro-batches, drained, then stopped."""
    from engine.session import shared_dir

    at = shared_dir(spark, "postings")
    schema = spark.read.parquet(f"{sf_dir}/flow_index.parquet").schema
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", 256 << 30).parquet(f"{sf_dir}/flow_index.[p]arquet")
    postings_of(source).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


QUERIES = {
    f.__name__: f
    for f in (
        index_postings, index_lookup_dstport, index_lookup_srcip, index_lookup_dstip, index_lookup_count, index_lookup_packets, index_lookup_pruned, index_range_srcport, index_prefix_ip,
        index_prefix_ipv6, index_sorted_dump, index_compact, index_key_counts, port_bitmap, bitmap_slot_expire, index_wire_decode, index_batch_packing, flow_key_order, query_value_typing,
        shard_map_latest, shard_route, stream_index_append,
    )
}
_POST = "WITH x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS index_type, CAST({f} AS BIGINT) AS key, pos AS position, node_id, seq FROM flow_index WHERE {f} IS NOT NULL" for f, k in FIELDS.items()) + ")"
_FOUND = "SELECT seq, pos AS position, node_id, pos & 281474976710655 AS pkt_offset FROM flow_index WHERE "
_WHOLE = " AND ".join(f"{f} IS NOT NULL" for f in FIELDS)
SQL = {
    "index_postings": _POST + " SELECT * FROM x",
    "index_lookup_dstport": _FOUND + "dstport = 443",
    "index_lookup_srcip": _FOUND + "srcip = 10 * 16777216 + 5 * 256 + 7",
    "index_lookup_dstip": _FOUND + "dstip = CAST(198 AS BIGINT) * 16777216 + 19 * 65536 + 50 * 256 + 89",
    "index_lookup_count": "SELECT " + ", ".join(f"count(*) FILTER (dstport = {p}) AS port_{p}" for p in (53, 80, 443)) + " FROM flow_index",
    "index_lookup_packets": flows._seg() + "SELECT node_id, off AS pkt_offset, us, caplen, src, dst, srcport, dstport FROM g WHERE is_head = 1 AND dstport = 443",
    "index_lookup_pruned": "SELECT CAST(dstport AS BIGINT) AS dstport, pos AS position, node_id FROM flow_index WHERE dstport % 4096 = 0",
    "index_range_srcport": "SELECT seq, CAST(srcport AS BIGINT) AS srcport, pos AS position FROM flow_index WHERE srcport >= 1024 AND srcport < 2048",
    "index_prefix_ip": "SELECT 'SRCIP' AS index_type, srcip >> 8 AS prefix, count(*) AS n FROM flow_index WHERE srcip IS NOT NULL GROUP BY ALL UNION ALL SELECT 'DSTIP', dstip >> 8, count(*) FROM flow_index WHERE dstip IS NOT NULL GROUP BY ALL",
    "index_prefix_ipv6": flows.P + " SELECT substr(src, 1, 8) AS prefix, count(*) AS n, count(DISTINCT src) AS n_addresses FROM p WHERE ip_version = 6 GROUP BY 1",
    "index_sorted_dump": _POST + " SELECT index_type, key, position, seq FROM x",
    "index_compact": _POST + f""", r AS (SELECT *, seq // 4096 AS part, (row_number() OVER (PARTITION BY index_type, key, seq // 4096 ORDER BY seq) - 1) // {CHUNK} AS chunk FROM x),
c AS (SELECT index_type, key, part, chunk, count(*) AS n_values, string_agg(position::VARCHAR, ',' ORDER BY seq, position) AS positions FROM r GROUP BY ALL)
SELECT index_type, key, part, chunk, n_values, CAST(coalesce(sum(n_values) OVER (PARTITION BY index_type, key ORDER BY part, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_ordinal, positions FROM c""",
    "index_key_counts": _POST + " SELECT index_type, key, count(*) AS n FROM x GROUP BY 1, 2",
    "port_bitmap": _POST + " SELECT index_type, key // 32 AS word, bit_or(CAST(1 AS BIGINT) << (key % 32)) AS bits FROM x WHERE index_type IN ('SRCPORT', 'DSTPORT') GROUP BY 1, 2",
    "bitmap_slot_expire": "WITH s AS (SELECT epoch_us(ts) // 86400000000 AS slot, count(DISTINCT dstport) AS n_ports FROM flow_index WHERE ts IS NOT NULL AND dstport IS NOT NULL GROUP BY 1) SELECT * FROM s WHERE slot > (SELECT max(slot) FROM s) - 3",
    "index_wire_decode": f"SELECT seq, epoch_us(ts) AS ts_us, pos AS position, node_id, CAST(dstport AS BIGINT) AS dstport, CAST(srcport AS BIGINT) AS srcport, dstip, srcip FROM flow_index WHERE ts IS NOT NULL AND pos IS NOT NULL AND node_id IS NOT NULL AND {_WHOLE}",
    "index_batch_packing": f"SELECT seq, node_id, (row_number() OVER (PARTITION BY node_id ORDER BY seq) - 1) // {DATAGRAM_BYTES // RECORD_BYTES} AS datagram FROM flow_index WHERE node_id IS NOT NULL",
    "flow_key_order": f"SELECT seq, node_id, epoch_us(ts) // 86400000000 AS day, rank() OVER (PARTITION BY node_id, epoch_us(ts) // 86400000000 ORDER BY srcip, dstip, srcport, dstport) AS place FROM flow_index WHERE ts IS NOT NULL AND {_WHOLE}",
    "query_value_typing": """SELECT * FROM (VALUES ('srcip == 10.0.0.7', 'SRCIP', ''), ('dstport == 443', 'DSTPORT', ''), ('dstip == 2001:db8::1', 'DSTIPv6', ''), ('proto == 6', '', 'not of the form field == value'), ('srcport == 70000', '', 'not a port'),
('srcport == 80abc', '', 'not a port'), ('srcip = 1.2.3.4', '', 'not of the form field == value'), ('  dstip  ==  1.2.3.4  ', 'DSTIP', ''), ('srcip == 1.2.3', '', 'not an address')) t(query, index_type, error)""",
    "shard_map_latest": f"SELECT user_id % {SHARDS} AS shard_id, 'shard_index_' || max(event_id) AS address FROM events WHERE event_type <> 'error' GROUP BY 1",
    "shard_route": f"WITH m AS (SELECT user_id % {SHARDS} AS shard_id, 'shard_index_' || max(event_id) AS address FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT seq, CAST('0x' || substr(md5(concat_ws('|', srcip, dstip, srcport, dstport)), 1, 8) AS BIGINT) % {SHARDS} AS shard_id FROM flow_index WHERE {_WHOLE}) SELECT shard_id, seq, address FROM r JOIN m USING (shard_id)",
    "stream_index_append": _POST + " SELECT * FROM x",
}
