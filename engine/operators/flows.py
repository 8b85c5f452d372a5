"""Packets to flows: offsets, directional keys, segments, chains, heads, block zone maps, rates and routes.

All queries read the whole table `packets`. A packet is named by (node_id, pkt_offset) and counts once; frames that are
not IP have no flow. Flow keys are hexadecimal address values (8 digits IPv4, 32 IPv6), so a spelling makes no flow.
Windows are partitioned by (node, flow); running sums over a whole node go in two passes over ranges of `seq`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.functions.net import packed
from engine.sources.tables import micros, table

#: Bytes of a capture file's header and of each record's; the end mark of a chain.
FILE_HEADER, RECORD_HEADER, CHAIN_END = 24, 16, 4294967295
GAP_BYTES, RING_BYTES, GAP_US, BLOCK_BYTES = 16384, 1 << 18, 900_000_000, 65536
SEQ_RANGE = 1 << 16
KEY = ["src", "dst", "srcport", "dstport"]
QUEUES = 8


def ip_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, node_id, off, us, caplen, ip_version, src, dst, srcport, dstport) of IP packets with a whole key, each once."""
    p = table(spark, sf_dir, "packets").where("ip_version IN (4, 6)").dropna(subset=["node_id", "pkt_offset", "srcip", "dstip", "srcport", "dstport"])
    rows = p.select("seq", "node_id", F.col("pkt_offset").alias("off"), micros("ts").alias("us"), "caplen", "ip_version", F.lower(F.hex(packed("srcip"))).alias("src"), F.lower(F.hex(packed("dstip"))).alias("dst"), *(F.col(c).cast("bigint").alias(c) for c in KEY[2:]))
    first = F.min(F.struct("seq", "us", "caplen", "ip_version", *KEY))
    return rows.dropna(subset=["src", "dst"]).groupBy("node_id", "off").agg(first.alias("r")).select("node_id", "off", "r.*")


def _order() -> Window:
    return Window.partitionBy("node_id", *KEY).orderBy("seq", "off")


def segments(packets: DataFrame, gap: int = GAP_BYTES, ring: int | None = None, gap_us: int | None = None) -> DataFrame:
    """Adds prev_off, is_head and segment_id. A packet opens a segment if it is its flow's first, or the bytes (or time) since the last one exceed the limit; on a ring, an offset not beyond the last one has wrapped."""
    off = F.col("off") % ring if ring else F.col("off")
    last = F.lag("here").over(_order())
    d = packets.withColumn("here", off)
    d = d.withColumn("last_at", last).withColumn("last_us", F.lag("us").over(_order()))
    bytes_ = F.when(F.col("here") <= F.col("last_at"), F.col("here") + (ring or 0) - F.col("last_at")).otherwise(F.col("here") - F.col("last_at"))
    head = F.col("last_at").isNull() | (bytes_ > gap)
    if gap_us is not None:  # an unsigned difference: time that runs backwards is a huge gap, unknown time none
        step = F.col("us") - F.col("last_us")
        head = head | F.coalesce((step > gap_us) | (step < 0), F.lit(False))
    d = d.withColumn("is_head", head.cast("int"))
    numbered = d.withColumn("segment_id", F.sum("is_head").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("prev_off", F.when(F.col("is_head") == 0, F.col("last_at"))).drop("last_us")


def packets_ip_only(spark, sf_dir):
    return table(spark, sf_dir, "packets").groupBy("node_id").agg(F.count_if(F.col("ip_version").isin(4, 6)).alias("n_ip"), F.count_if(~F.coalesce(F.col("ip_version").isin(4, 6), F.lit(False))).alias("n_skipped"))


def flow_key_counts(spark, sf_dir, version=4):
    return ip_packets(spark, sf_dir).where(F.col("ip_version") == version).groupBy(*KEY).agg(F.count("*").alias("n_packets"), F.sum("caplen").alias("n_bytes"))


def flow_key_counts_v6(spark, sf_dir):
    return flow_key_counts(spark, sf_dir, 6)


def address_canonical(spark, sf_dir):
    p = table(spark, sf_dir, "packets")
    spellings = p.select(F.col("srcip").alias("spelling")).unionAll(p.select("dstip")).dropna().distinct()
    return spellings.select("spelling", F.lower(F.hex(packed("spelling"))).alias("address"))


def packet_offsets(spark, sf_dir):
    """Where each packet would stand in its node's capture file: sums of ranges of seq, then running sums inside a range."""
    rows = table(spark, sf_dir, "packets").dropna(subset=["node_id", "pkt_offset", "caplen"]).groupBy("node_id", "pkt_offset").agg(F.min("seq").alias("seq"), F.min("caplen").alias("caplen"))
    rows = rows.withColumn("part", F.expr(f"seq div {SEQ_RANGE}")).withColumn("size", F.col("caplen") + RECORD_HEADER)
    before = rows.groupBy("node_id", "part").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("node_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = Window.partitionBy("node_id", "part").orderBy("seq", "pkt_offset").rowsBetween(Window.unboundedPreceding, -1)
    at = F.lit(FILE_HEADER) + F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    out = rows.join(before, ["node_id", "part"]).withColumn("file_offset", at)
    return out.select("node_id", "seq", "pkt_offset", "file_offset", F.shiftleft("node_id", 48).bitwiseOR(F.col("file_offset").bitwiseAND(F.lit((1 << 48) - 1))).alias("position"))


def flow_segments(spark, sf_dir):
    return segments(ip_packets(spark, sf_dir)).select("node_id", "seq", *KEY, "off", "prev_off", "is_head", "segment_id")


def flow_segments_ring(spark, sf_dir):
    s = segments(ip_packets(spark, sf_dir), ring=RING_BYTES)
    return s.select("node_id", "seq", "off", "here", "prev_off", F.when(F.col("is_head") == 0, F.pmod(F.col("here") + RING_BYTES - F.col("prev_off"), F.lit(RING_BYTES))).alias("diff"), "is_head", "segment_id")


def flow_segments_time_gap(spark, sf_dir):
    return segments(ip_packets(spark, sf_dir), gap_us=GAP_US).select("node_id", "seq", "off", "is_head", "segment_id")


def flow_heads(spark, sf_dir):
    """One index entry per segment head."""
    s = segments(ip_packets(spark, sf_dir)).where("is_head = 1")
    return s.select(F.shiftleft("node_id", 48).bitwiseOR(F.col("off").bitwiseAND(F.lit((1 << 48) - 1))).alias("position"), "node_id", F.col("us").alias("ts_us"), *KEY)


def flow_chain(spark, sf_dir):
    s = segments(ip_packets(spark, sf_dir))
    nxt = F.lead("off").over(Window.partitionBy("node_id", *KEY, "segment_id").orderBy("seq", "off"))
    return s.select("node_id", "seq", "off", F.coalesce(nxt - F.col("off"), F.lit(CHAIN_END)).alias("flow_next_diff"))


def flow_chain_walk(spark, sf_dir):
    """All packets of each chain with its head and their step: an equality on the segment, no pointer is followed."""
    w = Window.partitionBy("node_id", *KEY, "segment_id").orderBy("seq", "off")
    return segments(ip_packets(spark, sf_dir)).select("node_id", F.first("off").over(w).alias("head_off"), "off", F.row_number().over(w).cast("bigint").alias("step"))


def flow_segment_stats(spark, sf_dir):
    s = segments(ip_packets(spark, sf_dir))
    return s.groupBy("node_id", *KEY, "segment_id").agg(F.count("*").alias("n_packets"), F.sum("caplen").alias("n_bytes"), F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def capture_block_meta(spark, sf_dir):
    s = segments(ip_packets(spark, sf_dir)).withColumn("block_id", F.expr(f"off div {BLOCK_BYTES}"))
    return s.groupBy("node_id", "block_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("packet_count"), F.sum("is_head").alias("index_count"))


def capture_stats(spark, sf_dir):
    """Packets, bytes, index entries and rates of each node; a frame has 14 bytes more on the wire."""
    s = segments(ip_packets(spark, sf_dir)).groupBy("node_id").agg(F.count("*").alias("n_packets"), F.sum("caplen").alias("n_bytes"), F.sum("is_head").alias("n_indexes"), (F.max("us") - F.min("us")).alias("span_us"))
    span = F.when(F.col("span_us") > 0, F.col("span_us"))
    return s.withColumn("gbps", F.round((F.col("n_bytes") + 14 * F.col("n_packets")) / span / 125, 9)).withColumn("mpps", F.round(F.col("n_packets") / span, 9))


def flow_route(spark, sf_dir):
    """The receive queue of each flow and what it carries; any spreading hash of the key will do."""
    queue = F.conv(F.substring(F.md5(F.concat_ws("|", *KEY)), 1, 8), 16, 10).cast("bigint") % QUEUES
    return ip_packets(spark, sf_dir).groupBy(queue.alias("queue")).agg(F.count("*").alias("n_packets"), F.count_distinct(*KEY).alias("n_flows"))


#: The address value of one spelling, in DuckDB.
HEX = """CASE WHEN {c} LIKE '%:%' THEN (
  SELECT string_agg(lpad(g, 4, '0'), '' ORDER BY i) FROM (SELECT unnest(l) AS g, generate_subscripts(l, 1) AS i FROM (SELECT CASE WHEN lower({c}) LIKE '%::%' THEN
    list_concat(list_concat(list_filter(string_split(split_part(lower({c}), '::', 1), ':'), lambda x: x <> ''),
      list_transform(range(8 - len(list_filter(string_split(split_part(lower({c}), '::', 1), ':'), lambda x: x <> '')) - len(list_filter(string_split(split_part(lower({c}), '::', 2), ':'), lambda x: x <> ''))), lambda x: '0')),
      list_filter(string_split(split_part(lower({c}), '::', 2), ':'), lambda x: x <> ''))
    ELSE string_split(lower({c}), ':') END AS l)))
  ELSE printf('%02x%02x%02x%02x', CAST(split_part({c}, '.', 1) AS INT), CAST(split_part({c}, '.', 2) AS INT), CAST(split_part({c}, '.', 3) AS INT), CAST(split_part({c}, '.', 4) AS INT)) END"""
ADDR = f"addr AS (SELECT a AS spelling, {HEX.format(c='a')} AS h FROM (SELECT DISTINCT srcip AS a FROM packets WHERE srcip IS NOT NULL UNION SELECT DISTINCT dstip FROM packets WHERE dstip IS NOT NULL))"
P = f"""WITH {ADDR},
p AS (SELECT node_id, pkt_offset AS off, min(seq) AS seq, min(epoch_us(ts)) AS us, min(caplen) AS caplen, min(ip_version) AS ip_version, min(s.h) AS src, min(d.h) AS dst, min(srcport)::BIGINT AS srcport, min(dstport)::BIGINT AS dstport
  FROM packets JOIN addr s ON s.spelling = srcip JOIN addr d ON d.spelling = dstip WHERE ip_version IN (4, 6) AND node_id IS NOT NULL AND pkt_offset IS NOT NULL AND srcport IS NOT NULL AND dstport IS NOT NULL GROUP BY 1, 2)"""


def _seg(ring: int | None = None, gap_us: int | None = None) -> str:
    at = f"off % {ring}" if ring else "off"
    time = f" OR coalesce(us - last_us > {gap_us} OR us < last_us, false)" if gap_us else ""
    return (
        P
        + f""",
l AS (SELECT *, {at} AS here, lag({at}) OVER w AS last_at, lag(us) OVER w AS last_us FROM p WINDOW w AS (PARTITION BY node_id, src, dst, srcport, dstport ORDER BY seq, off)),
h AS (SELECT *, CASE WHEN last_at IS NULL OR (CASE WHEN here <= last_at THEN here + {ring or 0} - last_at ELSE here - last_at END) > {GAP_BYTES}{time} THEN 1 ELSE 0 END AS is_head FROM l),
g AS (SELECT *, CAST(sum(is_head) OVER (PARTITION BY node_id, src, dst, srcport, dstport ORDER BY seq, off ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id, CASE WHEN is_head = 0 THEN last_at END AS prev_off FROM h)
"""
    )


QUERIES = {
    f.__name__: f
    for f in (
        packets_ip_only, flow_key_counts, flow_key_counts_v6, address_canonical, packet_offsets, flow_segments, flow_segments_ring, flow_segments_time_gap,
        flow_heads, flow_chain, flow_chain_walk, flow_segment_stats, capture_block_meta, capture_stats, flow_route,
    )
}
_POSITION = "(node_id << 48) | {}"
SQL = {
    "packets_ip_only": "SELECT node_id, count(*) FILTER (ip_version IN (4, 6)) AS n_ip, count(*) FILTER (ip_version IS NULL OR ip_version NOT IN (4, 6)) AS n_skipped FROM packets GROUP BY 1",
    "flow_key_counts": P + " SELECT src, dst, srcport, dstport, count(*) AS n_packets, CAST(sum(caplen) AS BIGINT) AS n_bytes FROM p WHERE ip_version = 4 GROUP BY 1, 2, 3, 4",
    "flow_key_counts_v6": P + " SELECT src, dst, srcport, dstport, count(*) AS n_packets, CAST(sum(caplen) AS BIGINT) AS n_bytes FROM p WHERE ip_version = 6 GROUP BY 1, 2, 3, 4",
    "address_canonical": f"WITH {ADDR} SELECT spelling, h AS address FROM addr",
    "packet_offsets": f"""WITH r AS (SELECT node_id, pkt_offset, min(seq) AS seq, min(caplen) AS caplen FROM packets WHERE node_id IS NOT NULL AND pkt_offset IS NOT NULL AND caplen IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, CAST({FILE_HEADER} + coalesce(sum(caplen + {RECORD_HEADER}) OVER (PARTITION BY node_id ORDER BY seq, pkt_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_offset FROM r)
SELECT node_id, seq, pkt_offset, file_offset, {_POSITION.format("file_offset")} AS position FROM o""",
    "flow_segments": _seg() + "SELECT node_id, seq, src, dst, srcport, dstport, off, prev_off, is_head, segment_id FROM g",
    "flow_segments_ring": _seg(RING_BYTES) + f"SELECT node_id, seq, off, here, prev_off, CASE WHEN is_head = 0 THEN (here + {RING_BYTES} - prev_off) % {RING_BYTES} END AS diff, is_head, segment_id FROM g",
    "flow_segments_time_gap": _seg(None, GAP_US) + "SELECT node_id, seq, off, is_head, segment_id FROM g",
    "flow_heads": _seg() + f"SELECT {_POSITION.format('off')} AS position, node_id, us AS ts_us, src, dst, srcport, dstport FROM g WHERE is_head = 1",
    "flow_chain": _seg() + f"SELECT node_id, seq, off, coalesce(lead(off) OVER (PARTITION BY node_id, src, dst, srcport, dstport, segment_id ORDER BY seq, off) - off, {CHAIN_END}) AS flow_next_diff FROM g",
    "flow_chain_walk": _seg() + "SELECT node_id, first(off) OVER w AS head_off, off, row_number() OVER w AS step FROM g WINDOW w AS (PARTITION BY node_id, src, dst, srcport, dstport, segment_id ORDER BY seq, off)",
    "flow_segment_stats": _seg() + "SELECT node_id, src, dst, srcport, dstport, segment_id, count(*) AS n_packets, CAST(sum(caplen) AS BIGINT) AS n_bytes, min(off) AS first_off, max(off) AS last_off, min(us) AS start_us, max(us) AS end_us FROM g GROUP BY 1, 2, 3, 4, 5, 6",
    "capture_block_meta": _seg() + f"SELECT node_id, off // {BLOCK_BYTES} AS block_id, min(us) AS start_us, max(us) AS end_us, count(*) AS packet_count, CAST(sum(is_head) AS BIGINT) AS index_count FROM g GROUP BY 1, 2",
    "capture_stats": _seg() + "SELECT *, round((n_bytes + 14 * n_packets) / nullif(span_us, 0) / 125, 9) AS gbps, round(n_packets / nullif(span_us, 0), 9) AS mpps FROM (SELECT node_id, count(*) AS n_packets, CAST(sum(caplen) AS BIGINT) AS n_bytes, CAST(sum(is_head) AS BIGINT) AS n_indexes, max(us) - min(us) AS span_us FROM g GROUP BY 1)",
    "flow_route": P + f" SELECT CAST('0x' || substr(md5(concat_ws('|', src, dst, srcport, dstport)), 1, 8) AS BIGINT) % {QUEUES} AS queue, count(*) AS n_packets, count(DISTINCT (src, dst, srcport, dstport)) AS n_flows FROM p GROUP BY 1",
}
