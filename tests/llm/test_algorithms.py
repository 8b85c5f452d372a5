"""The counting operators against brute force over the whole tables of one scale."""

import ipaddress
import os
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from engine.llm import catalog, distinct, frequent, seen

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.01")


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def address(s):
    s = s.strip()
    a = ipaddress.ip_address(int(s) if s.isdigit() else s)
    return getattr(a, "ipv4_mapped", None) or a


@pytest.mark.parametrize("name", catalog.SQL)
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = sorted(con.execute(catalog.SQL[name]).fetchall())
    assert want and sorted(map(tuple, catalog.QUERIES[name](spark, DATA).collect())) == want


def test_p3(spark):
    met, want = set(), []
    for origin, key, cols in (("flow_index", "seq", ("srcip", "dstip", "srcport", "dstport")), ("flow_arrivals", "arrival_id", ("source_address", "destination_address", "source_port", "destination_port"))):
        for r in sorted(read(origin), key=lambda r: r[key]):
            if None not in (t := tuple(r[c] for c in cols)):
                t = (address(str(t[0])), address(str(t[1])), *t[2:])
                want += [(origin, r[key])] if t in met else []
                met.add(t)
    assert want and sorted(map(tuple, seen.found(spark, DATA).collect())) == sorted(want)
    n, n_yes, wrong_yes, wrong_no, rate = seen.rate(spark, DATA).collect()[0]
    assert n >= n_yes == len(want) and (wrong_yes, wrong_no, rate) == (0, 0, 0)


def test_p3_small_batches_give_the_same(spark):
    at = [seen.answers(spark, DATA, b).count() for b in (1, 256 << 30)]
    assert at[0] == at[1] > 0


def test_p3_goes_on_after_a_stop(spark, tmp_path):
    """A stream that stops and resumes keeps what it has seen, over several batches."""
    rows = [(0, i, i % 7, 1, "") for i in range(20)], [(0, 20 + i, i % 9, 1, "") for i in range(20)]
    schema = "origin int, id bigint, pair bigint, ports bigint, wide string"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        seen.keep_firsts(spark, stream, f"{tmp_path}/state")
    assert sorted(r.id for r in seen.firsts(spark, f"{tmp_path}/state").collect()) == [*range(7), 27, 28]


def test_p3_dirty(spark):
    rows = [(1, None, 2, 3, 4), (2, 1, 2, 3, 4), (2, 1, 2, 3, 4), (3, 1, 2, 3, 4), (4, 2, 1, 4, 3), (5, 2**32, 2, 3, 4)]
    df = spark.createDataFrame(rows, "seq bigint, srcip bigint, dstip bigint, srcport int, dstport int").selectExpr("*", "'x' AS id", "1 AS origin")
    assert sorted(r.id for r in seen.index_records(df).collect()) == [2, 2, 3, 4]
    assert seen.index_records(df.where("false")).count() == 0
    odd = [(1, "nonsense", "1.2.3.4", 1, 2), (2, "::ffff:1.2.3.4", "010.0.0.1", 1, 2), (3, "16909060", "10.0.0.1", 1, 2), (4, "2001:DB8::1", "2001:db8:0:0::2", 1, 2)]
    out = seen.arrival_records(spark.createDataFrame(odd, "arrival_id bigint, source_address string, destination_address string, source_port int, destination_port int")).collect()
    keys = {r.id: (r.pair, r.ports, r.wide) for r in out}
    assert keys[2] == keys[3] == (0x01020304 << 32 | 0x0A000001, 1 << 32 | 2, "") and set(keys) == {2, 3, 4} and len(keys[4][2]) == 65


def test_p5_sketch(spark):
    """Negative, 63-bit and null values; many rare ones beside ties at the threshold; extra columns."""
    big = [2**63 - 1, -5, 0]
    rows = [(v, None) for v in big for _ in range(100)] + [(1000 + i, i) for i in range(9000)] + [(None, None)] * 700
    df = spark.createDataFrame(rows, "x bigint, y bigint").selectExpr("*", "1 AS f", "2 AS d", "3 AS bucket").repartition(5)
    got = frequent.decode(frequent.sketch(df, ("x", "y"))).collect()
    assert {r.item for r in got if r.f == 0} >= set(big) and {r.n_rows for r in got} == {10000} and all(r.approx_count >= 100 for r in got if r.item in big)
    assert frequent.decode(frequent.sketch(df.where("false"), ("x",))).count() == 0


def test_p7_estimates(spark):
    """Within five stated errors for small and large sets and their union, from merged partial results."""
    df = spark.range(60000).selectExpr("id AS x", "CASE WHEN id < 100 THEN 'a' WHEN id < 3100 THEN 'b' ELSE 'c' END AS g").union(spark.range(50000, 60000).selectExpr("id", "'b'"))
    s = distinct.registers(df.union(df), ["g"], "x")
    true = {"a": 100, "b": 13000, "c": 56900}
    got = {r.g: r.n for r in distinct.number(s, ["g"]).collect()}
    assert all(abs(got[g] / n - 1) < 5 / distinct.M**0.5 for g, n in true.items())
    pair = distinct.compared(s, spark.createDataFrame([("b", "c")], "a string, b string"), "g").collect()[0]
    j = 10000 / 59900
    assert abs(pair.jaccard - j) < 5 * (j * (1 - j) / distinct.M) ** 0.5
    assert distinct.number(s.where("false"), ["g"]).count() == 0


def test_p7_pairs_are_found(spark):
    sets = [(f"n{k:02}", k * 40 + i) for k in range(30) for i in range(80)]  # neighbours share half
    s = distinct.registers(spark.createDataFrame(sets, "n string, x bigint"), ["n"], "x")
    assert {(f"n{k:02}", f"n{k + 1:02}") for k in range(29)} <= {tuple(r) for r in distinct.alike(s, "n").collect()}


def test_p7_small_sets_are_paired(spark, tmp_path):
    """Nodes of few sources, also at the threshold and below it, give the pairs of the SQL; before, one shared source was no pair."""
    rows, node, source = [], 0, 0
    for na, nb, both in [(1, 1, 1), (2, 2, 1), (1, 3, 1), (3, 3, 2), (4, 4, 2), (3, 3, 1), (2, 3, 1), (30, 30, 18), (200, 200, 120), (200, 200, 80)] * 3:
        for n, first in ((na, 0), (nb, na - both)):
            node += 1
            rows += [(node, source + first + i) for i in range(n)]
        source += na + nb - both
    spark.createDataFrame(rows, "node_id bigint, srcip bigint").selectExpr("timestamp_ntz'2026-01-01 05:00:00' AS ts", "*").write.parquet(f"{tmp_path}/flow_index.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW flow_index AS SELECT * FROM read_parquet('{tmp_path}/flow_index.parquet/*.parquet')")
    want = sorted(con.execute(distinct.SQL).fetchall())
    assert len(want) == 3 * 7 and sorted(map(tuple, distinct.found(spark, str(tmp_path)).collect())) == want


def test_p7_joint_of_few_items_is_unbiased():
    """Levels beyond the largest seen count too: without them the two items of one set only came out as more."""
    import numpy as np

    a, b = np.zeros((2, distinct.M), dtype=np.int64)
    a[[1, 2, 3]], b[[2, 3, 4]] = (1, 2, 3), (2, 3, 1)
    rate = 3 / distinct.M
    assert abs(distinct._joint(a, b, rate, rate, distinct.BASE, distinct.M)[2] - 2) < 0.01
