"""Nulls, empty tables, ties, repeated rows, very long values and clashing column names in the general operators."""

import json

import duckdb
import pyarrow as pa
import pytest

from engine.operators import changes, index, lines, periods, regions, sessions


def test_periods(spark):
    rows = [
        ("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 2, 5), ("a", 2, 5), ("a", 40, 40), ("a", None, 5), ("a", 5, None), ("a", 9, 3),
        ("b", 0, 10**12), ("b", 7 * 10**10, 8 * 10**10), ("b", 10**12 + 1, 10**12 + 1), (None, 1, 2), (None, 2, 3),
    ]
    df = spark.createDataFrame(rows, "e string, s bigint, t bigint").selectExpr("e", "s", "t", "'x' AS b", "1 AS k0", "2 AS kind", "3 AS until")
    got = sorted(map(tuple, periods.continuous(df, ["e"], "s", "t").collect()), key=str)
    assert got == sorted(
        [
            ("period", "a", 0, 20), ("period", "a", 21, 30), ("period", "a", 40, 40), ("gap", "a", 20, 21), ("gap", "a", 30, 40),
            ("period", "b", 0, 10**12), ("gap", "b", 10**12, 10**12 + 1), ("period", "b", 10**12 + 1, 10**12 + 1), ("period", None, 1, 3),
        ],
        key=str,
    )
    assert periods.continuous(df.where("false"), ["e"], "s", "t").count() == 0


def test_periods_do_not_depend_on_buckets(spark):
    import random

    random.seed(1)
    rows = [(random.choice("ab"), s := random.randint(0, 5000), s + random.choice([0, 1, 5, 300])) for _ in range(400)]
    df = spark.createDataFrame(rows, "e string, s bigint, t bigint")
    got = [sorted(map(tuple, periods.continuous(df, ["e"], "s", "t", b).collect())) for b in (7, 1000, 10**9)]
    assert got[0] == got[1] == got[2]


def test_sessions(spark):
    m = 900_000_000
    rows = [("f", 0), ("f", m), ("f", 2 * m), ("f", 3 * m + 1), ("f", 3 * m + 1), ("g", 5), ("f", None), (None, 7)] + [("h", i * m) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, us bigint").selectExpr("*", "1 AS n", "2 AS s", "3 AS chunk")
    got = sorted(map(tuple, sessions.sessions(df, ["k"], "us").collect()))
    assert got == [("f", 0, 2 * m, 2 * m, 3), ("f", 3 * m + 1, 3 * m + 1, 0, 2), ("g", 5, 5, 0, 1), ("h", 0, 39 * m, 39 * m, 40)]
    assert sessions.sessions(df.where("false"), ["k"], "us").count() == 0


@pytest.mark.parametrize("first", ['1,2,"{""a"":1', "x", '1,2,{},"'])
def test_lines_do_not_leak(spark, first):
    """A line with an open quote neither swallows nor spoils the lines after it."""
    good = '1,1641437512430,"{""a"":""x,y""}"'
    cases = [first, good, "1,2,", '1,2,a"b', '"1"x,2,{}', '1,2,"{}"', "", "1,2,3,4", '"1","2","{""a"":""' + "z" * 3_000_000 + '""}"', 'a\rb,c,"d\ne"', good]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "line_id bigint, l string").coalesce(1)
    got = {r.line_id: (r.fault, r.fields) for r in lines.structured(df).collect()}
    assert len(got) == len(cases) and got[0][0] == ("columns" if first == "x" else "quoting")
    assert got[1] == got[10] == (None, ["1", "1641437512430", '{"a":"x,y"}']) and got[2] == (None, ["1", "2", ""])
    assert [got[i][0] for i in (3, 4, 5, 6, 7)] == ["quoting", "quoting", None, "columns", "columns"]
    assert len(got[8][1][2]) > 3_000_000 and got[9] == (None, ["a\rb", "c", "d\ne"])


def test_lines_empty(spark):
    assert lines.structured(spark.createDataFrame([(1, None)], "line_id bigint, l string")).count() == 0


class Lines:
    """Stands for a DataFrame and gives the function of its workers, to run it here."""

    def where(self, _):
        return self

    def mapInArrow(self, read, _):  # noqa: N802
        return read


def judged(cases):
    batch = pa.RecordBatch.from_pydict({"line_id": list(range(len(cases))), "l": cases})
    return [(r["fault"], r["fields"]) for b in lines.structured(Lines())(iter([batch])) for r in b.to_pylist()]


def test_a_failure_of_the_reader_is_no_fault_of_the_line(monkeypatch):
    class Broken:
        def __init__(self, con):
            self.con = con

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.con.close()

        def execute(self, sql):
            if "read_csv" in sql:
                raise duckdb.IOException("no file")
            return self.con.execute(sql)

    real = duckdb.connect
    monkeypatch.setattr(duckdb, "connect", lambda **k: Broken(real(**k)))
    with pytest.raises(duckdb.IOException):
        judged(["1,2,{}"])


def test_lines_beyond_the_readers_memory_are_read(monkeypatch):
    limits, real = [], duckdb.connect

    def connect(config):
        limits.append(config["memory_limit"])
        return real(config=config | ({"memory_limit": "20MB"} if limits[-1] == limits[0] else {}))

    monkeypatch.setattr(duckdb, "connect", connect)
    big = "z" * 30_000_000
    got = judged(["1,2,{}", f'1,2,"{big}"', "1,2", f'1,2,"{big}', f"1,{big}", '1,2,"{}"'])
    assert [f for f, _ in got] == [None, None, "columns", "quoting", "columns", None]
    assert got[0][1] == got[5][1] == ["1", "2", "{}"] and got[1][1] == ["1", "2", big]


def test_assignment_is_the_best():
    """Taking the likeliest pair first would lose: 0.9 + 0 against 0.8 + 0.8."""
    assert changes.assign([[0.9, 0.8], [0.8, 0.0]]) == [1, 0]
    assert changes.assign([[0.1], [0.7], [0.2]]) == [-1, 0, -1]


@pytest.mark.parametrize("text,ok", [("srcip == 10.0.0.7", True), (" dstport  ==  443 ", True), ("dstip == 2001:db8::1", True), ("srcport == 70000", False), ("srcport == 80abc", False), ("proto == 6", False), ("srcip = 1.2.3.4", False)])
def test_query_texts(text, ok):
    if ok:
        index.parse(text)
    else:
        with pytest.raises(ValueError):
            index.parse(text)


def test_region_blocks_of_the_known_workload(spark):
    """Two regions of 100 rows each under a limit of 1024 bytes: cuts, sizes and offsets known beforehand."""
    rows = []

    def put(kind, region, op=None, cells=None):
        rows.append((len(rows), kind, region, op, "r", "e", "{}", cells and json.dumps(cells)))

    for op in ("CREATE", "OPEN"):
        put("ADMIN", 1, op), put("ADMIN", 2, op)
    for i in range(1, 101):
        put("WRITE", 1, None, {"id": i, "value": 3.14 * i, "description": f"{i}pi"})
        put("WRITE", 2, None, {"id": i, "value": i**0.5 + 1e-9, "description": f"root{i}"})
    for op in ("OPEN", "CLOSE", "CLOSE", "DROP"):
        put("ADMIN", 1, op), put("ADMIN", 2, op)
    put("WRITE", 1, None, {"id": 1})
    df = spark.createDataFrame(rows, "request_id bigint, req_type string, region_id bigint, operation string, region_name string, expr string, attrs string, json_data string").selectExpr("*", "timestamp_micros(request_id) AS ts")
    life = {(r.region_id, r.operation, r.accepted) for r in regions.lifecycle(df).collect()}
    assert (1, "CLOSE", False) in life and (1, "OPEN", False) in life and (2, "DROP", True) in life
    w = regions.sized(regions.admitted(df)).where("typed").selectExpr("*", "fixed_bytes + var_bytes AS size")
    cut = regions.blocks(w.select("request_id", "region_id", "epoch", "us", "size", "var_bytes", "stored_bytes"))
    got = sorted((r.region_id, r.block, r.row_count, r.var_bytes, r.disk_bytes, r.file_offset) for r in regions.block_table(cut).collect())
    assert got == [
        (1, 0, 35, 131, 1393, 0), (1, 1, 35, 140, 1402, 1393), (1, 2, 30, 121, 1223, 2795),
        (2, 0, 33, 189, 1387, 0), (2, 1, 33, 198, 1396, 1387), (2, 2, 33, 198, 1396, 2783), (2, 3, 1, 7, 181, 4179),
    ]
