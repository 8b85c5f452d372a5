"""Each query against an independent computation over the whole tables of one scale."""

import ipaddress
import json
import os
import re
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from engine.plans import catalog

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.01")


def rows(spark, name):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect())


def read(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def address(s):
    s = s.strip()
    a = ipaddress.ip_address(int(s) if s.isdigit() else s)
    return getattr(a, "ipv4_mapped", None) or a


def micros(t):
    return round((t.timestamp() if t.tzinfo else t.replace(tzinfo=__import__("datetime").UTC).timestamp()) * 1e6)


@pytest.mark.parametrize("name", catalog.SQL)
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*' if p.is_dir() else p}')")
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    c = con.execute(catalog.SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    want = order(tuple(r[names.index(x)] for x in columns) for r in c.fetchall())
    assert want and order(map(tuple, got.select(*columns).collect())) == want


def reason(line):
    line, fields, at = line.removesuffix("\r"), [], 0
    while True:
        if line[at : at + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)', re.S).match(line, at)
        else:
            m = re.compile(r'([^",]*)(?=,|\Z)', re.S).match(line, at)
        if not m:
            return "quoting"
        fields.append(m[1].replace('""', '"') if line[at : at + 1] == '"' else m[1])
        if m.end() == len(line):
            break
        at = m.end() + 1
    if len(fields) != 3:
        return "columns"
    if not re.fullmatch("[0-9]{1,20}", fields[0]) or int(fields[0]) >= 1 << 64:
        return "region_id"
    if not re.fullmatch("[0-9]{1,20}", fields[1]) or not 946684800000 <= int(fields[1]) < 4102444800000:
        return "timestamp"
    try:
        x = json.loads(fields[2], parse_constant=lambda _: None)
        json_ws = fields[2].strip(" \t\r\n") == fields[2].strip()
        good = json_ws and isinstance(x, dict) and all(type(v) in (int, float, str) for v in x.values())
    except ValueError:
        good = False
    return None if good else "json_data"


def test_p4(spark):
    want = [(r["line_id"], x) for r in read("write_lines") if (x := reason(r["line"]))]
    assert len({x for _, x in want}) == 5 and rows(spark, "p4_found") == sorted(want)
    assert len(rows(spark, "p4_valid")) == len(read("write_lines")) - len(want)


def test_p6(spark):
    flows, met = {}, set()
    for r in read("packets"):
        flow = tuple(r[c] for c in ("srcip", "dstip", "srcport", "dstport"))
        if r["ts"] is not None and None not in flow and (k := (r["node_id"], r["pkt_offset"])) not in met:
            met.add(k)
            flows.setdefault((str(address(flow[0])), str(address(flow[1])), *flow[2:]), []).append(micros(r["ts"]))
    want = []
    for flow, times in flows.items():
        s = []
        for t in sorted(times):
            if s and t - s[-1][1] <= 900_000_000:
                s[-1] = (s[-1][0], t, s[-1][2] + 1)
            else:
                s.append((t, t, 1))
        want += [(*flow, *x) for x in s]
    assert want and rows(spark, "p6_found") == sorted(want)
