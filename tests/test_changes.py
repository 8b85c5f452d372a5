"""A region's three files, one of which another region has alone."""

import json

import pyarrow as pa
import pyarrow.parquet as pq

from engine.operators import changes


def test_p2(spark, tmp_path):
    rows = []

    def put(region, file_no, attrs, writes):
        for a, j in [(attrs, None), *((None, w) for w in writes)]:
            rows.append({"request_id": len(rows), "file_name": f"f{file_no}", "file_no": file_no, "region_id": region, "attrs": a and json.dumps(a), "json_data": j and json.dumps(j)})

    first = [{"id": i, "mtu": (576, 1500, 9000)[i % 3], "load": i / 1000, "zone": f"Z-{i % 4}"} for i in range(12)]
    second = [{"recordId": i, "link_mtu": (576, 1500, 9000)[i % 3], "load": str(i / 1000), "note": "slow idle trunk ring"} for i in range(12, 24)]
    put(1, 0, {"sstPath": "./d", "walMode": "sync"}, first)
    put(2, 1, {"sstPath": "./d"}, [{"other": 1}])
    put(1, 2, {"dataDir": "./d", "ttlDays": "30"}, second)
    put(1, 3, {"dataDir": "./d", "ttlDays": 30}, [{**w, "recordId": w["recordId"] + 12} for w in second])
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "region_requests.parquet")
    got = {tuple(r) for r in changes.found(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "f2", "json_data", "id", "renamed", "recordId"), (1, "f2", "json_data", "mtu", "renamed", "link_mtu"), (1, "f2", "json_data", "load", "retyped", ""),
        (1, "f2", "json_data", "zone", "removed", ""), (1, "f2", "json_data", "note", "added", ""), (1, "f2", "attrs", "sstPath", "renamed", "dataDir"),
        (1, "f2", "attrs", "walMode", "removed", ""), (1, "f2", "attrs", "ttlDays", "added", ""), (1, "f3", "attrs", "ttlDays", "retyped", ""),
    }
