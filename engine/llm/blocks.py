"""Sums of fixed-size blocks over all partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_blocks(codes: DataFrame, work, rows: int, columns: int):
    """The sum over all partitions of the (rows x columns) block that `work` adds each batch to."""
    import numpy as np

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                work(batch, total)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["r", "v"])

    def add(t):
        import numpy as np
        import pyarrow as pa

        r, v = t.column("r").to_numpy(), np.stack(t.column("v").to_numpy())
        order = np.argsort(r, kind="stable")
        at = np.flatnonzero(np.diff(r[order], prepend=-1))
        return pa.table({"r": pa.array(r[order][at], pa.int32()), "v": pa.array(list(np.add.reduceat(v[order], at)), pa.list_(pa.float64()))})

    parts = codes.mapInArrow(partial, "r int, v array<double>")
    out = np.zeros((rows, columns))
    for x in parts.groupBy((F.col("r") % 64).alias("slice")).applyInArrow(add, "r int, v array<double>").collect():  # at most `rows` rows
        out[x["r"]] = x["v"]
    return out
