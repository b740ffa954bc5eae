"""Count tables on their way to the driver."""

import numpy as np
import pyarrow as pa

from tillspark.llm import tables


def test_counts_reach_the_driver_compressed(spark):
    draw = np.random.default_rng(2)
    one, two = (draw.poisson(0.3, 3 * tables.CELL + 7) for _ in range(2))
    two[: tables.CELL] = 1 << 40
    rows = [(k, bytes(x)) for t in (one, two) for k, x in tables.cells(t)]
    assert (tables.gathered(spark.createDataFrame(rows, "cell int, counts binary"), len(one)) == one + two).all()
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=tables.CELL_SCHEMA)
    sent = sum(len(x) for b in tables._add(iter([batch])) for x in b.column("counts").to_pylist())
    assert sent < 8 * len(one) / 4
