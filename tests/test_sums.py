"""Sums of doubles that are exact ties: rounded as SQL adds them up, in the order of the stored rows."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lanewright.plans import polylines

# fmt: off
ROWS = [
    (51856, 4, 9151, 981, 33.0, 81389.79), (51856, 3, 11293, 182, 8.0, 72295.35), (106568, 1, 10745, 536, 10.0, 37857.04), (106568, 5, 10680, 20, 17.0, 15909.54),
    (19342, 6, 10968, 428, 49.0, 28235.55), (51856, 6, 15126, 643, 31.0, 11503.85), (19342, 1, 211, 960, 6.0, 82722.35), (106568, 2, 16106, 343, 50.0, 88887.6),
    (106568, 3, 19167, 562, 15.0, 76706.73), (19342, 5, 14690, 919, 38.0, 82346.45), (106568, 7, 12544, 524, 26.0, 78724.7), (51856, 4, 2486, 362, 9.0, 59535.79),
    (19342, 4, 10539, 435, 27.0, 9786.96), (106568, 5, 7233, 161, 22.0, 31161.97), (51856, 5, 4467, 946, 32.0, 82557.6), (106568, 3, 3500, 95, 9.0, 61042.42),
    (51856, 2, 9058, 886, 22.0, 103447.62), (19342, 3, 13703, 616, 7.0, 34758.69),
]
# fmt: on


@pytest.mark.parametrize("name", ["polyline_bbox", "affine_transform"])
def test_ties_round_as_stored(spark, tmp_path, name):
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pq.write_table(pa.table([pa.array(v) for v in zip(*ROWS, strict=True)], names=columns), tmp_path / "lineitem.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    cursor = c.execute(polylines.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, polylines.QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(cursor.fetchall())


# fmt: off
RESAMPLED = [
    (63926, 4, 1260, 947, 47.0, 3052.63), (63926, 4, 21260, 1947, 47.0, 3052.63), (63926, 4, 41260, 2947, 47.0, 3052.63), (63926, 4, 61260, 3947, 47.0, 3052.63), (63926, 4, 81260, 4947, 47.0, 3052.63), (63926, 4, 101260, 5947, 47.0, 3052.63),
    (63926, 3, 18847, 920, 10.0, 65517.37), (63926, 3, 38847, 1920, 10.0, 65517.37), (63926, 3, 58847, 2920, 10.0, 65517.37), (63926, 3, 78847, 3920, 10.0, 65517.37), (63926, 3, 98847, 4920, 10.0, 65517.37), (63926, 3, 118847, 5920, 10.0, 65517.37),
]
# fmt: on


def test_resampled_ties_round_as_in_sql(spark, tmp_path):
    """SQL adds the first point to the sum of the others, whatever its threads."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pq.write_table(pa.table([pa.array(v) for v in zip(*RESAMPLED, strict=True)], names=columns), tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.execute(polylines.ORACLE_SQL["resample_polyline"]).fetchall()
    assert want == [tuple(r) for r in polylines.QUERIES["resample_polyline"](spark, str(tmp_path)).collect()]
