"""Regridding, pruning, SQL over grids and streams of chunks."""

import pytest

from gridframe.operators import NdFrame, regrid
from gridframe.operators.frame import NdPlanError
from gridframe.operators.regrid import OverlapError, TableSink
from gridframe.plans.pruning import axis_ranges, needed
from gridframe.plans.session import NdSession
from gridframe.sources.encoding import chunks
from gridframe.streaming.chunks import read_chunks, regrid_batches

from .test_frame import GRID, flat, grid_rows

TILES = {"k": ("string", []), "time": ("long", ["time"]), "lat": ("long", ["lat"]), "v": ("long", ["time", "lat"])}


def tiles(spark, *rows, axes=("time", "lat")):
    data = [{"k": ([k], []), "time": (t, [len(t)]), "lat": (y, [len(y)]), "v": (list(range(len(t) * len(y))), [len(t), len(y)])} for k, t, y in rows]
    return NdFrame.of(chunks(spark, TILES, data), grid_axes=axes)


def positions(frame, axis):
    return sorted((r["k"], r[axis], r[f"pos_{axis}"]) for r in regrid(frame).cells.select("k", axis, f"pos_{axis}").distinct().collect())


def test_arrival_order(spark):
    assert positions(tiles(spark, ("a", [102, 103], [0]), ("b", [100, 101], [0])), "time") == [("a", 102, 2), ("a", 103, 3), ("b", 100, 0), ("b", 101, 1)]


def test_descending(spark):
    frame = tiles(spark, ("a", [1], [0, 10]), ("b", [1], [30, 20]), axes=["time", ("lat", True)])
    assert positions(frame, "lat") == [("a", 0, 3), ("a", 10, 2), ("b", 20, 1), ("b", 30, 0)]


def test_sparse(spark):
    out = regrid(tiles(spark, ("a", [100], [0]), ("b", [101], [10])).select("v"))
    cells = sorted((r["time"], r["lat"], r["v"]) for r in out.dense().select("time", "lat", "v").fillna(-1).collect())
    assert cells == [(100, 0, 0), (100, 10, -1), (101, 0, -1), (101, 10, 0)]


def test_overlap(spark):
    frame = tiles(spark, ("a", [100, 101], [0]), ("b", [101, 102], [0]))
    with pytest.raises(OverlapError, match="a.*b"):
        regrid(frame).check("k")
    assert regrid(tiles(spark, ("a", [100], [0]), ("b", [100], [10]))).check("k").cells.count() == 2


def test_errors(spark):
    with pytest.raises(Exception, match="repeats in a chunk"):
        regrid(tiles(spark, ("a", [100, 100], [0]))).cells.collect()
    with pytest.raises(NdPlanError, match="not declared"):
        regrid(tiles(spark, ("a", [1], [0]), axes=["time"]))
    with pytest.raises(NdPlanError, match="declared grid axes"):
        regrid(NdFrame.of(tiles(spark, ("a", [1], [0])).df))
    with pytest.raises(Exception, match="null coordinate"):
        regrid(tiles(spark, ("a", [1, None], [0]))).dense().collect()


def test_filtered_grid(spark, tmp_path):
    frame = NdFrame.of(chunks(spark, GRID, list(grid_rows())), grid_axes=["time", "lat", "lon"])
    out = regrid(frame.filter("lat > -10").select("sst"))
    assert out.write(lambda cells: None).first()["count"] == 16
    assert out.write(TableSink(str(tmp_path / "cells"))).first()["count"] == 16
    whole = TableSink(str(tmp_path / "whole"), requires_grid=True)
    assert out.write(whole).first()["count"] == 16 == spark.read.parquet(whole.path).count()
    gaps = regrid(tiles(spark, ("a", [100], [0]), ("b", [101], [10])))
    assert gaps.write(TableSink(str(tmp_path / "gaps"), requires_grid=True)).first()["count"] == 4
    with pytest.raises(Exception, match="already exists"):
        out.write(whole)
    assert {a: t.count() for a, t in out.coordinates.items()} == {"time": 4, "lat": 2, "lon": 2}


def test_axis_ranges_and_pruning(spark):
    time = spark.createDataFrame([(i, 100 + i) for i in range(4)], "pos int, time long")
    lat = spark.createDataFrame([(0, -30.0), (1, None), (2, 30.0)], "pos int, lat double")
    ranges = axis_ranges({"time": time, "lat": lat}, "time >= 101 AND time <> 102", "lat > -40", "sst > 3", "time + lat > 0")
    assert sorted(map(tuple, ranges.collect())) == [("lat", 0, 1), ("lat", 2, 3), ("time", 1, 2), ("time", 3, 4)]
    assert sorted(map(tuple, axis_ranges({"time": time, "lat": lat}, "time >= 102 AND sst > 3").collect())) == [("time", 2, 4)]
    manifest = spark.sql("SELECT * FROM VALUES ('a', map('time', named_struct('origin', 0, 'size', 2))), ('b', map('time', named_struct('origin', 2, 'size', 1))), ('c', map()) AS t(k, placement)")
    assert sorted(r["k"] for r in needed(manifest, ranges, ["time"]).collect()) == ["a", "c"]


SQL = [
    "SELECT time, lat, lon, sst FROM g WHERE lat > 0", "SELECT lat FROM g", "SELECT count(*) FROM g", "SELECT source, elev FROM g WHERE elev >= 0", "SELECT lat, avg(sst), count(*) FROM g GROUP BY lat",
    "SELECT max(sst) FROM g WHERE lon = 5", "SELECT time, sst FROM g WHERE sst IS NOT NULL ORDER BY sst DESC, time LIMIT 3", "SELECT DISTINCT lat FROM g WHERE time > 101", "SELECT CASE WHEN lat > 0 THEN 'n' ELSE 's' END AS h, count(sst) FROM g GROUP BY 1",
    "SELECT lat + lon AS s FROM g WHERE lat BETWEEN -10 AND 40", "SELECT sst FROM g WHERE lat > 0 UNION ALL SELECT sst FROM g WHERE lat < 0", "SELECT a.lat FROM (SELECT lat FROM g) a JOIN (VALUES (30.0D)) b(y) ON a.lat = b.y",
    "SELECT lat, row_number() OVER (PARTITION BY lat ORDER BY time) AS r, time FROM g", "WITH w AS (SELECT time, sst FROM g) SELECT time, count(sst) FROM w GROUP BY time HAVING count(sst) > 5",
]


@pytest.mark.parametrize("query", SQL)
def test_sql(spark, query):
    """SQL over a grid gives what it gives over the flat rows of the columns it uses."""
    session = NdSession(spark)
    session.register("g", NdFrame.of(chunks(spark, GRID, list(grid_rows()))))
    got = sorted(map(str, session.sql(query).collect()))
    used = session.used_columns(query).get("g", []) or list(GRID)
    shown = tuple(c for c in GRID if c in used)
    kinds = ", ".join(f"{c} {GRID[c][0]}" for c in shown)
    spark.createDataFrame(flat(grid_rows(), shown), kinds).createOrReplaceTempView("g")
    assert got == sorted(map(str, spark.sql(query).collect()))


def test_stream_of_chunks(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    frame = tiles(spark, ("a", [100, 101], [0, 1]), ("b", [102], [0, 1]))
    frame.df.write.parquet(source)
    live = read_chunks(spark, source, frame.df.schema)
    query = live.filter("lat = 1").select("k", "time", "v").to_df().writeStream.format("memory").queryName("live_cells").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("live_cells").collect())) == [("a", 100, 1), ("a", 101, 3), ("b", 102, 1)]
    seen = []
    declared = NdFrame.of(live.df, grid_axes=["time", "lat"])
    regrid_batches(declared, lambda out, number: seen.append((number, out.cells.count())), f"file://{tmp_path}/c2").awaitTermination()
    assert seen == [(0, 6)]
