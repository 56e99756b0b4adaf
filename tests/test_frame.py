"""Grid frames against a cell-by-cell evaluation in Python, on small grids of known values."""

import itertools
import math

import pytest

from gridframe.operators import NdFrame
from gridframe.operators.frame import NdPlanError
from gridframe.sources.encoding import chunks

GRID = {"time": ("long", ["time"]), "lat": ("double", ["lat"]), "lon": ("double", ["lon"]), "sst": ("double", ["time", "lat", "lon"]), "elev": ("double", ["lat", "lon"]), "source": ("string", [])}
AXES = {n: d for n, (_, d) in GRID.items()}


def grid_rows():
    """Two chunks of two times: 3 latitudes, 2 longitudes, some nulls."""
    for k in (0, 1):
        sst = [None if c % 7 == 3 else 0.5 * c for c in range(12 * k, 12 * k + 12)]
        yield {"time": ([100 + 2 * k, 101 + 2 * k], [2]), "lat": ([-30.0, 0.0, 30.0], [3]), "lon": ([5.0, 15.0], [2]), "sst": (sst, [2, 3, 2]), "elev": ([-100.0, -50.0, 0.0, 50.0, 100.0, 150.0], [3, 2]), "source": (["ship"], [])}


def flat(rows, shown, used=(), test=lambda r: True):
    """The rows of chunks on the grid of the shown and used columns."""
    out = []
    for row in rows:
        names = [c for c in GRID if c in shown or c in used]
        size = {a: n for c in names for a, n in zip(AXES[c], row[c][1], strict=True)}
        axes = max((AXES[c] for c in reversed(names)), key=len, default=[])  # the last of the widest
        axes = [*axes, *(a for a in size if a not in axes)]
        for at in itertools.product(*(range(size[a]) for a in axes)):
            place = dict(zip(axes, at, strict=True))
            cell = {}
            for c in names:
                i = 0
                for a, n in zip(AXES[c], row[c][1], strict=True):
                    i = i * n + place[a]
                cell[c] = row[c][0][i]
            if test(cell):
                out.append(tuple(cell[c] for c in shown))
    return out


@pytest.fixture(scope="module")
def grid(spark):
    return NdFrame.of(chunks(spark, GRID, list(grid_rows())).repartition(2), grid_axes=["time", "lat", "lon"])


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


FILTERS = [
    (["lat > 0"], ["lat"], lambda r: r["lat"] > 0),
    (["lat >= 0", "lon = 15"], ["lat", "lon"], lambda r: r["lat"] >= 0 and r["lon"] == 15),
    (["lat + lon > 10"], ["lat", "lon"], lambda r: r["lat"] + r["lon"] > 10),
    (["sst > 3"], ["sst"], lambda r: r["sst"] is not None and r["sst"] > 3),
    (["sst IS NULL"], ["sst"], lambda r: r["sst"] is None),
    (["elev >= 0"], ["elev"], lambda r: r["elev"] >= 0),
    (["lat < 0 OR lon = 5"], ["lat", "lon"], lambda r: r["lat"] < 0 or r["lon"] == 5),
    (["lat BETWEEN -10 AND 40", "time > 100", "sst * 2 < 15"], ["lat", "time", "sst"], lambda r: -10 <= r["lat"] <= 40 and r["time"] > 100 and r["sst"] is not None and r["sst"] * 2 < 15),
    (["source = 'ship'", "time <> 102"], ["source", "time"], lambda r: r["time"] != 102),
    (["lat > 100"], ["lat"], lambda r: False),
    (["CASE WHEN lat > 0 THEN lon ELSE 0 END = 5"], ["lat", "lon"], lambda r: (r["lon"] if r["lat"] > 0 else 0) == 5),
]
SHOWN = [("time", "lat", "lon", "sst"), ("lat",), ("source", "elev"), ("sst",)]


@pytest.mark.parametrize("shown", SHOWN)
@pytest.mark.parametrize("case", FILTERS, ids=lambda c: " and ".join(c[0]))
def test_filters(grid, case, shown):
    predicates, used, test = case
    got = grid.filter(*predicates).select(*shown)
    want = flat(grid_rows(), shown, used, test)
    assert collected(got.to_df()) == sorted(want, key=str)
    assert grid.select(*shown).filter(*predicates).count().first()[0] == len(want)


def test_row_counts(grid):
    for shown, predicates, n in [(("sst",), [], 24), (("elev",), [], 12), (("source", "elev"), ["elev >= 0"], 8), (("lat",), [], 6), (("lat",), ["time > 100"], 9)]:
        assert grid.select(*shown).filter(*predicates).to_df().count() == n


def test_projections(grid):
    got = grid.filter("lon = 5").select("time", "lat", ("lat * 2", "twice"), ("lat + time", "both"), ("7", "seven"), ("coalesce(sst, -1)", "sst")).to_df()
    want = [(t, y, y * 2, y + t, 7, -1 if s is None else s) for t, y, s in flat(grid_rows(), ("time", "lat", "sst"), ("lon",), lambda r: r["lon"] == 5)]
    assert collected(got) == sorted(want, key=str)


def test_projection_that_renames_a_filtered_column(grid):
    got = grid.filter("lat > 0").select(("lat * 0", "lat"), "lon").to_df()
    assert collected(got) == [(0.0, 15.0), (0.0, 15.0), (0.0, 5.0), (0.0, 5.0)]


@pytest.mark.parametrize("predicates", [["lat > -10", "lon = 5"], ["lat + lon > 10"], ["sst > 3"]])
def test_compaction_and_encoding(grid, predicates):
    box = "lon = 5" in predicates
    frame = grid.filter(*predicates)
    again = NdFrame.of(frame.to_encoded())
    if box:
        assert collected(again.to_df()) == collected(frame.to_df())
        assert again.df.select("sst.dim_sizes").first()[0] == [2, 2, 1]
    else:  # the grid stays; full-span columns are null where dropped
        kept = collected(frame.select("time", "lat", "lon", "sst").to_df().where("sst IS NOT NULL"))
        assert collected(again.select("time", "lat", "lon", "sst").to_df().where("sst IS NOT NULL")) == kept


def test_limits(grid):
    rows = flat(grid_rows(), ("time", "lat", "lon"), ("lat",), lambda r: r["lat"] >= 0)
    keyed = NdFrame.of(grid.df.withColumn("k", grid.df["time.values"][0]))
    for offset, n in [(0, 3), (2, 7), (0, 0), (12, 99), (99, 1), (7, 2)]:
        got = keyed.filter("lat >= 0").select("time", "lat", "lon").limit(n, offset, order=["k"]).to_df()
        assert collected(got) == sorted(rows[offset : offset + n], key=str)
    once_more = keyed.select("time", "lat", "lon").limit(8, 2, order=["k"]).filter("lat > 0").to_df()
    some = flat(grid_rows(), ("time", "lat", "lon"))[2:10]
    assert collected(once_more) == sorted((r for r in some if r[1] > 0), key=str)
    narrower = keyed.select("time", "lat", "lon").limit(8, 2, order=["k"]).select("lat", ("time + lat", "both"))
    assert collected(narrower.to_df()) == sorted(((r[1], r[0] + r[1]) for r in some), key=str)
    with pytest.raises(NdPlanError):
        keyed.limit(1, order=["k"]).filter("rand() < 2")


def test_union_and_declared_axes(grid):
    both = grid.union(grid.filter("lat > 0"))
    assert both.to_df().count() == 24 + 8 and both.grid_axes == grid.grid_axes
    assert grid.union(NdFrame.of(grid.df, grid_axes=["time"])).grid_axes is None
    with pytest.raises(NdPlanError):
        grid.union(grid.select("lat"))


def blocks(values, factor):
    return [values[i : i + factor] for i in range(0, len(values), factor)]


def test_coarsen(grid):
    first = NdFrame.of(grid.df.where("time.values[0] = 100"))
    one = first.coarsen({"lat": 2}, "mean")
    row = one.df.first()
    assert row["sst"]["dim_sizes"] == [2, 2, 2] and row["lat"]["values"] == [-15, 30] and row["elev"]["values"] == [-50, 0, 100, 150]
    assert [f.dataType["values"].dataType.elementType.simpleString() for f in one.df.schema if f.name == "time"] == ["double"]
    assert first.coarsen({"time": 2}, "min").df.first()["time"]["values"] == [100]
    assert first.coarsen({"time": 2}, "max").df.first()["time"]["values"] == [101]
    every = first.coarsen({"time": 2, "lat": 3, "lon": 2}, "mean").df.first()["sst"]["values"]
    known = [0.5 * c for c in range(12) if c % 7 != 3]
    assert every == [pytest.approx(sum(known) / len(known))]
    assert first.coarsen({"lat": 1}, "first").df.first()["sst"]["values"] == first.df.first()["sst"]["values"]
    with pytest.raises(NdPlanError):
        first.coarsen({"lat": 0}, "mean")
    with pytest.raises(NdPlanError):
        first.coarsen({"lat": 2}, "median")


def test_coarsen_passes_over_nan(spark):
    frame = NdFrame.of(chunks(spark, {"x": ("double", ["x"])}, [{"x": ([1.0, math.nan, math.nan, math.nan, None, 5.0], [6])}]))
    got = frame.coarsen({"x": 2}, "max").df.first()["x"]["values"]
    assert got[0] == 1 and math.isnan(got[1]) and got[2] == 5


MICRO = {"lat": ("int", ["lat"]), "lon": ("int", ["lon"]), "temp": ("int", ["lat", "lon"])}


@pytest.mark.parametrize(
    ("predicate", "cells"),
    [("lat > 15", [2, 3, 4, 5]), ("lon = 2", [1, 3, 5]), ("lat > 15 AND lon = 2", [3, 5]), ("lat + lon > 22", [4, 5]), ("lat > 10 AND lat < 30", [2, 3]), ("temp >= 3", [3, 4, 5]), ("lat < 15 OR lon = 2", [0, 1, 3, 5]), ("lat > 100", []), ("lat >= 10", [0, 1, 2, 3, 4, 5])],
)
def test_kept_cells(spark, predicate, cells):
    frame = NdFrame.of(chunks(spark, MICRO, [{"lat": ([10, 20, 30], [3]), "lon": ([1, 2], [2]), "temp": (list(range(6)), [3, 2])}]))
    assert sorted(r["temp"] for r in frame.filter(predicate).select("temp").to_df().collect()) == cells


def test_selection_kinds(spark):
    frame = NdFrame.of(chunks(spark, {"p": ("int", ["prof", "level"])}, [{"p": ([10, 20, 30, 10, 30, 40], [2, 3])}]))
    kind = lambda f: tuple(f.selection().first())
    assert kind(frame.filter("p < 25")) == (3, 6, "ragged")
    assert kind(frame.filter("p > 0")) == (6, 6, "full")
    assert kind(frame.filter("p = 40")) == (1, 6, "axis")
    assert kind(frame.filter("p = 30")) == (2, 6, "mask")


def test_null_coordinates_missing_columns_and_narrow_axes(spark):
    frame = NdFrame.of(chunks(spark, {**MICRO, "depth": ("int", ["depth"])}, [{"lat": ([10, None, 30], [3]), "lon": ([1, 2], [2]), "temp": (list(range(6)), [3, 2]), "depth": None}, {"lat": ([10, 20, 30], [3]), "lon": ([1, 2], [2]), "temp": (list(range(6)), [3, 2]), "depth": ([1, 2], [2])}]))
    assert sorted(r[0] for r in frame.filter("lat > 15").select("temp").to_df().collect()) == [2, 3, 4, 4, 5, 5]
    rows = frame.select("temp", "depth").to_df().collect()
    assert len(rows) == 6 + 12 and sum(r["depth"] is None for r in rows) == 6


def test_empty_axes_and_tables(spark):
    frame = NdFrame.of(chunks(spark, {"time": ("int", ["time"]), "v": ("int", ["time", "lat"])}, [{"time": ([], [0]), "v": ([], [0, 3])}]))
    assert frame.to_df().count() == 0 and frame.count().first()[0] == 0 and frame.to_encoded().count() == 1
    none = NdFrame.of(frame.df.limit(0))
    assert none.filter("time > 0").to_df().count() == 0 and none.count().first()[0] == 0 and none.coarsen({"time": 2}).df.count() == 0


def test_sizes_that_do_not_match(spark):
    frame = NdFrame.of(chunks(spark, {"a": ("int", ["x"]), "b": ("int", ["x"])}, [{"a": ([1, 2], [2]), "b": ([1, 2, 3], [3])}]))
    with pytest.raises(Exception, match="sizes of axis x"):
        frame.to_df().collect()


def test_axes_in_another_order_in_a_chunk(spark):
    frame = NdFrame.of(chunks(spark, MICRO, [{"lat": ([10, 20, 30], [3]), "lon": ([1, 2], [2]), "temp": ([0, 2, 4, 1, 3, 5], [2, 3], ["lon", "lat"])}]))
    assert collected(frame.to_df()) == [(10, 1, 0), (10, 2, 1), (20, 1, 2), (20, 2, 3), (30, 1, 4), (30, 2, 5)]


def test_unknown_columns_and_axes(spark, grid):
    with pytest.raises(NdPlanError):
        grid.select("nothing")
    bare = spark.createDataFrame([([1], [1], ["x"])], "values array<int>, dim_sizes array<int>, dim_names array<string>").selectExpr("struct(values, dim_sizes, dim_names) AS a")
    with pytest.raises(NdPlanError):
        NdFrame.of(bare)
    assert NdFrame.of(bare, {"a": ["x"]}).to_df().count() == 1


def test_predicates_are_split_at_and(grid):
    one = grid.filter("lat > -10 AND lon = 5 AND (time > 100 OR lat < 0)").select("time", "lat", "lon", "sst")
    assert [a for a, _ in one.on_axis] == ["lat", "lon"] and len(one.residual) == 1
    assert collected(one.to_df()) == sorted(flat(grid_rows(), ("time", "lat", "lon", "sst"), (), lambda r: r["lat"] > -10 and r["lon"] == 5 and (r["time"] > 100 or r["lat"] < 0)), key=str)
    assert [a for a, _ in grid.filter("lat BETWEEN -10 AND 40 and source like 'sh%'").on_axis][0] == "lat"


def test_random_functions_are_per_row(grid):
    rows = grid.select("lat", "lon", ("uniform(0, 1000000)", "u")).to_df().collect()
    assert len({r["u"] for r in rows}) > 1


def test_explain_names_the_region(grid):
    text = grid.filter("lat > 0").select("sst").explain()
    assert "boundary" in text and "filter lat > 0 on lat" in text and "grid_axes=[time, lat, lon]" in text


def test_the_boundary_reads_only_what_is_used(grid, tmp_path, spark):
    path = f"file://{tmp_path}/grid"
    grid.df.write.parquet(path)
    back = NdFrame.of(spark.read.parquet(path))
    assert collected(back.to_df()) == collected(grid.to_df())
    plan = back.filter("lat > 0").select("elev").to_df()._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "elev" in schema and "sst" not in schema and "Exchange" not in plan and "Python" not in plan


def test_value_counts_are_checked(spark):
    for values in ([1.0, 2.0, 3.0], [1.0]):
        broken = NdFrame.of(chunks(spark, {"lat": ("double", ["lat"]), "t": ("double", ["lat"])}, [{"lat": ([0.0, 1.0], [2]), "t": (values, [2])}]))
        with pytest.raises(Exception, match="more or fewer values"):
            broken.to_df().collect()
        assert broken.select("lat").to_df().count() == 2
    empty = NdFrame.of(chunks(spark, {"lat": ("double", ["lat"])}, [{"lat": ([], [0])}]))
    assert empty.to_df().count() == 0


def test_projected_columns_are_computed_once(spark, grid):
    case = grid.select("time", ("CASE WHEN sst > 3 THEN 'warm' WHEN sst IS NULL THEN 'none' ELSE 'cold' END", "level"))
    plan = case.select("time", ("concat(level, '!')", "loud")).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("warm") == 1
    want = flat(grid_rows(), ["time", "sst"], used=["sst"])
    assert collected(case.to_df()) == sorted(((t, "none" if s is None else "warm" if s > 3 else "cold") for t, s in want), key=str)
    assert case.df.schema["level"].metadata["nd.array"]["dims"] == ["time", "lat", "lon"]


def test_expressions_see_the_columns_as_they_were(grid):
    got = grid.select(("lat * 2", "lat"), ("lat + 1", "more")).to_df()
    assert collected(got) == sorted(((2 * x, x + 1) for (x,) in flat(grid_rows(), ["lat"])), key=str)
