"""Queries over grids built from the shared test tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.grid import axis_order
from .operators import NdFrame, TableSink, regrid
from .plans.pruning import axis_ranges, needed
from .plans.session import NdSession
from .sources.encoding import dense, encode

# The grids


def sales(spark: SparkSession, sf_dir: str) -> NdFrame:
    """Revenue by month, nation and segment; one chunk per year."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    axes = {
        "month": spark.range(1, 13).select(F.col("id").cast("int").alias("month")),
        "nation": read("nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey"),
        "segment": read("customer").select(F.col("c_mktsegment").alias("segment")).distinct(),
    }
    df = dense(rows, [F.col("year")], axes, {"revenue": F.sum("price").cast("double")}, {"region": ("nation", "n_regionkey")})
    frame = NdFrame.of(df, grid_axes=["month", "nation", "segment"])
    return frame.select("year", ("year * 100 + month", "month"), "nation", "segment", "revenue", "region")


def dialogs(spark: SparkSession, sf_dir: str) -> NdFrame:
    """Conversations as ragged profiles; one chunk per remainder of the id by 4."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") % 4).cast("int").alias("chunk"), "conv_id", F.col("turn").cast("int").alias("turn"), "role", F.char_length("text").alias("text_len"))
    each = turns.groupBy("chunk", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text_len"))).alias("t"))
    packed = each.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("conv_id", "t"))).alias("p"), F.max(F.size("t")).alias("levels"))
    n = F.size("p")
    padded = lambda c: F.flatten(F.transform("p", lambda x: F.transform(F.sequence(F.lit(0), F.col("levels") - 1), lambda i: F.get(x["t"], i)[c])))
    one = [encode(F.transform("p", lambda x: x["conv_id"]), [n], ["n_prof"], "conv_id"), encode(F.transform("p", lambda x: F.size(x["t"])), [n], ["n_prof"], "n_turns")]
    two = [encode(padded(c), [n, F.col("levels")], ["n_prof", "n_levels"], c) for c in ("turn", "role", "text_len")]
    return NdFrame.of(packed.select("chunk", *one, *two))


def vectors(spark: SparkSession, sf_dir: str) -> NdFrame:
    """Embeddings as grids of 100 vectors by dimension."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") / 100).cast("int").alias("chunk"), "vec_id", "embedding", "label")
    packed = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("p"))
    n, d = F.size("p"), F.size(F.col("p")[0]["embedding"])
    return NdFrame.of(packed.select(
        "chunk", encode(F.transform("p", lambda x: x["vec_id"]), [n], ["vec"], "vec"), encode(F.sequence(F.lit(0), d - 1), [d], ["dim"], "dim"),
        encode(F.flatten(F.transform("p", lambda x: x["embedding"])), [n, d], ["vec", "dim"], "x"), encode(F.transform("p", lambda x: x["label"]), [n], ["vec"], "label"),
    ))


def activity(spark: SparkSession, sf_dir: str) -> NdFrame:
    """Events by day and type, in tiles of ten days by one group of types."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyyMMdd").cast("int").alias("day"), F.col("event_type").alias("etype"))
    counts = events.groupBy("day", "etype").agg(F.count("*").alias("n"))
    tile = counts.withColumn("chunk", F.concat_ws("-", F.floor(F.col("day") % 100 / 10.0001).cast("string"), (F.ascii("etype") % 2).cast("string")))
    both = tile.groupBy("chunk").agg(F.array_sort(F.collect_set("day")).alias("days"), F.array_sort(F.collect_set("etype")).alias("types"), F.map_from_entries(F.collect_list(F.struct(F.struct("day", "etype"), "n"))).alias("cells"))
    values = F.flatten(F.transform("days", lambda d: F.transform("types", lambda t: F.try_element_at("cells", F.struct(d.alias("day"), t.alias("etype"))))))
    sizes = [F.size("days"), F.size("types")]
    return NdFrame.of(both.select("chunk", encode("days", sizes[:1], ["day"], "day"), encode("types", sizes[1:], ["etype"], "etype"), encode(values, sizes, ["day", "etype"], "n")), grid_axes=["day", "etype"])


# The same as flat SQL

_SALES = """WITH rev AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS m, c_nationkey AS nation, c_mktsegment AS segment,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    years AS (SELECT DISTINCT year::INTEGER AS year FROM rev), months AS (SELECT unnest(range(1, 13)) AS m), segments AS (SELECT DISTINCT c_mktsegment AS segment FROM customer),
    nations AS (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation),
    sales AS (SELECT y.year, (y.year * 100 + months.m)::INTEGER AS month, n.nation, s.segment, r.revenue, n.region
        FROM years y CROSS JOIN months CROSS JOIN nations n CROSS JOIN segments s
        LEFT JOIN rev r ON r.year = y.year AND r.m = months.m AND r.nation = n.nation AND r.segment = s.segment) """
_DIALOGS = """WITH lens AS (SELECT conv_id % 4 AS chunk, conv_id, count(*) AS n FROM conversations GROUP BY ALL), levels AS (SELECT chunk, max(n) AS most FROM lens GROUP BY chunk),
    dialogs AS (SELECT l.chunk::INTEGER AS chunk, l.conv_id, l.n::INTEGER AS n_turns, c.turn::INTEGER AS turn, c.role, length(c.text)::INTEGER AS text_len
        FROM (SELECT chunk, conv_id, n, unnest(range(0, (SELECT max(n) FROM lens))) AS i FROM lens) l JOIN levels USING (chunk)
        LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn = l.i WHERE l.i < levels.most) """
_VECTORS = """WITH vectors AS (SELECT (vec_id // 100)::INTEGER AS chunk, vec_id AS vec, label, i::INTEGER AS dim, embedding[i + 1] AS x
        FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)) """
_ACTIVITY = """WITH counts AS (SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, event_type AS etype, count(*) AS n FROM events GROUP BY ALL),
    tiles AS (SELECT *, floor(day % 100 / 10.0001)::INTEGER || '-' || (ascii(etype) % 2) AS chunk FROM counts),
    days AS (SELECT DISTINCT chunk, day FROM tiles), types AS (SELECT DISTINCT chunk, etype FROM tiles),
    activity AS (SELECT chunk, day, etype, n FROM days JOIN types USING (chunk) LEFT JOIN tiles USING (chunk, day, etype)) """

_ALL = ["year", "month", "nation", "segment", "revenue"]
_BLOCKS = "SELECT year, (min(month)) AS month_from, nation, segment, {} AS revenue FROM sales GROUP BY year, (month % 100 - 1) // 3, nation, segment"


def _coarse(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = sales(spark, sf_dir).select("year", ("month", "month_from"), "nation", "segment", "revenue")
        coarse = frame.coarsen({"month": 3}, how)
        flat = coarse.to_df().withColumn("month_from", F.col("month_from").cast("int"))
        # The block's coordinate is reduced as well: its least is the same for all ways.
        offset = {"mean": 1, "min": 0, "max": 2, "first": 0}[how]
        # A mean's last digits depend on the order of its sum.
        revenue = F.round("revenue", 4) if how == "mean" else F.col("revenue")
        return flat.withColumns({"month_from": F.col("month_from") - offset, "nation": F.col("nation").cast("int"), "revenue": revenue})

    return run


def _ranges(spark: SparkSession) -> dict[str, DataFrame]:
    return {"time": spark.range(4).select(F.col("id").cast("int").alias("pos"), (F.col("id") + 100).alias("time")), "lat": spark.range(3).select(F.col("id").cast("int").alias("pos"), F.when(F.col("id") != 1, F.col("id") * 30.0 - 30).alias("lat"))}


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = activity(spark, sf_dir)
    known = days.df.select(F.explode(F.col("day.values")).alias("day")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("day")) - 1)
    first = days.df.select("chunk", F.get("day.values", F.lit(0)).alias("day"), F.size("day.values").alias("size")).join(known, "day")
    manifest = first.select("chunk", F.create_map(F.lit("day"), F.struct(F.col("pos").alias("origin"), "size")).alias("placement"))
    return needed(manifest, axis_ranges({"day": known}, "day % 100 BETWEEN 5 AND 12"), ["day"]).select("chunk")


def _with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = sales(spark, sf_dir)
    kind = frame.df.schema["revenue"].dataType
    broken = frame.df.withColumn("gone", F.lit(None).cast(kind))
    return NdFrame.of(broken, {**frame.dims, "gone": ("month", "nation")}).select("year", "nation", "gone").to_df()


def _scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; a session without one, as in tests, gets a folder of its own."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp(prefix='gridframe-')}/cells-{uuid.uuid4().hex}"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink that requires the whole grid has written."""
    path = _scratch(spark)
    regrid(activity(spark, sf_dir).select("n")).write(TableSink(path, requires_grid=True))
    return spark.read.parquet(path).select("day", "etype", "n")


def _sql(query: str, *tables: Callable[[SparkSession, str], NdFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = NdSession(spark)
        for t in tables:
            session.register(t.__name__ + "_grid", t(spark, sf_dir))
        return session.sql(query)

    return run


_S, _D, _V, _A = sales, dialogs, vectors, activity
_Query = Callable[[SparkSession, str], DataFrame]

#: name: (query, SQL or None)
_TABLE: dict[str, tuple[_Query, str | None]] = {
    "broadcast_full": (lambda s, d: _S(s, d).to_df(), _SALES + "SELECT * FROM sales"),
    "broadcast_count": (lambda s, d: _S(s, d).count(), _SALES + "SELECT count(*) AS count FROM sales"),
    "grid_of_selected_columns": (lambda s, d: _S(s, d).select("year", "region").to_df(), _SALES + "SELECT year, region FROM years CROSS JOIN nations"),
    "filter_column_counts_as_selected": (lambda s, d: _S(s, d).filter("segment > 'C'").select("year", "region").to_df(), _SALES + "SELECT year, region FROM years CROSS JOIN nations CROSS JOIN segments WHERE segment > 'C'"),
    "filter_one_axis": (lambda s, d: _S(s, d).filter("region = 1").to_df(), _SALES + "SELECT * FROM sales WHERE region = 1"),
    "filter_two_axes": (lambda s, d: _S(s, d).filter("region = 1", "month % 100 > 6").to_df(), _SALES + "SELECT * FROM sales WHERE region = 1 AND month % 100 > 6"),
    "filter_axis_range": (lambda s, d: _S(s, d).filter("nation BETWEEN 3 AND 9").to_df(), _SALES + "SELECT * FROM sales WHERE nation BETWEEN 3 AND 9"),
    "filter_cross_axis": (lambda s, d: _S(s, d).filter("month % 100 + nation > 20").to_df(), _SALES + "SELECT * FROM sales WHERE month % 100 + nation > 20"),
    "filter_data_variable": (lambda s, d: _S(s, d).filter("revenue > 100000").to_df(), _SALES + "SELECT * FROM sales WHERE revenue > 100000"),
    "filter_or": (lambda s, d: _S(s, d).filter("nation < 5 OR segment = 'BUILDING'").to_df(), _SALES + "SELECT * FROM sales WHERE nation < 5 OR segment = 'BUILDING'"),
    "filter_null": (lambda s, d: _S(s, d).filter("revenue IS NULL").to_df(), _SALES + "SELECT * FROM sales WHERE revenue IS NULL"),
    "filter_empty": (lambda s, d: _S(s, d).filter("nation > 1000").to_df(), _SALES + "SELECT * FROM sales WHERE nation > 1000"),
    "filter_ragged_prefix": (lambda s, d: _D(s, d).filter("turn < 2").to_df(), _DIALOGS + "SELECT * FROM dialogs WHERE turn < 2"),
    "profiles_full": (lambda s, d: _D(s, d).to_df(), _DIALOGS + "SELECT * FROM dialogs"),
    "selection_kinds": (lambda s, d: _D(s, d).filter("turn < 2").selection(), _DIALOGS + "SELECT chunk, count(*) FILTER (WHERE turn < 2) AS kept, count(*) AS total, CASE WHEN count(*) FILTER (WHERE turn < 2) = 2 * count(DISTINCT conv_id) THEN 'axis' ELSE 'ragged' END AS kind FROM dialogs GROUP BY chunk"),
    "project_one_axis": (lambda s, d: _S(s, d).select("year", ("nation * 2", "twice")).to_df(), _SALES + "SELECT year, nation * 2 AS twice FROM years CROSS JOIN nations"),
    "project_cross_axis": (lambda s, d: _S(s, d).filter("region <> 2").select("year", ("month + nation", "both"), "revenue").to_df(), _SALES + "SELECT year, month + nation AS both, revenue FROM sales WHERE region <> 2"),
    "project_literal": (lambda s, d: _S(s, d).select("year", "nation", ("7", "seven")).to_df(), _SALES + "SELECT year, nation, 7 AS seven FROM years CROSS JOIN nations"),
    "project_case": (lambda s, d: _S(s, d).select("year", "month", "nation", "segment", ("CASE WHEN revenue > 200000 THEN 'high' WHEN revenue IS NULL THEN 'none' ELSE 'low' END", "level")).to_df(), _SALES + "SELECT year, month, nation, segment, CASE WHEN revenue > 200000 THEN 'high' WHEN revenue IS NULL THEN 'none' ELSE 'low' END AS level FROM sales"),
    "residual_volatile": (lambda s, d: _S(s, d).filter("rand() < 2", "region = 3").to_df(), _SALES + "SELECT * FROM sales WHERE region = 3"),
    "volatile_per_row": (lambda s, d: _S(s, d).filter("region = 3").select("nation", ("rand() < 2", "yes")).to_df(), _SALES + "SELECT nation, true AS yes FROM years CROSS JOIN nations WHERE region = 3"),
    "union_chunks": (lambda s, d: _S(s, d).union(_S(s, d)).to_df(), _SALES + "SELECT * FROM sales UNION ALL SELECT * FROM sales"),
    "union_filtered": (lambda s, d: _S(s, d).filter("region = 1").union(_S(s, d).filter("nation < 3")).to_df(), _SALES + "SELECT * FROM sales WHERE region = 1 UNION ALL SELECT * FROM sales WHERE nation < 3"),
    "union_distinct": (lambda s, d: _S(s, d).select("region").to_df().union(_S(s, d).select("region").to_df()).distinct(), _SALES + "SELECT region FROM nations UNION SELECT region FROM nations"),
    "repartition_chunks": (lambda s, d: _S(s, d).repartition(3).filter("region = 0").coalesce(1).to_df(), _SALES + "SELECT * FROM sales WHERE region = 0"),
    "limit_cells": (lambda s, d: _S(s, d).filter("region = 1").limit(40, 1000, order=["year"]).to_df(), _SALES + "SELECT year, month, nation, segment, revenue, region FROM (SELECT *, row_number() OVER (ORDER BY year, month, nation, segment) AS r FROM sales WHERE region = 1) WHERE r > 1000 AND r <= 1040"),
    "limit_ordered": (lambda s, d: _S(s, d).select(*_ALL).to_df().orderBy(F.desc_nulls_last("revenue"), "month", "nation", "segment").limit(20), _SALES + "SELECT year, month, nation, segment, revenue FROM sales ORDER BY revenue DESC NULLS LAST, month, nation, segment LIMIT 20"),
    "limit_rows_per_partition": (lambda s, d: _S(s, d).select("year", "nation").limit_rows(10), None),
    "agg_by_axis": (lambda s, d: _S(s, d).select("nation", "revenue").to_df().groupBy("nation").agg(F.count("revenue").alias("n"), F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("total"), F.max("revenue").alias("most")), _SALES + "SELECT nation, count(revenue) AS n, sum(CAST(revenue AS DECIMAL(18,2)))::DOUBLE AS total, max(revenue) AS most FROM sales GROUP BY nation"),
    "agg_scalar_attr": (lambda s, d: _S(s, d).select("year", "revenue").to_df().groupBy("year").agg(F.min("revenue").alias("least"), F.max("revenue").alias("most")), _SALES + "SELECT year, min(revenue) AS least, max(revenue) AS most FROM sales GROUP BY year"),
    "agg_case": (_sql("SELECT CASE WHEN revenue > 200000 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM sales_grid GROUP BY 1", sales), _SALES + "SELECT CASE WHEN revenue > 200000 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM sales GROUP BY 1"),
    "agg_rollup": (lambda s, d: _S(s, d).select("region", "segment", "revenue").to_df().rollup("region", "segment").agg(F.count("revenue").alias("n")), _SALES + "SELECT region, segment, count(revenue) AS n FROM sales GROUP BY ROLLUP (region, segment)"),
    "sql_count_all": (_sql("SELECT count(*) AS n FROM sales_grid", sales), _SALES + "SELECT count(*) AS n FROM sales"),
    "sql_axis_only": (_sql("SELECT region FROM sales_grid WHERE nation > 10", sales), _SALES + "SELECT region FROM years CROSS JOIN nations WHERE nation > 10"),
    "sql_union_all": (_sql("SELECT nation, revenue FROM sales_grid WHERE nation > 20 UNION ALL SELECT nation, revenue FROM sales_grid WHERE revenue < 50000", sales), _SALES + "SELECT nation, revenue FROM sales WHERE nation > 20 UNION ALL SELECT nation, revenue FROM sales WHERE revenue < 50000"),
    "sql_join_tables": (_sql("SELECT a.n, b.k FROM (SELECT count(*) AS n FROM dialogs_grid WHERE turn IS NOT NULL) a CROSS JOIN (SELECT count(*) AS k FROM sales_grid WHERE region = 4) b", sales, dialogs), _SALES + "SELECT (SELECT count(*) FROM conversations) AS n, (SELECT count(*) FROM years CROSS JOIN nations WHERE region = 4) AS k"),
    "join_on_coordinate": (lambda s, d: _S(s, d).filter("month % 100 = 1").select("year", "nation", "segment", "revenue").to_df().join(s.read.parquet(f"{d}/nation.parquet"), F.col("nation") == F.col("n_nationkey")).select("year", "n_name", "segment", "revenue"), _SALES + "SELECT year, n_name, segment, revenue FROM sales JOIN nation ON nation = n_nationkey WHERE month % 100 = 1"),
    "semi_join_on_coordinate": (lambda s, d: _S(s, d).select("year", "nation").to_df().join(s.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 2"), F.col("nation") == F.col("n_nationkey"), "left_semi"), _SALES + "SELECT year, nation FROM years CROSS JOIN nations WHERE region = 2"),
    "anti_join_on_coordinate": (lambda s, d: _S(s, d).select("year", "nation").to_df().join(s.read.parquet(f"{d}/nation.parquet").where("n_regionkey = 2"), F.col("nation") == F.col("n_nationkey"), "left_anti"), _SALES + "SELECT year, nation FROM years CROSS JOIN nations WHERE region <> 2"),
    "outer_join_on_coordinate": (lambda s, d: _S(s, d).filter("nation < 5").select("year", "nation").to_df().join(s.read.parquet(f"{d}/nation.parquet").where("n_nationkey > 2").select("n_nationkey", "n_name"), F.col("nation") == F.col("n_nationkey"), "full"), _SALES + "SELECT year, nation, n_nationkey, n_name FROM (SELECT year, nation FROM years CROSS JOIN nations WHERE nation < 5) FULL JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 2) ON nation = n_nationkey"),
    "theta_join_on_coordinate": (lambda s, d: _S(s, d).filter("region = 1").select("year", "nation").to_df().alias("a").join(_S(s, d).select("year", "nation").to_df().alias("b"), F.expr("a.year = b.year AND b.nation BETWEEN a.nation + 1 AND a.nation + 2")).selectExpr("a.year", "a.nation", "b.nation AS later"), _SALES + "SELECT a.year, a.nation, b.nation AS later FROM (SELECT * FROM years CROSS JOIN nations) a JOIN (SELECT * FROM years CROSS JOIN nations) b ON a.year = b.year AND b.nation BETWEEN a.nation + 1 AND a.nation + 2 WHERE a.region = 1"),
    "sql_intersect": (_sql("SELECT region FROM sales_grid WHERE nation < 9 INTERSECT SELECT region FROM sales_grid WHERE nation > 14", sales), _SALES + "SELECT region FROM nations WHERE nation < 9 INTERSECT SELECT region FROM nations WHERE nation > 14"),
    "except_of_grids": (lambda s, d: _S(s, d).select("nation").to_df().subtract(_S(s, d).filter("region = 3").select("nation").to_df()), _SALES + "SELECT nation FROM nations WHERE region <> 3"),
    "window_over_axis": (lambda s, d: _S(s, d).filter("segment = 'BUILDING'").select("month", "nation", "revenue", "segment").to_df().withColumn("prev", F.lag("revenue").over(Window.partitionBy("nation").orderBy("month"))).drop("segment"), _SALES + "SELECT month, nation, revenue, lag(revenue) OVER (PARTITION BY nation ORDER BY month) AS prev FROM sales WHERE segment = 'BUILDING'"),
    "compact_rectangle": (lambda s, d: _S(s, d).filter("region = 1", "month % 100 > 6").compact().to_df(), _SALES + "SELECT * FROM sales WHERE region = 1 AND month % 100 > 6"),
    "compact_mask_nulls": (lambda s, d: _S(s, d).filter("month % 100 + nation > 20").compact().to_df(), _SALES + "SELECT year, month, nation, segment, CASE WHEN month % 100 + nation > 20 THEN revenue END AS revenue, region FROM sales"),
    "encode_roundtrip": (lambda s, d: NdFrame.of(_S(s, d).filter("region = 2").to_encoded()).to_df(), _SALES + "SELECT * FROM sales WHERE region = 2"),
    "coarsen_min": (_coarse("min"), _SALES + _BLOCKS.format("min(revenue)")),
    "coarsen_max": (_coarse("max"), _SALES + _BLOCKS.format("max(revenue)")),
    "coarsen_first": (_coarse("first"), _SALES + _BLOCKS.format("max(revenue) FILTER (WHERE (month % 100 - 1) % 3 = 0)")),
    "coarsen_mean": (_coarse("mean"), _SALES + _BLOCKS.format("round(avg(revenue), 4)")),
    "regrid_union": (lambda s, d: regrid(_S(s, d).select("revenue")).cells.select("pos_month", "pos_nation", "pos_segment", "revenue"), _SALES + "SELECT dense_rank() OVER (ORDER BY month) - 1 AS pos_month, dense_rank() OVER (ORDER BY nation) - 1 AS pos_nation, dense_rank() OVER (ORDER BY segment) - 1 AS pos_segment, revenue FROM sales"),
    "regrid_sparse": (lambda s, d: regrid(_A(s, d).select("n")).dense().select("day", "etype", "n"), _ACTIVITY + "SELECT day, etype, n FROM (SELECT DISTINCT day FROM days) CROSS JOIN (SELECT DISTINCT etype FROM types) LEFT JOIN activity USING (day, etype)"),
    "regrid_descending": (lambda s, d: regrid(NdFrame.of(_A(s, d).df, grid_axes=[("day", True), "etype"]).select("n")).cells.select("pos_day", "pos_etype", "n"), _ACTIVITY + "SELECT dense_rank() OVER (ORDER BY day DESC) - 1 AS pos_day, dense_rank() OVER (ORDER BY etype) - 1 AS pos_etype, n FROM activity"),
    "regrid_overlap_check": (lambda s, d: regrid(_doubled(s, d)).overlaps("chunk").select(F.col("pos_day").alias("day_at"), F.col("pos_etype").alias("type_at"), F.array_join("chunks", "|").alias("chunks")), _ACTIVITY + "SELECT day_at, type_at, chunk || '|again' AS chunks FROM (SELECT chunk, dense_rank() OVER (ORDER BY day) - 1 AS day_at, dense_rank() OVER (ORDER BY etype) - 1 AS type_at FROM activity) WHERE chunk LIKE '0%'"),
    "grid_sink_count": (lambda s, d: regrid(_A(s, d).select("n")).write(TableSink(_scratch(s))), _ACTIVITY + "SELECT count(*) AS count FROM activity"),
    "grid_sink_dense": (_written, _ACTIVITY + "SELECT day, etype, n FROM (SELECT DISTINCT day FROM days) CROSS JOIN (SELECT DISTINCT etype FROM types) LEFT JOIN activity USING (day, etype)"),
    "coordinates_added": (lambda s, d: _S(s, d).filter("region = 1").select("revenue").with_coordinates().to_df(), _SALES + "SELECT revenue, month, nation, segment FROM sales WHERE region = 1"),
    "axis_ranges": (lambda s, d: axis_ranges(_ranges(s), "time >= 101 AND time <> 102", "lat > -40", "sst > 3"), "SELECT * FROM (VALUES ('time', 1, 2), ('time', 3, 4), ('lat', 0, 1), ('lat', 2, 3)) t(axis, start, stop)"),
    "chunks_pruned": (_pruned, _ACTIVITY + "SELECT DISTINCT chunk FROM days WHERE day % 100 BETWEEN 5 AND 12"),
    "missing_column_is_null": (_with_missing, _SALES + "SELECT year, nation, CAST(NULL AS DOUBLE) AS gone FROM years CROSS JOIN nations"),
    "axis_order_detect": (lambda s, d: _S(s, d).df.select("year", axis_order("month.values").alias("by_month"), axis_order("region.values").alias("by_region"), axis_order(F.reverse("nation.values")).alias("backwards")), _SALES + "SELECT year, 'ascending' AS by_month, 'unordered' AS by_region, 'descending' AS backwards FROM years"),
    "work_counts": (lambda s, d: _S(s, d).filter("region = 1").work(), _SALES + "SELECT year, 1500::BIGINT AS cells, (12 + 25 + 5 + 1500 + 25)::BIGINT AS stored, 25::BIGINT AS compared FROM years"),
    "embeddings_cells": (lambda s, d: _V(s, d).filter("dim < 3", "x > 0.1").to_df(), _VECTORS + "SELECT chunk, vec, dim, x, label FROM vectors WHERE dim < 3 AND x > 0.1"),
    "embeddings_by_label": (lambda s, d: _V(s, d).filter("dim = 0").select("label", "x", "dim").to_df().groupBy("label").agg(F.count("x").alias("n"), F.max("x").alias("most")), _VECTORS + "SELECT label, count(x) AS n, max(x) AS most FROM vectors WHERE dim = 0 GROUP BY label"),
}


def _doubled(spark: SparkSession, sf_dir: str) -> NdFrame:
    """The tiles, and those of the first days once more as one named ``again``."""
    tiles = activity(spark, sf_dir)
    twice = tiles.df.unionByName(tiles.df.where("chunk LIKE '0%'").withColumn("chunk", F.lit("again")))
    return NdFrame.of(twice, grid_axes=["day", "etype"]).select("n", "chunk")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation of one region: a filter on an axis, a projection on it, and an aggregate on flat rows."""
    flat = sales(spark, sf_dir).filter("region = 1").select(("nation * 10 + region", "code"), "revenue").to_df()
    return flat.groupBy("code").agg(F.count("revenue").alias("n"), F.sum(F.col("revenue").cast("decimal(18,2)")).alias("total"))


QUERIES: dict[str, _Query] = {name: q for name, (q, _) in _TABLE.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _TABLE.items() if sql}
