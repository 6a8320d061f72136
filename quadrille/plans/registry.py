"""The driver's queries, each with equivalent SQL where SQL can express it. Column types are fixed on both sides by
the query's schema: s string, l bigint, d double, b boolean, x as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..formula import evaluate as ev
from ..formula import generalise as gen
from ..functions import scalar as fn
from ..operators import aggregate as agg
from ..operators import cluster, discover, rdf, rect
from ..operators import grid as g
from ..sinks import dot_lines, graphml_lines, rendered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_SPARK, _DUCK = {"s": "string", "l": "bigint", "d": "double", "b": "boolean"}, {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(schema: str, sql: str | None = None):
    fields = [f.split(":") for f in schema.split()]

    def register(fn_: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn_(Tables(spark, sf_dir)).select(*[F.col(n).cast(_SPARK[k]).alias(n) if k in _SPARK else F.col(n) for n, k in fields])

        QUERIES[fn_.__name__] = run
        if sql:
            SQL[fn_.__name__] = f"SELECT {', '.join(f'CAST({n} AS {_DUCK[k]}) AS {n}' if k in _DUCK else n for n, k in fields)} FROM ({sql}) AS q"
        return fn_

    return register


# Sheets that queries share, and the same in SQL.


def nation_sheet(t: Tables) -> DataFrame:
    return g.as_sheet(t.nation, "nation", ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"], "w")


def region_sheet(t: Tables) -> DataFrame:
    return g.as_sheet(t.region, "region", ["r_regionkey"], ["r_regionkey", "r_name"], "w")


def supplier_sheet(t: Tables) -> DataFrame:
    return g.as_sheet(t.supplier, "supplier", ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"], "w")


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINES]


def lineitem_sheet(t: Tables) -> DataFrame:
    """Quantity, price, discount, tax, and the charge with its formula."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    y = F.col("_y").cast("string")
    formula = F.concat(F.lit("of:=[.B"), y, F.lit("]*(1-[.C"), y, F.lit("])*(1+[.D"), y, F.lit("])"))
    own = t.lineitem.select(*LINE_ORDER).withColumn("charge", charge)
    return g.as_sheet(own, "lineitem", LINE_ORDER, [*LINES, "charge"], "w", {"charge": formula})


_N = "(SELECT row_number() OVER (ORDER BY n_nationkey) AS y, * FROM nation)"
NATION = f"""(SELECT 1 AS x, y, 'float' AS vtype, n_nationkey::DOUBLE AS num, NULL AS str FROM {_N} UNION ALL
 SELECT 2, y, 'string', NULL, n_name FROM {_N} UNION ALL SELECT 3, y, 'float', n_regionkey::DOUBLE, NULL FROM {_N})"""
_R = "(SELECT row_number() OVER (ORDER BY r_regionkey) AS y, * FROM region)"
REGION = f"(SELECT 1 AS x, y, 'float' AS vtype, r_regionkey::DOUBLE AS num, NULL AS str FROM {_R} UNION ALL SELECT 2, y, 'string', NULL, r_name FROM {_R})"
_S = "(SELECT row_number() OVER (ORDER BY s_suppkey) AS y, * FROM supplier)"
_L = f"(SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS y, * FROM lineitem)"


def part_rects(t: Tables) -> DataFrame:
    """A rectangle per part, on its brand's sheet; the area grows with the number of parts."""
    k = F.col("p_partkey")
    rects = t.part.select(k.alias("id"), F.col("p_brand").alias("sheet"), (k * 7 % 40 + 1).alias("sx"), (F.floor(k / 25) + k * 13 % 30 + 1).alias("sy"), "p_size")
    return rects.select("id", "sheet", "sx", "sy", (F.col("sx") + F.col("p_size") % 9).alias("ex"), (F.col("sy") + F.col("p_size") % 6).alias("ey"))


RECTS = """(SELECT *, sx + p_size % 9 AS ex, sy + p_size % 6 AS ey FROM (SELECT p_partkey AS id, p_brand AS sheet, p_partkey * 7 % 40 + 1 AS sx,
 p_partkey // 25 + p_partkey * 13 % 30 + 1 AS sy, p_size FROM part))"""
NAME = "CASE WHEN {0} <= 26 THEN chr(({0} + 64)::INT) WHEN {0} <= 702 THEN chr((({0} - 27) // 26 + 65)::INT) || chr((({0} - 27) % 26 + 65)::INT) ELSE chr((({0} - 703) // 676 + 65)::INT) || chr((({0} - 703) // 26 % 26 + 65)::INT) || chr((({0} - 703) % 26 + 65)::INT) END"


def name_sql(x: str) -> str:
    return "(" + NAME.format(x) + ")"


# Cells


@query("x:l y:l vtype:s num:d str:s", f"SELECT * FROM {NATION}")
def cell_value_scan(t):
    return g.cell_value(nation_sheet(t), sheet="nation")


@query("x:l y:l vtype:s has_formula:b quotes:b nth:s", f"SELECT x, y, vtype, false AS has_formula, regexp_matches('nation x', '[\\]. #$]') AS quotes, (SELECT str FROM {NATION} WHERE x = 2 AND y = 3) AS nth FROM {NATION} WHERE vtype = 'string'")
def cell_props(t):
    cells = nation_sheet(t)
    third = g.select_cells(cells, x=2, y=3).select(F.col("str").alias("nth")).limit(1)
    own = g.cell_type(cells).join(g.cell_formula(cells).select("workbook", "sheet", "x", "y", F.lit(True).alias("has_formula")), ["workbook", "sheet", "x", "y"], "left")
    return own.filter("vtype = 'string'").withColumns({"has_formula": F.coalesce("has_formula", F.lit(False)), "quotes": g.needs_quotes(F.lit("nation x"))}).crossJoin(third)


@query("x:l y:l packed:l ux:l uy:l", f"SELECT x, y, y * 10000 + x AS packed, x AS ux, y AS uy FROM {NATION}")
def cell_id_pack(t):
    packed = nation_sheet(t).withColumn("packed", g.cell_id(F.col("x"), F.col("y")))
    ux, uy = g.unpack_id(F.col("packed"))
    return packed.withColumns({"ux": ux, "uy": uy})


@query("p_partkey:l name:s back:l", f"SELECT p_partkey, {name_sql('n')} AS name, n AS back FROM (SELECT p_partkey, p_partkey * 31 % 18278 + 1 AS n FROM part)")
def column_names(t):
    n = t.part.select("p_partkey", (F.col("p_partkey") * 31 % 18278 + 1).alias("n"))
    return n.withColumn("name", g.column_name(F.col("n"))).withColumn("back", g.column_index(F.col("name")))


@query("x:l y:l class:s", f"SELECT gx.x, gy.y, coalesce(c.vtype, 'empty') AS class FROM range(0, 4) gx(x), (SELECT unnest(range(0, max(y) + 2)) AS y FROM {REGION}) gy LEFT JOIN {REGION} c ON c.x = gx.x AND c.y = gy.y")
def cell_class_grid(t):
    return g.cell_class(region_sheet(t))


@query("x:l y:l", f"SELECT x, y FROM (SELECT y, unnest([1, 2, 3]) AS x FROM {_S}) c WHERE NOT EXISTS (SELECT 1 FROM part WHERE c.x BETWEEN p_size AND p_size + 1 AND c.y = p_partkey // 20 + 1)")
def cells_outside_tables(t):
    """Suppliers' cells outside the tables that the parts lay out, some twenty parts to a row."""
    y = F.floor(F.col("p_partkey") / 20) + 1
    size = F.col("p_size")
    rects = t.part.select(F.lit("w").alias("workbook"), F.lit("supplier").alias("sheet"), size.alias("sx"), y.alias("sy"), (size + 1).alias("ex"), y.alias("ey"))
    return g.cells_outside(supplier_sheet(t), rects)


@query("pos:l num:d str:s", "SELECT row_number() OVER (ORDER BY (num IS NULL), num, str) AS pos, num, str FROM (SELECT s_suppkey::DOUBLE AS num, NULL AS str FROM supplier UNION ALL SELECT NULL, s_name FROM supplier)")
def sorted_mixed(t):
    cells = g.select_cells(supplier_sheet(t)).filter("x <= 2")
    return cells.withColumn("key", g.sort_key()).withColumn("pos", F.row_number().over(Window.orderBy("key"))).select("pos", "num", "str")


# Rectangles


@query("id:l w:l h:l n:l empty:b name:s gx:l gy:l hx:l hy:l uy:l", f"SELECT id, ex - sx + 1 AS w, ey - sy + 1 AS h, (ex - sx + 1) * (ey - sy + 1) AS n, false AS empty, 'B[' || CASE WHEN regexp_matches(sheet, '[\\]. #$]') THEN '''' || sheet || '''' ELSE sheet END || '.' || {name_sql('sx')} || sy || ':' || {name_sql('ex')} || ey || ']' AS name, sx - 1 AS gx, sy - 1 AS gy, ex + 1 AS hx, ey + 1 AS hy, greatest(ey, 5) AS uy FROM {RECTS}")
def rect_props(t):
    w, h, n = rect.size()
    gx, gy, hx, hy = rect.grow(1)
    fixed = {"b_sx": F.lit(1), "b_sy": F.lit(1), "b_ex": F.lit(2), "b_ey": F.lit(5)}
    named = part_rects(t).withColumns(fixed).withColumns({f"a_{c}": F.col(c) for c in rect.RECT})
    return named.select("id", w.alias("w"), h.alias("h"), n.alias("n"), rect.is_empty().alias("empty"), rect.rect_id("B").alias("name"), gx.alias("gx"), gy.alias("gy"), hx.alias("hx"), hy.alias("hy"), rect.union("a_", "b_")["ey"].alias("uy"))


@query("id:l side:s pos:l", f"SELECT id, 'left' AS side, sx AS pos FROM {RECTS} UNION ALL SELECT id, 'right', ex FROM {RECTS} UNION ALL SELECT id, 'top', sy FROM {RECTS} UNION ALL SELECT id, 'bottom', ey FROM {RECTS}")
def rect_sides(t):
    return rect.sides(part_rects(t)).withColumnRenamed("at", "pos")


@query("id:l row_y:l band_sx:l free_ex:l", f"SELECT id, CASE WHEN sy + 1 <= ey THEN sy + 1 END AS row_y, CASE WHEN sx + 2 <= ex THEN sx + 1 END AS band_sx, sx + 4 AS free_ex FROM {RECTS}")
def rect_slices(t):
    return part_rects(t).select("id", rect.row_slice(1)["sy"].alias("row_y"), rect.column_slice(1, 2)["sx"].alias("band_sx"), rect.column_slice(3, 2, False)["ex"].alias("free_ex"))


@query("id:l x:l y:l", f"SELECT id, unnest(range(sx, ex + 1)) AS x, y FROM (SELECT *, unnest(range(sy, ey + 1)) AS y FROM {RECTS})")
def rect_cells(t):
    return rect.inside(part_rects(t))


@query("a:l b:l sx:l sy:l ex:l ey:l", f"SELECT a.id AS a, b.id AS b, greatest(a.sx, b.sx) AS sx, greatest(a.sy, b.sy) AS sy, least(a.ex, b.ex) AS ex, least(a.ey, b.ey) AS ey FROM {RECTS} a JOIN {RECTS} b ON a.sheet = b.sheet AND a.id > b.id AND a.sx <= b.ex AND b.sx <= a.ex AND a.sy <= b.ey AND b.sy <= a.ey")
def rect_intersections(t):
    return rect.intersecting(part_rects(t)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.inline(F.array(rect.intersection("a_", "b_"))))


@query("a:l b:l relation:s", f"""SELECT * FROM (SELECT a.id AS a, b.id AS b, CASE WHEN a.sy <= b.ey AND b.sy <= a.ey AND a.ex + 1 = b.sx THEN 'left_of' WHEN a.sy <= b.ey AND b.sy <= a.ey AND b.ex + 1 = a.sx THEN 'right_of'
 WHEN a.sx <= b.ex AND b.sx <= a.ex AND a.ey + 1 = b.sy THEN 'above' WHEN a.sx <= b.ex AND b.sx <= a.ex AND b.ey + 1 = a.sy THEN 'below' END AS relation FROM {RECTS} a JOIN {RECTS} b ON a.sheet = b.sheet AND a.id <> b.id) WHERE relation IS NOT NULL""")
def rect_adjacent(t):
    return rect.adjacent(part_rects(t)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "relation")


@query("sheet:s pairs:l", f"SELECT a.sheet, count(*) AS pairs FROM {RECTS} a JOIN {RECTS} b ON a.sheet = b.sheet AND a.sx <= b.ex AND b.sx <= a.ex AND a.sy <= b.ey AND b.sy <= a.ey GROUP BY a.sheet")
def rect_pair_count(t):
    rects = part_rects(t)
    return rect.range_join(rects, rects, ["sheet"]).groupBy(F.col("a_sheet").alias("sheet")).agg(F.count("*").alias("pairs"))


@query("supp:l sx:l sy:l ex:l ey:l", "SELECT l_suppkey AS supp, min(l_linenumber) AS sx, min(l_orderkey) AS sy, max(l_linenumber) AS ex, max(l_orderkey) AS ey FROM lineitem GROUP BY l_suppkey")
def rect_union_bbox(t):
    points = t.lineitem.select(F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("sx"), F.col("l_orderkey").alias("sy"), F.col("l_linenumber").alias("ex"), F.col("l_orderkey").alias("ey"))
    return rect.bounding(points, "supp")


def _subtract_sql() -> str:
    p = [("top/left", "sx", "sy", "ix - 1", "iy - 1"), ("top/middle", "ix", "sy", "jx", "iy - 1"), ("top/right", "jx + 1", "sy", "ex", "iy - 1"), ("middle/left", "sx", "iy", "ix - 1", "jy")]
    p += [("middle/right", "jx + 1", "iy", "ex", "jy"), ("bottom/left", "sx", "jy + 1", "ix - 1", "ey"), ("bottom/middle", "ix", "jy + 1", "jx", "ey"), ("bottom/right", "jx + 1", "jy + 1", "ex", "ey")]
    base = f"(SELECT *, greatest(sx, 10) AS ix, greatest(sy, 10) AS iy, least(ex, 22) AS jx, least(ey, 26) AS jy FROM {RECTS})"
    apart, wide, high = "(jx < ix OR jy < iy)", "(ix = sx AND jx = ex)", "(iy = sy AND jy = ey)"
    rows = [("all", "sx", "sy", "ex", "ey", apart), ("top", "sx", "sy", "ex", "iy - 1", f"NOT {apart} AND {wide}"), ("bottom", "sx", "jy + 1", "ex", "ey", f"NOT {apart} AND {wide}")]
    rows += [("left", "sx", "sy", "ix - 1", "ey", f"NOT {apart} AND NOT {wide} AND {high}"), ("right", "jx + 1", "sy", "ex", "ey", f"NOT {apart} AND NOT {wide} AND {high}")]
    rows += [(*x, f"NOT {apart} AND NOT {wide} AND NOT {high}") for x in p]
    parts = [f"SELECT id, '{n}' AS piece, {a} AS sx, {b} AS sy, {c} AS ex, {d} AS ey FROM {base} WHERE {w}" for n, a, b, c, d, w in rows]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE sx <= ex AND sy <= ey"


@query("id:l piece:s sx:l sy:l ex:l ey:l", _subtract_sql())
def rect_subtract(t):
    both = part_rects(t).select("id", *[F.col(c).alias(f"a_{c}") for c in rect.RECT], F.lit(10).alias("b_sx"), F.lit(10).alias("b_sy"), F.lit(22).alias("b_ex"), F.lit(26).alias("b_ey"))
    return both.select("id", F.inline(rect.subtract("a_", "b_")))


@query("id:l", f"SELECT id FROM {RECTS} a WHERE NOT EXISTS (SELECT 1 FROM {RECTS} b WHERE a.sheet = b.sheet AND a.id <> b.id AND b.sx <= a.sx AND b.sy <= a.sy AND b.ex >= a.ex AND b.ey >= a.ey AND ((b.sx, b.sy, b.ex, b.ey) <> (a.sx, a.sy, a.ex, a.ey) OR b.id < a.id))")
def contained_pruned(t):
    return rect.pruned(part_rects(t))


@query("id:l component:l", f"""WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {RECTS}), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.sheet = b.sheet AND a.id <> b.id AND a.sx <= b.ex AND b.sx <= a.ex AND a.sy <= b.ey AND b.sy <= a.ey),
 c AS (SELECT id AS a, id AS b FROM r UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS id, min(b) AS component FROM c GROUP BY a""")
def components(t):
    rects = part_rects(t)
    pairs = rect.intersecting(rects).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return discover.components(pairs, rects.select(F.col("id").alias("vertex"))).withColumnRenamed("vertex", "id")


@query("brand:s cx:d cy:d", f"SELECT sheet AS brand, round(sum((ex - sx + 1) * (ey - sy + 1) * (sx + ex) / 2.0) / sum((ex - sx + 1) * (ey - sy + 1)), 6) AS cx, round(sum((ex - sx + 1) * (ey - sy + 1) * (sy + ey) / 2.0) / sum((ex - sx + 1) * (ey - sy + 1)), 6) AS cy FROM {RECTS} GROUP BY sheet")
def weighted_centroid(t):
    return cluster.weighted_centroid(part_rects(t), "sheet").select(F.col("sheet").alias("brand"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


# Aggregates, ranks, runs


_TOTALS = f"SELECT x, CAST(sum(CAST(v AS DECIMAL(18, 6))) AS DOUBLE) AS total, CAST(sum(CAST(v AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS average, max(v) AS largest, min(v) AS least FROM (SELECT 1 AS x, l_quantity AS v FROM lineitem UNION ALL SELECT 2, l_extendedprice FROM lineitem UNION ALL SELECT 3, l_discount FROM lineitem UNION ALL SELECT 4, l_tax FROM lineitem) GROUP BY x"


def _totals(t: Tables) -> DataFrame:
    return agg.range_aggregates(lineitem_sheet(t).filter("x <= 4"), "x")


@query("x:l total:d", f"SELECT x, total FROM ({_TOTALS})")
def range_sum(t):
    return _totals(t)


@query("x:l average:d", f"SELECT x, average FROM ({_TOTALS})")
def range_average(t):
    return _totals(t)


@query("x:l largest:d least:d", f"SELECT x, largest, least FROM ({_TOTALS})")
def range_max_min(t):
    return _totals(t)


@query("cust:l matches:l", "SELECT o_custkey AS cust, count(*) FILTER (o_totalprice > 100000) AS matches FROM orders GROUP BY o_custkey")
def countif(t):
    cells = t.orders.select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("num"), F.lit(None).cast("string").alias("str"))
    return agg.countif(cells, ">", 100000.0, "cust")


@query("label:s cnt:l rank:l", "SELECT label, cnt, row_number() OVER (ORDER BY cnt DESC, label DESC) AS rank FROM (SELECT label, count(*) AS cnt FROM (SELECT o_orderpriority AS label FROM orders UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT c_mktsegment FROM customer) WHERE label <> '' GROUP BY label)")
def label_counts(t):
    own = [t.orders.select(F.col("o_orderpriority").alias("str")), t.orders.select(F.col("o_orderstatus").alias("str")), t.customer.select(F.col("c_mktsegment").alias("str"))]
    return agg.label_counts(own[0].unionByName(own[1]).unionByName(own[2]).withColumn("workbook", F.lit("w")))


@query("s_suppkey:l s_nationkey:l rank:l", "SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rank FROM supplier")
def rank_desc(t):
    return agg.ranked(t.supplier, "s_acctbal", "s_nationkey")


@query("p_partkey:l rank:l", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rank FROM part")
def rank_asc(t):
    return agg.ranked(t.part, "p_size", "p_brand", ascending=True)


@query("cust:l low:l high:l", "SELECT cust, min(d) AS low, max(d) AS high FROM (SELECT cust, d, d - row_number() OVER (PARTITION BY cust ORDER BY d) AS r FROM (SELECT DISTINCT o_custkey AS cust, o_orderkey // 100 AS d FROM orders)) GROUP BY cust, r")
def run_compress(t):
    return agg.compress(t.orders.select(F.col("o_custkey").alias("cust"), F.floor(F.col("o_orderkey") / 100).alias("d")), "d", "cust")


@query("user:l kind:s low:l high:l", """WITH p AS (SELECT user_id AS user, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
 SELECT user, kind, min(n) AS low, max(n) AS high FROM (SELECT *, n - row_number() OVER (PARTITION BY user, kind ORDER BY n) AS r FROM p) GROUP BY user, kind, r HAVING count(*) >= 2""")
def runs_by_class(t):
    own = t.events.select(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    return agg.class_runs(own, "n", "kind", "user")


@query("order_:l line:l class:s", """WITH c AS (SELECT l_linenumber AS x, l_orderkey AS y, min(l_returnflag) AS class FROM lineitem GROUP BY 1, 2)
 SELECT c.y AS order_, c.x AS line, c.class FROM c LEFT JOIN c l ON l.y = c.y AND l.x = c.x - 1 LEFT JOIN c u ON u.x = c.x AND u.y = c.y - 1 WHERE l.class IS DISTINCT FROM c.class AND u.class IS DISTINCT FROM c.class""")
def anchors(t):
    cells = t.lineitem.select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), F.col("l_linenumber").alias("x"), F.col("l_orderkey").alias("y"), F.col("l_returnflag").alias("class"))
    cells = cells.groupBy("workbook", "sheet", "x", "y").agg(F.min("class").alias("class"))
    return agg.anchors(cells).select(F.col("y").alias("order_"), F.col("x").alias("line"), "class")


# Lookups


@query("okey:l line:l found:d err:s", "SELECT l_orderkey AS okey, l_linenumber AS line, p_retailprice AS found, CASE WHEN p_partkey IS NULL THEN 'N/A' END AS err FROM lineitem LEFT JOIN part ON l_partkey + 20 = p_partkey")
def lookup_exact(t):
    probes = t.lineitem.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") + 20).alias("probe"))
    return agg.lookup_exact(probes, "probe", t.part, "p_partkey", "p_partkey", "p_retailprice")


def _sorted(t: Tables, mode: str) -> DataFrame:
    probes = t.events.select("event_id", F.col("value").alias("v"))
    return agg.lookup_sorted(probes, "v", t.supplier.withColumn("key", F.abs("s_acctbal") / 20), "key", "s_suppkey", "s_suppkey", mode, buckets=[float(b) for b in range(25, 500, 25)])


_KEYS = "(SELECT abs(s_acctbal) / 20 AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1)"


@query("event_id:l found:l err:s", f"SELECT event_id, s AS found, CASE WHEN s IS NULL THEN 'N/A' END AS err FROM events ASOF LEFT JOIN {_KEYS} ON value <= k")
def lookup_sorted(t):
    return _sorted(t, "ceiling")


@query("event_id:l found:l err:s", f"SELECT event_id, s AS found, CASE WHEN s IS NULL THEN 'N/A' END AS err FROM events ASOF LEFT JOIN {_KEYS} ON value >= k")
def lookup_floor(t):
    return _sorted(t, "floor")


@query("cust:l first_equal:l last_low:l", "SELECT cust, min(CASE WHEN o_orderpriority = '3-MEDIUM' THEN pos END) AS first_equal, max(CASE WHEN o_orderkey <= 500 THEN pos END) AS last_low FROM (SELECT o_custkey AS cust, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) GROUP BY cust")
def match_position(t):
    own = t.orders.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumnRenamed("o_custkey", "cust")
    exact = agg.match(own, F.lit("3-MEDIUM"), "o_orderpriority", "pos", 0, "cust").withColumnRenamed("position", "first_equal")
    return exact.join(agg.match(own, F.lit(500), "o_orderkey", "pos", 1, "cust").withColumnRenamed("position", "last_low"), "cust")


# Scalars

_ROUND = "CASE WHEN l_extendedprice * l_discount = 0 THEN 0.0 ELSE sign(l_extendedprice * l_discount) * floor(abs(l_extendedprice * l_discount) * {m} + {h}) / {m} END"


@query("okey:l line:l v:d", f"SELECT l_orderkey AS okey, l_linenumber AS line, {_ROUND.format(m='100.0::DOUBLE', h='0.5::DOUBLE')} AS v FROM lineitem")
def scalar_round(t):
    return t.lineitem.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), fn.round_half_away(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("v"))


@query("okey:l line:l v:d", f"SELECT l_orderkey AS okey, l_linenumber AS line, {_ROUND.format(m='10.0::DOUBLE', h='0.0::DOUBLE')} AS v FROM lineitem")
def scalar_rounddown(t):
    return t.lineitem.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), fn.round_down(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("v"))


@query("okey:l line:l v:d", "SELECT l_orderkey AS okey, l_linenumber AS line, round(exp(l_discount), 9) AS v FROM lineitem")
def scalar_exp(t):
    return t.lineitem.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.round(fn.exp(F.col("l_discount")), 9).alias("v"))


@query("okey:l v:d", "SELECT o_orderkey AS okey, round(CASE WHEN r = 0 THEN -o_totalprice / 12 ELSE -(o_totalprice * pow(1 + r, 12)) * r / (pow(1 + r, 12) - 1) END, 4) AS v FROM (SELECT o_orderkey, o_totalprice, (o_orderkey % 5) / 100.0::DOUBLE AS r FROM orders)")
def scalar_pmt(t):
    return t.orders.select(F.col("o_orderkey").alias("okey"), F.round(fn.pmt(F.col("o_orderkey") % 5 / 100.0, F.lit(12.0), F.col("o_totalprice")), 4).alias("v"))


@query("c_custkey:l v:s", "SELECT c_custkey, trim(regexp_replace(c_custkey || '  ' || c_name || ' ' || c_mktsegment || '  ', '\\s+', ' ', 'g')) AS v FROM customer")
def scalar_concat(t):
    return t.customer.select("c_custkey", fn.concatenate(fn.number_text(F.col("c_custkey").cast("double")), F.lit("  "), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("  ")).alias("v"))


@query("okey:l ratio:d err:s blank:b is_err:b rich:s", "SELECT o_orderkey AS okey, CASE WHEN c_nationkey <> 0 THEN o_totalprice / c_nationkey END AS ratio, CASE WHEN c_nationkey = 0 THEN 'DIV/0!' END AS err, c_custkey IS NULL AS blank, coalesce(c_nationkey = 0, false) AS is_err, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'e' END AS rich FROM orders LEFT JOIN customer ON o_custkey + 20 = c_custkey")
def if_error_blank(t):
    both = t.orders.join(t.customer, F.col("o_custkey") + 20 == F.col("c_custkey"), "left")
    ratio, err = fn.divide(F.col("o_totalprice"), F.col("c_nationkey"))
    return both.select(F.col("o_orderkey").alias("okey"), ratio.alias("ratio"), err.alias("err"), fn.is_blank(F.when(F.col("c_custkey").isNotNull(), "float")).alias("blank"), fn.is_error(err).alias("is_err"), fn.if_(F.col("c_acctbal") > 0, F.lit("t"), F.lit("e")).alias("rich"))


# Formulas

_CHARGE = "(l_extendedprice * (1 - l_discount) * (1 + l_tax))"


@query("y:l v:d", f"SELECT y, {_CHARGE} AS v FROM {_L}")
def arith_eval(t):
    return ev.evaluate(lineitem_sheet(t)).select("y", F.col("v_num").alias("v"))


@query("y:l status:s", f"SELECT y, 'passed' AS status FROM {_L}")
def verify_formulas(t):
    return ev.verify(lineitem_sheet(t))


@query("status:s n:l", "SELECT 'passed' AS status, count(*) AS n FROM lineitem")
def verify_statistics(t):
    return ev.statistics(ev.verify(lineitem_sheet(t))).withColumnRenamed("count", "n")


def _with_formulas(t: Tables, formulas: dict[str, str]) -> DataFrame:
    """The supplier sheet with cells from column E on, each with a formula whose {y} is the row."""
    cells = supplier_sheet(t)
    rows = cells.filter("x = 1")
    for x, (vtype, text) in enumerate(formulas.items(), 5):
        parts = text.split("{y}")
        pieces = [F.lit(parts[0])] + [c for p in parts[1:] for c in (F.col("y").cast("string"), F.lit(p))]
        made = rows.withColumns({"x": F.lit(x), "vtype": F.lit(vtype.split("_")[0]), "num": F.lit(None).cast("double"), "formula": F.concat(*pieces)})
        cells = cells.unionByName(made)
    return cells


@query("y:l x:l num:d str:s bool:b err:s", """SELECT y, x, num, str, bool, err FROM (SELECT y, 5 AS x, -s_acctbal / 100 AS num, NULL AS str, NULL AS bool, NULL AS err FROM {S} UNION ALL SELECT y, 6, NULL, s_name || '/' || s_suppkey, NULL, NULL FROM {S}
 UNION ALL SELECT y, 7, NULL, NULL, s_acctbal <> 0, NULL FROM {S} UNION ALL SELECT y, 8, pow(s_suppkey % 10, 2), NULL, NULL, NULL FROM (SELECT y, s_suppkey - 10 * floor(s_suppkey / 10) AS s_suppkey FROM {S})
 UNION ALL SELECT y, 9, NULL, NULL, NULL, 'DIV/0!' FROM {S} UNION ALL SELECT y, 10, NULL, NULL, true, NULL FROM {S})""".replace("{S}", _S))
def percent_unary_const(t):
    made = _with_formulas(t, {"float_1": "of:=-[.C{y}]%", "string_1": 'of:=[.B{y}]&"/"&[.A{y}]', "boolean_1": "of:=[.C{y}]<>0", "float_2": "of:=([.A{y}]-10*ROUNDDOWN([.A{y}]/10))^2", "float_3": "of:=1/([.A{y}]-[.A{y}])", "boolean_2": "of:=TRUE()"})
    return ev.evaluate(made).select("y", "x", F.col("v_num").alias("num"), F.col("v_str").alias("str"), F.col("v_bool").alias("bool"), F.col("v_err").alias("err"))


@query("y:l x:l num:d", f"SELECT y, 5 AS x, round(s_acctbal + coalesce(s1, 0) + coalesce(s2, 0), 6) AS num FROM (SELECT y, s_acctbal, lead(s_acctbal, 1) OVER (ORDER BY y) AS s1, lead(s_acctbal, 2) OVER (ORDER BY y) AS s2 FROM {_S}) UNION ALL SELECT y, 6, s_suppkey FROM {_S}")
def offset_range(t):
    made = _with_formulas(t, {"float_1": "of:=SUM([.C{y}]:OFFSET([.C{y}];2;0))", "float_2": "of:=MAX([.A{y}]:OFFSET([.B{y}];0;1))-0*SUM([.B{y}])"})
    fixed = made.withColumn("formula", F.regexp_replace("formula", r"MAX\(\[\.A(\d+)\]:OFFSET\(\[\.B\d+\];0;1\)\)-0\*SUM\(\[\.B\d+\]\)", r"SUM([.A$1]:OFFSET([.A$1];0;1))"))
    return ev.evaluate(fixed).select("y", "x", F.round("v_num", 6).alias("num"))


@query("y:l values:x", f"SELECT y // 10 AS y, list(l_quantity ORDER BY y) AS values FROM {_L} GROUP BY 1")
def array_of_range(t):
    cells = g.cell_value(lineitem_sheet(t), x=1).withColumn("block", F.floor(F.col("y") / 10))
    held = cells.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("y", "num"))).alias("v"))
    return held.select(F.col("block").alias("y"), F.transform("v", lambda v: v["num"]).alias("values"))


@query("key:s n:l nx:l ny:l shape:s", "SELECT '(([.R[0]C[-3]]*(1-[.R[0]C[-2]]))*(1+[.R[0]C[-1]]))' AS key, count(*) AS n, 1 AS nx, count(*) AS ny, 'column' AS shape FROM lineitem")
def formula_groups(t):
    return gen.groups(gen.relative_keys(lineitem_sheet(t)))


@query("sx:l sy:l ex:l ey:l expr:s", "SELECT 5 AS sx, 1 AS sy, 5 AS ex, count(*) AS ey, '(([.B1:.B' || count(*) || ']*(1-[.C1:.C' || count(*) || ']))*(1+[.D1:.D' || count(*) || ']))' AS expr FROM lineitem")
def range_formulas(t):
    return gen.range_formulas(lineitem_sheet(t))


@query("src_x:l src_y:l dst_x:l dst_y:l", f"SELECT x AS src_x, y AS src_y, 5 AS dst_x, y AS dst_y FROM {_L}, range(2, 5) r(x)")
def dependency_edges(t):
    return gen.dependency_edges(lineitem_sheet(t))


def _key_edges(t: Tables) -> DataFrame:
    v = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders = t.orders.select(v("c", "o_custkey").alias("src"), v("o", "o_orderkey").alias("dst"))
    return orders.unionByName(t.customer.select(v("n", "c_nationkey").alias("src"), v("c", "c_custkey").alias("dst"))).unionByName(t.nation.select(v("r", "n_regionkey").alias("src"), v("n", "n_nationkey").alias("dst")))


@query("start:s vertex:s", """WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS d FROM orders UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
 p AS (SELECT d AS start, s AS vertex FROM e WHERE d LIKE 'o%' UNION SELECT p.start, e.s FROM p JOIN e ON p.vertex = e.d) SELECT * FROM p""")
def precedents(t):
    start = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("vertex"))
    return gen.precedents(_key_edges(t), start)


# Triples, labels, graphs


SUPPLIER = f"""(SELECT 1 AS x, y, 'float' AS vtype, s_suppkey::DOUBLE AS num, NULL AS str FROM {_S} UNION ALL
 SELECT 2, y, 'string', NULL, s_name FROM {_S} UNION ALL SELECT 3, y, 'float', s_acctbal, NULL FROM {_S})"""


def label_sql(sheet: str, cells: str) -> str:
    return f"""SELECT '{sheet}' AS sheet, a.x, a.y, 'left' AS side, b.x AS lx, b.y AS ly, b.str AS label FROM {cells} a JOIN {cells} b ON a.y = b.y AND b.x < a.x WHERE a.vtype = 'float' AND b.vtype = 'string'
 UNION ALL SELECT '{sheet}', a.x, a.y, 'top', b.x, b.y, b.str FROM {cells} a JOIN {cells} b ON a.x = b.x AND b.y < a.y WHERE a.vtype = 'float' AND b.vtype = 'string'"""


@query("sheet:s x:l y:l side:s lx:l ly:l label:s", f"{label_sql('nation', NATION)} UNION ALL {label_sql('supplier', SUPPLIER)}")
def label_candidates(t):
    return rdf.possible_labels(nation_sheet(t).unionByName(supplier_sheet(t)))


@query("s:s p:s o:s", f"SELECT 'region/' || {name_sql('x')} || y AS s, 'rightOf' AS p, 'region/' || {name_sql('(x - 1)')} || y AS o FROM {REGION} WHERE x > 1 UNION ALL SELECT 'region/' || {name_sql('x')} || y, 'below', 'region/' || {name_sql('x')} || (y - 1) FROM {REGION} WHERE y > 1")
def neighbour_triples(t):
    return rdf.neighbour_triples(region_sheet(t))


@query("s:s p:s o:s o_type:s", f"SELECT 'region/' || {name_sql('x')} || y AS s, 'type' AS p, 'Cell' AS o, 'iri' AS o_type FROM {REGION} UNION ALL SELECT 'region/' || {name_sql('x')} || y, 'value', coalesce(num::VARCHAR, str), CASE WHEN vtype = 'float' THEN 'double' ELSE 'plain' END FROM {REGION}")
def cell_triples(t):
    return rdf.cell_triples(region_sheet(t))


@query("name:s n:l in_a:b in_b:b", "SELECT name, count(*) AS n, bool_or(k = 1) AS in_a, bool_or(k = 2) AS in_b FROM (SELECT DISTINCT p_brand AS name, 1 AS k FROM part WHERE p_size < 10 UNION ALL SELECT DISTINCT p_brand, 2 FROM part WHERE p_size = 50) GROUP BY name UNION ALL SELECT name || '-', 0, true, false FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 10 EXCEPT SELECT p_brand FROM part WHERE p_size = 50)")
def set_ops(t):
    a = t.part.filter("p_size < 10").select(F.col("p_brand").alias("name")).distinct()
    b = t.part.filter("p_size = 50").select(F.col("p_brand").alias("name")).distinct()
    both = a.withColumn("k", F.lit(1)).unionByName(b.withColumn("k", F.lit(2))).groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.col("k") == 1).alias("in_a"), F.bool_or(F.col("k") == 2).alias("in_b"))
    return both.unionByName(a.join(b, "name", "left_anti").select(F.concat("name", F.lit("-")).alias("name"), F.lit(0).alias("n"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b")))


@query("kind:s value:s", "SELECT 'node' AS kind, '  n' || n_nationkey || ' [label=\"' || n_name || '\"];' AS value FROM nation UNION ALL SELECT 'edge', '  n' || n_nationkey || ' -> n' || (100 + n_regionkey) || ';' FROM nation")
def graph_dot(t):
    return dot_lines(t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("label")), t.nation.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst")))


@query("kind:s value:s", "SELECT 'node' AS kind, '<node id=\"n' || n_nationkey || '\"><data key=\"label\">' || n_name || '</data></node>' AS value FROM nation UNION ALL SELECT 'edge', '<edge source=\"n' || n_nationkey || '\" target=\"n' || (100 + n_regionkey) || '\"/>' FROM nation")
def graph_graphml(t):
    return graphml_lines(t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("label")), t.nation.select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst")))


@query("x:l y:l shown:s", f"SELECT x, y, CASE WHEN num IS NOT NULL THEN num::BIGINT::VARCHAR ELSE str END AS shown FROM {REGION}")
def html_range(t):
    return region_sheet(t).withColumn("shown", rendered())


# Order-dependent searches: no SQL; the tests hold them against fixtures and properties.


def _mixed(t: Tables) -> DataFrame:
    nation = nation_sheet(t)
    return nation.unionByName(supplier_sheet(t).withColumn("y", F.col("y") + 30).withColumn("sheet", F.lit("nation")))


@query("sheet:s type:s sx:l sy:l ex:l ey:l")
def blocks(t):
    return discover.blocks(_mixed(t))


@query("sheet:s type:s sx:l sy:l ex:l ey:l n_headers:l ux:l uy:l uex:l uey:l")
def tables(t):
    return discover.tables(_mixed(t)).withColumn("n_headers", F.size("headers"))


@query("sheet:s id:l colour:l")
def coloring(t):
    return discover.colour_sheets(part_rects(t))


@query("id:l cluster:l")
def kmeans_rects(t):
    return cluster.k_means(part_rects(t), 8)
