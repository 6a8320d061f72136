"""Cells: tables viewed as sheets, cell queries, ids and names (PF1-PF15, SC4-SC7, SO1-SO7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = (
    "workbook string, sheet string, x int, y int, vtype string, num double, str string, bool boolean, dt date, err string, "
    "formula string, style string, annotations array<struct<ts:timestamp,author:string,text:string>>"
)
FIELDS = ["workbook", "sheet", "x", "y", "vtype", "num", "str", "bool", "dt", "err", "formula", "style", "annotations"]


def numbered(df: DataFrame, order: list[str], name: str = "y", width: int = 4096) -> DataFrame:
    """df with 1-based positions in a total order. If the first column is a number, rows are ranked within
    buckets of `width` of its values and the buckets' counts summed up, so no task sorts the whole table."""
    kind = df.schema[order[0]].dataType
    if not isinstance(kind, T.IntegralType):
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    bucketed = df.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    before = Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = bucketed.groupBy(F.col("_bucket").alias("_b")).count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = bucketed.withColumn(name, rank).join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_bucket", "_b", "_before")


def typed(value: Column, kind: T.DataType) -> dict[str, Column]:
    """The cell columns that hold a value of a table's column."""
    if isinstance(kind, T.BooleanType):
        return {"vtype": F.lit("boolean"), "bool": value}
    if isinstance(kind, T.NumericType):
        return {"vtype": F.lit("float"), "num": value.cast("double")}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"vtype": F.lit("date"), "dt": value.cast("date")}
    return {"vtype": F.lit("string"), "str": value.cast("string")}


def as_sheet(df: DataFrame, sheet: str, order: list[str], cols: list[str], workbook: str = "", formulas: dict[str, Column] | None = None) -> DataFrame:
    """A table as a sheet: row y is the y-th in order, column x the x-th of cols. Null values are styled cells
    without a value. formulas: column -> text of its cells' formulas, in terms of df's columns and y."""
    fields = T._parse_datatype_string(CELL)
    lit = {"workbook": F.lit(workbook), "sheet": F.lit(sheet), "style": F.lit("default")}
    cells = []
    for x, c in enumerate(cols, 1):
        own = typed(F.col(c), df.schema[c].dataType) | lit | {"x": F.lit(x), "y": F.col("_y")}
        own["vtype"] = F.when(F.col(c).isNull(), "no_type").otherwise(own["vtype"])
        own["formula"] = (formulas or {}).get(c, F.lit(None))
        cells.append(F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]))
    return numbered(df, order, "_y").select(F.inline(F.array(*cells)))


def has_value() -> Column:
    return F.col("vtype") != "no_type"


def shown() -> Column:
    """The value as text; numbers without a fraction as integers."""
    whole = F.col("num").cast("decimal(38,0)")
    number = F.when(F.col("num") == F.col("num").cast("long"), whole.cast("string")).otherwise(F.col("num").cast("string"))
    return F.coalesce(F.col("str"), number, F.col("dt").cast("string"), F.col("bool").cast("string"), F.concat(F.lit("#"), F.col("err")))


def select_cells(cells: DataFrame, workbook=None, sheet=None, x=None, y=None) -> DataFrame:
    """Bound arguments filter, free ones scan."""
    for name, value in (("workbook", workbook), ("sheet", sheet), ("x", x), ("y", y)):
        if value is not None:
            cells = cells.filter(F.col(name) == value)
    return cells


def cell_value(cells: DataFrame, **at) -> DataFrame:
    return select_cells(cells, **at).filter(has_value())


def cell_type(cells: DataFrame, **at) -> DataFrame:
    return select_cells(cells, **at).select("workbook", "sheet", "x", "y", "vtype")


def cell_formula(cells: DataFrame, **at) -> DataFrame:
    return select_cells(cells, **at).filter("formula is not null").select("workbook", "sheet", "x", "y", "formula")


def cell_style(cells: DataFrame, styles: DataFrame, columns: DataFrame, prop: str) -> DataFrame:
    """A style property of each cell: the width comes from its column, all else from itself."""
    styled = cells.select("workbook", "sheet", "x", "y", "style")
    if prop == "column_width":
        wide = columns.select("workbook", "sheet", "x", F.col("style").alias("_style"))
        styled = styled.join(wide, ["workbook", "sheet", "x"]).withColumn("style", F.col("_style")).drop("_style")
    found = styled.join(styles.withColumnRenamed("name", "style"), ["workbook", "style"])
    value = F.col("props")[prop]
    ok = value.isNotNull() & (F.lit(prop != "cell_color") | (value != "transparent"))
    return found.filter(ok).select("workbook", "sheet", "x", "y", value.alias("value"))


def style_property(styles: DataFrame) -> DataFrame:
    """All properties of all styles."""
    out = styles.select("workbook", "name", F.explode("props").alias("property", "value"))
    return out.filter("property <> 'cell_color' or value <> 'transparent'")


def size_of(text: Column) -> Column:
    """12pt, 3cm or 5mm as struct(value, unit); null if it is none of these."""
    value = F.regexp_extract(text, r"^(-?[0-9.]+)(pt|cm|mm)$", 1)
    return F.when(value != "", F.struct(value.try_cast("double").alias("value"), F.regexp_extract(text, r"(pt|cm|mm)$", 1).alias("unit")))


def cell_id(x: Column, y: Column) -> Column:
    """The packed id; columns from 10000 on collide."""
    return y.cast("long") * 10000 + x


def unpack_id(packed: Column) -> tuple[Column, Column]:
    return (packed % 10000).cast("int"), F.floor(packed / 10000).cast("int")


def column_name(x: Column) -> Column:
    """1 A, 26 Z, 27 AA, 702 ZZ, 703 AAA (bijective base 26, up to three letters)."""
    letter = lambda v: F.char(v.cast("long") + 65)
    one = letter(x - 1)
    two = F.concat(letter(F.floor((x - 27) / 26)), letter((x - 27) % 26))
    rest = x - 703
    three = F.concat(letter(F.floor(rest / 676)), letter(F.floor(rest / 26) % 26), letter(rest % 26))
    return F.when(x < 1, F.lit(None)).when(x <= 26, one).when(x <= 702, two).otherwise(three)


def column_index(name: Column) -> Column:
    """The inverse; lower case is accepted."""
    codes = F.transform(F.split(F.upper(name), ""), lambda c: F.ascii(c) - 64)
    return F.when(F.upper(name).rlike("^[A-Z]+$"), F.aggregate(codes, F.lit(0), lambda a, c: a * 26 + c))


def needs_quotes(sheet: Column) -> Column:
    return sheet.rlike(r"[\]. #$]")


def empty() -> Column:
    """No row, no value, or an empty string."""
    return F.coalesce((F.col("vtype") == "no_type") | ((F.col("vtype") == "string") & (F.coalesce("str", F.lit("")) == "")), F.lit(True))


def bounding_box(cells: DataFrame) -> DataFrame:
    """RA16: per sheet the box of cells that aren't empty."""
    return cells.filter(~empty()).groupBy("workbook", "sheet").agg(F.min("x").alias("sx"), F.min("y").alias("sy"), F.max("x").alias("ex"), F.max("y").alias("ey"))


def cell_class(cells: DataFrame) -> DataFrame:
    """PF10: class of each cell of the bounding box grown by 1; types without a class of their own keep theirs."""
    box = bounding_box(cells)
    grid = box.select("workbook", "sheet", F.explode(F.sequence(F.col("sx") - 1, F.col("ex") + 1)).alias("x"), "sy", "ey")
    grid = grid.select("workbook", "sheet", "x", F.explode(F.sequence(F.col("sy") - 1, F.col("ey") + 1)).alias("y"))
    return grid.join(cells, ["workbook", "sheet", "x", "y"], "left").select("workbook", "sheet", "x", "y", F.when(empty(), "empty").otherwise(F.col("vtype")).alias("class"))


def cells_outside(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """PF13: cells with a value that lie in no table's union. tables: workbook, sheet, sx, sy, ex, ey."""
    from .rect import tiles

    own = cell_value(cells).withColumn("_tile", F.concat_ws(",", F.floor(F.col("x") / 64), F.floor(F.col("y") / 64)))
    spread = tiles(tables.select("workbook", "sheet", "sx", "sy", "ex", "ey"), 64).select("workbook", "sheet", "sx", "sy", "ex", "ey", F.concat_ws(",", "tx", "ty").alias("_tile"))
    cond = ["workbook", "sheet", "_tile"]
    a, b = own.alias("a"), spread.alias("b")
    inside = F.expr("a.x between b.sx and b.ex and a.y between b.sy and b.ey")
    on = inside
    for c in cond:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on, "left_anti").drop("_tile")


def sort_key() -> Column:
    """SO7: numbers before text before logicals, false before true."""
    rank = F.when(F.col("num").isNotNull(), 1).when(F.col("str").isNotNull(), 2).when(F.col("bool").isNotNull(), 3).otherwise(4)
    return F.struct(rank.alias("rank"), F.col("num"), F.col("str"), F.col("bool"))


def expand_repeats(items: DataFrame, keys: list[str], order: str, repeat: str, position: str) -> DataFrame:
    """SC4-SC6: elements with a repeat count become one row per copy at running positions."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = items.withColumn("_start", F.coalesce(F.sum(repeat).over(before), F.lit(0)) + 1)
    return start.withColumn(position, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col(repeat) - 1))).drop("_start")


def expand_spans(spans: DataFrame) -> DataFrame:
    """SC7: a merged range (sheet, sx, sy, ex, ey) maps all its cells but the base to the base."""
    out = spans.select("*", F.explode(F.sequence("sx", "ex")).alias("x")).select("*", F.explode(F.sequence("sy", "ey")).alias("y"))
    return out.filter("x <> sx or y <> sy").select("workbook", "sheet", "x", "y", F.col("sx").alias("base_x"), F.col("sy").alias("base_y"))
