"""Triples of cells and neighbours, label candidates, tokens of labels (RD1-RD4, TX2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import cell_value, column_name, shown


def cell_url(sheet: Column, x: Column, y: Column) -> Column:
    return F.concat(sheet, F.lit("/"), column_name(x), y.cast("string"))


def neighbour_triples(cells: DataFrame, strict: bool = False) -> DataFrame:
    """RD1: rightOf and below between present neighbours. strict: no rightOf in the first row, no below in the first column."""
    own = cell_value(cells).select("workbook", "sheet", "x", "y")
    rows, columns = Window.partitionBy("workbook", "sheet", "y").orderBy("x"), Window.partitionBy("workbook", "sheet", "x").orderBy("y")
    marked = own.withColumns({"px": F.lag("x").over(rows), "py": F.lag("y").over(columns)})
    if strict:
        box = Window.partitionBy("workbook", "sheet")
        marked = marked.withColumns({"fx": F.min("x").over(box), "fy": F.min("y").over(box)})
    s = cell_url(F.col("sheet"), F.col("x"), F.col("y"))
    right = marked.filter((F.col("px") == F.col("x") - 1) & (F.col("y") > F.col("fy") if strict else F.lit(True)))
    under = marked.filter((F.col("py") == F.col("y") - 1) & (F.col("x") > F.col("fx") if strict else F.lit(True)))
    return right.select(s.alias("s"), F.lit("rightOf").alias("p"), cell_url(F.col("sheet"), F.col("px"), F.col("y")).alias("o")).unionByName(
        under.select(s.alias("s"), F.lit("below").alias("p"), cell_url(F.col("sheet"), F.col("x"), F.col("py")).alias("o"))
    )


def cell_triples(cells: DataFrame) -> DataFrame:
    """RD2: type and value of each cell; o_type is double, percentage or plain."""
    kind = F.when(F.col("vtype") == "float", "double").when(F.col("vtype") == "percentage", "percentage").otherwise("plain")
    value = F.when(F.col("num").isNotNull(), F.col("num").cast("string")).otherwise(shown())
    s = cell_url(F.col("sheet"), F.col("x"), F.col("y"))
    rows = F.array(
        F.struct(F.lit("type").alias("p"), F.lit("Cell").alias("o"), F.lit("iri").alias("o_type")), F.struct(F.lit("value").alias("p"), value.alias("o"), kind.alias("o_type"))
    )
    return cell_value(cells).select(s.alias("s"), F.inline(rows))


def possible_labels(cells: DataFrame) -> DataFrame:
    """RD3: every string cell to the left in the row, or above in the column, of a number."""
    own = cell_value(cells)
    numbers = own.filter("vtype in ('float', 'percentage')").select("workbook", "sheet", "x", "y")
    labels = own.filter("vtype = 'string' and str <> ''").select("workbook", "sheet", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("str").alias("label"))
    left = numbers.join(labels.withColumnRenamed("ly", "y"), ["workbook", "sheet", "y"]).filter("lx < x").select("workbook", "sheet", "x", "y", F.lit("left").alias("side"), "lx", F.col("y").alias("ly"), "label")
    top = numbers.join(labels.withColumnRenamed("lx", "x"), ["workbook", "sheet", "x"]).filter("ly < y").select("workbook", "sheet", "x", "y", F.lit("top").alias("side"), F.col("x").alias("lx"), "ly", "label")
    return left.unionByName(top)


#: Words for large numbers in Dutch labels.
LARGE = {"duizend": 1e3, "miljoen": 1e6, "miljard": 1e9}


def label_tokens(labels: DataFrame, units: DataFrame) -> DataFrame:
    """TX2, JN15: tokens of each label in order, lower-case unless they are unit symbols; kind word, number, unit or large."""
    tokens = F.regexp_extract_all("label", F.lit(r"[\p{L}]+|[0-9]+(?:[.,][0-9]+)?|[^\s]"), F.lit(0))
    each = labels.select("label", F.posexplode(tokens).alias("pos", "token"))
    found = each.join(units.select(F.col("symbol").alias("token"), "resource"), "token", "left")
    kind = F.when(F.col("resource").isNotNull(), "unit").when(F.lower("token").isin(*LARGE), "large").when(F.col("token").rlike(r"^[0-9]"), "number").otherwise("word")
    return found.select("label", "pos", F.when(kind == "unit", F.col("token")).otherwise(F.lower("token")).alias("token"), kind.alias("kind"), "resource")
