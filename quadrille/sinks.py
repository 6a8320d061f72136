"""Sinks: label CSV, N-Triples, DOT, GraphML, HTML (SK1-SK10). Text lines are made by columns and written by Spark."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.grid import column_name, shown

#: The rows of gv_attr: (what an attribute applies to: G graph, N node, E edge, S subgraph, C cluster; type), alternatives by |.
DOT_ATTRIBUTES = {
    "Damping": (("G", "double"),), "K": (("GC", "double"),), "URL": (("ENGC", "escString"),), "area": (("NC", "double"),), "arrowhead": (("E", "arrowType"),),
    "arrowsize": (("E", "double"),), "arrowtail": (("E", "arrowType"),), "aspect": (("G", "aspectType"),), "bb": (("G", "rect"),), "bgcolor": (("GC", "color|colorList"),),
    "center": (("G", "bool"),), "charset": (("G", "string"),), "clusterrank": (("G", "clusterMode"),), "color": (("ENC", "color|colorList"),), "colorscheme": (("ENCG", "string"),),
    "comment": (("ENG", "string"),), "compound": (("G", "bool"),), "concentrate": (("G", "bool"),), "constraint": (("E", "bool"),), "decorate": (("E", "bool"),),
    "defaultdist": (("G", "double"),), "dim": (("G", "int"),), "dimen": (("G", "int"),), "dir": (("E", "dirType"),), "diredgeconstraints": (("G", "string|bool"),),
    "distortion": (("N", "double"),), "dpi": (("G", "double"),), "edgeURL": (("E", "escString"),), "edgehref": (("E", "escString"),), "edgetarget": (("E", "escString"),),
    "edgetooltip": (("E", "escString"),), "epsilon": (("G", "double"),), "esep": (("G", "addDouble|addPoint"),), "fillcolor": (("NEC", "color|colorList"),),
    "fixedsize": (("N", "bool"),), "fontcolor": (("ENGC", "color"),), "fontname": (("ENGC", "string"),), "fontnames": (("G", "string"),), "fontpath": (("G", "string"),),
    "fontsize": (("ENGC", "double"),), "forcelabels": (("G", "bool"),), "gradientangle": (("NCG", "int"),), "group": (("N", "string"),), "headURL": (("E", "escString"),),
    "head_lp": (("E", "point"),), "headclip": (("E", "bool"),), "headhref": (("E", "escString"),), "headlabel": (("E", "lblString"),), "headport": (("E", "portPos"),),
    "headtarget": (("E", "escString"),), "headtooltip": (("E", "escString"),), "height": (("N", "double"),), "href": (("GCNE", "escString"),), "id": (("GNE", "escString"),),
    "image": (("N", "string"),), "imagepath": (("G", "string"),), "imagescale": (("N", "bool"),), "label": (("ENGC", "lblString"),), "labelURL": (("E", "escString"),),
    "label_scheme": (("G", "int"),), "labelangle": (("E", "double"),), "labeldistance": (("E", "double"),), "labelfloat": (("E", "bool"),), "labelfontcolor": (("E", "color"),),
    "labelfontname": (("E", "string"),), "labelfontsize": (("E", "double"),), "labelhref": (("E", "escString"),), "labeljust": (("GC", "string"),),
    "labelloc": (("NGC", "string"),), "labeltarget": (("E", "escString"),), "labeltooltip": (("E", "escString"),), "landscape": (("G", "bool"),), "layer": (("ENC", "layerRange"),),
    "layerlistsep": (("G", "string"),), "layers": (("G", "layerList"),), "layerselect": (("G", "layerRange"),), "layersep": (("G", "string"),), "layout": (("G", "string"),),
    "len": (("E", "double"),), "levels": (("G", "int"),), "levelsgap": (("G", "double"),), "lhead": (("E", "string"),), "lheight": (("GC", "double"),), "lp": (("EGC", "point"),),
    "ltail": (("E", "string"),), "lwidth": (("GC", "double"),), "margin": (("NCG", "double|point"),), "maxiter": (("G", "int"),), "mclimit": (("G", "double"),),
    "mindist": (("G", "double"),), "minlen": (("E", "int"),), "mode": (("G", "string"),), "model": (("G", "string"),), "mosek": (("G", "bool"),), "nodesep": (("G", "double"),),
    "nojustify": (("GCNE", "bool"),), "normalize": (("G", "bool"),), "nslimit": (("G", "double"),), "nslimit1": (("G", "double"),), "ordering": (("GN", "string"),),
    "orientation": (("N", "double"), ("G", "string")), "outputorder": (("G", "outputMode"),), "overlap": (("G", "string|bool"),), "overlap_scaling": (("G", "double"),),
    "pack": (("G", "bool"),), "packmode": (("G", "packMode"),), "pad": (("G", "double|point"),), "page": (("G", "double|point"),), "pagedir": (("G", "pagedir"),),
    "pencolor": (("C", "color"),), "penwidth": (("CNE", "double"),), "peripheries": (("NC", "int"),), "pin": (("N", "bool"),), "pos": (("EN", "point|splineType"),),
    "quadtree": (("G", "quadType|bool"),), "quantum": (("G", "double"),), "rank": (("S", "rankType"),), "rankdir": (("G", "rankdir"),), "ranksep": (("G", "double|doubleList"),),
    "ratio": (("G", "double"),), "rects": (("N", "rect"),), "regular": (("N", "bool"),), "remincross": (("G", "bool"),), "repulsiveforce": (("G", "double"),),
    "resolution": (("G", "double"),), "root": (("GN", "string|bool"),), "rotate": (("G", "int"),), "rotation": (("G", "double"),), "samehead": (("E", "string"),),
    "sametail": (("E", "string"),), "samplepoints": (("N", "int"),), "scale": (("G", "double|point"),), "searchsize": (("G", "int"),), "sep": (("G", "addDouble|addPoint"),),
    "shape": (("N", "shape"),), "shapefile": (("N", "string"),), "showboxes": (("ENG", "int"),), "sides": (("N", "int"),), "size": (("G", "double|point"),),
    "skew": (("N", "double"),), "smoothing": (("G", "smoothType"),), "sortv": (("GCN", "int"),), "splines": (("G", "bool"),), "start": (("G", "startType"),),
    "style": (("ENCG", "style"),), "stylesheet": (("G", "string"),), "tailURL": (("E", "escString"),), "tail_lp": (("E", "point"),), "tailclip": (("E", "bool"),),
    "tailhref": (("E", "escString"),), "taillabel": (("E", "lblString"),), "tailport": (("E", "portPos"),), "tailtarget": (("E", "escString"),),
    "tailtooltip": (("E", "escString"),), "target": (("ENGC", "escString"),), "tooltip": (("NEC", "escString"),), "truecolor": (("G", "bool"),), "vertices": (("N", "pointList"),),
    "viewport": (("G", "viewPort"),), "voro_margin": (("G", "double"),), "weight": (("E", "int"),), "width": (("N", "double"),), "xlabel": (("EN", "lblString"),),
    "xlp": (("NE", "point"),), "z": (("N", "double"),),
}


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def unload(df: DataFrame, workbook: str) -> DataFrame:
    """SK2: a table without one workbook."""
    return df.filter(F.col("workbook") != workbook)


def labels_csv(labels: DataFrame, path: str) -> None:
    """SK3: File, Label, Count."""
    labels.select(F.col("workbook").alias("File"), F.col("label").alias("Label"), F.col("cnt").alias("Count")).write.mode("overwrite").csv(path, header=True)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def ntriples(triples: DataFrame, base: str = "urn:sheet:") -> DataFrame:
    """SK4: one line per triple; o_type iri (or none) is a resource, double and percentage are typed."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))
    literal = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    typed = (
        F.when(F.col("o_type") == "iri", iri(F.col("o"))).when(F.col("o_type") == "double", F.concat(literal, F.lit("^^<http://www.w3.org/2001/XMLSchema#double>")))
        .when(F.col("o_type") == "percentage", F.concat(literal, F.lit(f"^^<{base}percentage>"))).otherwise(literal)
    )
    return triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), typed, F.lit(".")).alias("value"))


def check_dot(attributes: DataFrame) -> DataFrame:
    """SK7: attributes (target G, N, E, S or C; name) that don't exist or don't apply."""
    known = attributes.sparkSession.createDataFrame([(n, t) for n, rows in DOT_ATTRIBUTES.items() for ts, _ in rows for t in ts], "name string, target string")
    return attributes.join(F.broadcast(known), ["name", "target"], "left_anti")


def dot_value(value: Column, kind: str) -> Column:
    """HP9."""
    if kind in ("int", "double"):
        return value.cast("string")
    return F.when(value, "true").otherwise("false") if kind == "bool" else F.concat(F.lit('"'), escaped(value.cast("string")), F.lit('"'))


def dot_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """SK6: kind, value: node and edge lines. vertices: n (number), label; edges: src, dst (numbers)."""
    nodes = vertices.select(F.lit("node").alias("kind"), F.concat(F.lit("  n"), F.col("n").cast("string"), F.lit(" [label="), dot_value(F.col("label"), "string"), F.lit("];")).alias("value"))
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(";")).alias("value")))


def dot_text(vertices: DataFrame, edges: DataFrame) -> str:
    """The whole graph; for graphs small enough to be drawn."""
    lines = [r.value for r in dot_lines(vertices, edges).orderBy(F.desc("kind"), "value").collect()]
    return "\n".join(["digraph G {", *lines, "}"]) + "\n"


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """SK5: node and edge elements. vertices: n, label, workbook, sheet, row, column, r, g, b; edges: src, dst."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    keys = [c for c in ("label", "sheet", "workbook", "row", "column", "r", "g", "b") if c in vertices.columns]
    data = [F.concat(F.lit(f'<data key="{k}">'), safe(k), F.lit("</data>")) for k in keys]
    nodes = vertices.select(F.lit("node").alias("kind"), F.concat(F.lit('<node id="n'), F.col("n").cast("string"), F.lit('">'), *data, F.lit("</node>")).alias("value"))
    return nodes.unionByName(
        edges.select(F.lit("edge").alias("kind"), F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('"/>')).alias("value"))
    )


def rendered() -> Column:
    """SK9: percentages times 100 with 3 decimals, numbers to 5 significant digits, the rest as text."""
    digits = F.when(F.col("num") == 0, 0).otherwise(4 - F.floor(F.log10(F.abs("num")))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    number = F.round(F.col("num") * scale) / scale
    short = F.when(F.col("num") == F.col("num").cast("long"), F.col("num").cast("long").cast("string")).otherwise(number.cast("string"))
    return F.when(F.col("vtype") == "percentage", F.concat(F.format_number(F.col("num") * 100, 3), F.lit("%"))).when(F.col("num").isNotNull(), short).otherwise(shown())


def cell_css() -> Column:
    return F.concat_ws(" ", F.lit("cell"), F.col("vtype"), F.when(F.col("formula").isNotNull(), "derived"))


def html_range(cells: DataFrame, sheet: str, sx: int, sy: int, ex: int, ey: int) -> str:
    """SK8: a range as a table; its size bounds what is collected."""
    box = cells.filter((F.col("sheet") == sheet) & F.col("x").between(sx, ex) & F.col("y").between(sy, ey))
    at = {(r.x, r.y): (r.css, r.text) for r in box.select("x", "y", cell_css().alias("css"), rendered().alias("text")).collect()}
    names = [r.n for r in cells.sparkSession.range(sx, ex + 1).select(column_name(F.col("id").cast("int")).alias("n"), "id").orderBy("id").collect()]
    rows = ["<tr><th></th>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"]
    for y in range(sy, ey + 1):
        tds = "".join(f'<td class="{html.escape(at[x, y][0])}">{html.escape(at[x, y][1] or "")}</td>' if (x, y) in at else "<td></td>" for x in range(sx, ex + 1))
        rows.append(f"<tr><th>{y}</th>{tds}</tr>")
    return "<table>\n" + "\n".join(rows) + "\n</table>\n"


def cell_text(sheet: Column, x: Column, y: Column) -> Column:
    """SK10: Sheet.A1."""
    from .operators.rect import sheet_text

    return F.concat(sheet_text(sheet), F.lit("."), column_name(x), y.cast("string"))
