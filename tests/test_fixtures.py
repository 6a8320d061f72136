"""Micro-fixtures of each operator group, with expected values worked out by hand."""

import io
import zipfile
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.formula import evaluate as ev
from quadrille.formula import generalise as gen
from quadrille.formula.parse import FormulaError, parse, references, relative, text_of
from quadrille.functions import scalar as fn
from quadrille.operators import aggregate as agg
from quadrille.operators import cluster, discover, grid, rdf, rect
from quadrille.sources import ods

FULL = [f for f in grid.FIELDS]


def cells(spark, rows, workbook="w"):
    """(sheet, x, y, vtype, value, formula)"""
    out = []
    for sheet, x, y, vtype, value, *formula in rows:
        err = value[1:] if isinstance(value, str) and value.startswith("#") else None
        text = value if vtype == "string" and err is None else None
        number = float(value) if vtype in ("float", "percentage") and err is None and value is not None else None
        out.append((workbook, sheet, x, y, vtype, number, text, value if vtype == "boolean" else None, None, err, formula[0] if formula else None, "default", None))
    return spark.createDataFrame(out, grid.CELL)


F1 = [("S", x, 1, "string", t) for x, t in ((2, "2010"), (3, "2011"), (4, "2012"))] + [("S", 1, 2, "string", "x"), ("S", 1, 3, "string", "y")]
F1 += [("S", x, y, "float", v) for (x, y), v in zip(((2, 2), (3, 2), (4, 2), (2, 3), (3, 3), (4, 3)), (1, 2, 3, 4, 5, 6))]


def test_names():
    from quadrille.formula.parse import column_letters, column_number

    for n, name in ((1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA")):
        assert column_letters(n) == name and column_number(name) == n


def test_cells_and_classes(spark):
    c = cells(spark, [*F1, ("S", 1, 1, "no_type", None), ("S", 9, 9, "string", "")])
    assert grid.cell_value(c, x=2, y=2).head().num == 1.0 and grid.cell_value(c, x=1, y=1).count() == 0
    box = grid.bounding_box(c).head()
    assert (box.sx, box.sy, box.ex, box.ey) == (1, 1, 4, 3)
    kinds = {(r.x, r.y): r["class"] for r in grid.cell_class(c).collect()}
    assert len(kinds) == 30 and kinds[(0, 0)] == kinds[(1, 1)] == "empty" and kinds[(2, 1)] == "string" and kinds[(4, 3)] == "float"
    styles = spark.createDataFrame([("w", "default", {"font_size": "12pt", "cell_color": "transparent"}), ("w", "co1", {"column_width": "3cm"})], "workbook string, name string, props map<string,string>")
    cols = spark.createDataFrame([("w", "S", 2, "co1")], "workbook string, sheet string, x int, style string")
    assert grid.cell_style(c, styles, cols, "font_size").count() == 13 and grid.cell_style(c, styles, cols, "cell_color").count() == 0
    assert {r.value for r in grid.cell_style(c, styles, cols, "column_width").collect()} == {"3cm"} and grid.style_property(styles).count() == 2
    sizes = spark.createDataFrame([("12pt",), ("-3.5mm",), ("7em",)], "t string").select(grid.size_of(F.col("t")).alias("s")).collect()
    assert [(r.s.value, r.s.unit) if r.s else None for r in sizes] == [(12.0, "pt"), (-3.5, "mm"), None]


def test_numbering_and_repeats(spark):
    df = spark.range(0, 5000, 7).withColumn("k", F.col("id") * 3 - 4000)
    got = grid.numbered(df, ["k"], width=100).orderBy("k").collect()
    assert [r.y for r in got] == list(range(1, len(got) + 1))
    items = spark.createDataFrame([("s", 0, 2, "a"), ("s", 1, 3, "b")], "sheet string, i int, n int, v string")
    assert "".join(r.v for r in grid.expand_repeats(items, ["sheet"], "i", "n", "x").orderBy("x").collect()) == "aabbb"
    spans = spark.createDataFrame([("w", "s", 2, 2, 3, 3)], "workbook string, sheet string, sx int, sy int, ex int, ey int")
    assert {(r.x, r.y) for r in grid.expand_spans(spans).collect()} == {(3, 2), (2, 3), (3, 3)}


def rects(spark, rows):
    return spark.createDataFrame([(i, "S", *r) for i, r in enumerate(rows)], "id int, sheet string, sx int, sy int, ex int, ey int")


def test_subtract(spark):
    pairs = {(2, 2, 4, 4): 8, (1, 1, 5, 2): 1, (1, 1, 2, 5): 1, (1, 1, 2, 2): 3, (7, 1, 8, 2): 1, (1, 1, 5, 5): 0}
    df = spark.createDataFrame([(1, 1, 5, 5, *b) for b in pairs], ", ".join(f"{p}{c} int" for p in ("a_", "b_") for c in rect.RECT))
    for r in df.select("b_sx", "b_sy", "b_ex", "b_ey", rect.subtract("a_", "b_").alias("p")).collect():
        b = (r.b_sx, r.b_sy, r.b_ex, r.b_ey)
        size = sum((q.ex - q.sx + 1) * (q.ey - q.sy + 1) for q in r.p)
        covered = max(0, min(5, b[2]) - max(1, b[0]) + 1) * max(0, min(5, b[3]) - max(1, b[1]) + 1)
        assert len(r.p) == pairs[b] and size == 25 - covered


def test_rect_ids_and_joins(spark):
    df = rects(spark, [(1, 1, 3, 3), (2, 2, 4, 4), (5, 2, 6, 3), (1, 5, 2, 6), (2, 2, 3, 3), (2, 2, 3, 3), (60, 60, 140, 61)])
    ids = df.withColumn("name", rect.rect_id("B")).withColumn("back", rect.parse_rect_id(F.col("name")))
    assert all((r.back.sheet, r.back.sx, r.back.sy, r.back.ex, r.back.ey, r.back.prefix) == (r.sheet, r.sx, r.sy, r.ex, r.ey, "B") for r in ids.collect())
    at = {r.id: (r.sx, r.sy, r.ex, r.ey) for r in df.collect()}
    meets = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    want = {(j, i) for i, j in combinations(at, 2) if meets(at[i], at[j])}
    assert {(r.a_id, r.b_id) for r in rect.intersecting(df, tile=2).collect()} == want
    assert {(r.a_id, r.b_id, r.relation) for r in rect.adjacent(df, tile=3).collect()} == {(1, 2, "left_of"), (2, 1, "right_of"), (1, 3, "above"), (3, 1, "below")}
    assert {r.id for r in rect.pruned(df).collect()} == {0, 1, 2, 3, 6}
    assert rect.join_adjacent(rects(spark, [(1, 1, 2, 2), (3, 1, 4, 2), (6, 1, 7, 2)]).drop("id"), "sheet").count() == 2
    assert tuple(rect.bounding(df.limit(0)).head()) == (0, 0, 0, 0)


F3 = [("S", 1, i, "float", v) for i, v in enumerate((10, 20, 30), 1)] + [("S", 2, i, "string", v) for i, v in enumerate("abc", 1)]


@pytest.mark.parametrize("v,exact,ceiling,floor", [(20, "b", "b", "b"), (15, None, "b", "a"), (35, None, None, "c"), (5, None, "a", None)])
def test_lookups(spark, v, exact, ceiling, floor):
    probes = spark.createDataFrame([(float(v),)], "v double")
    keys = spark.createDataFrame([(10.0, 1, "a"), (20.0, 2, "b"), (20.0, 3, "z"), (30.0, 4, "c")], "k double, pos int, val string")
    assert agg.lookup_exact(probes, "v", keys, "k", "pos", "val").head().found == exact
    for buckets in (None, [12.0, 20.0, 33.0]):
        assert agg.lookup_sorted(probes, "v", keys, "k", "pos", "val", "ceiling", buckets).head().found == ceiling
        assert agg.lookup_sorted(probes, "v", keys, "k", "pos", "val", "floor", buckets).head().found == floor
    grid_ = ev.Grid([[10.0, "a"], [20.0, "b"], [30.0, "c"]])
    for mode, text, want in (("ceiling", "FALSE()", exact), ("ceiling", "TRUE()", ceiling), ("floor", "TRUE()", floor)):
        got = ev.evaluate_text(f"VLOOKUP({v};[.A1:.B3];2;{text})", lambda r: grid_, mode)
        assert got == (want or "N/A")


def test_aggregates(spark):
    c = cells(spark, [("S", 1, 1, "float", 1), ("S", 1, 3, "float", 3), ("S", 2, 1, "float", 5), ("S", 2, 2, "string", "#DIV/0!")])
    got = {r.x: r for r in agg.range_aggregates(c, "x", dense=F.lit(3)).collect()}
    assert (got[1].total, got[1].largest, got[1].least, got[1].err, got[2].err) == (4.0, 3.0, 1.0, None, "DIV/0!") and abs(got[1].average - 4 / 3) < 1e-12
    ranks = spark.createDataFrame([(5.0,), (5.0,), (3.0,), (None,)], "v double")
    assert sorted(r["rank"] for r in agg.ranked(ranks, "v").collect()) == [1, 1, 3] and sorted(r["rank"] for r in agg.ranked(ranks, "v", ascending=True).collect()) == [1, 2, 2]
    runs = spark.createDataFrame([(v,) for v in (1, 2, 3, 5, 7, 8, 8)], "v int")
    assert {(r.low, r.high) for r in agg.compress(runs, "v").collect()} == {(1, 3), (5, 5), (7, 8)}
    labels = cells(spark, [("S", 1, i, "string", t) for i, t in enumerate(["b", "a", "a", "c", ""], 1)])
    assert [(r.label, r.cnt) for r in agg.label_counts(labels).orderBy("rank").collect()] == [("a", 2), ("c", 1), ("b", 1)]
    assert agg.repeating_pattern(list("abcbcd")) == [(1, ["a"]), (2, ["b", "c"]), (1, ["d"])]


@pytest.mark.parametrize("text,want", [
    ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ROUND(1.005;2)", 1.0), ("ROUND(1234;-2)", 1200.0), ("ROUNDDOWN(-2.7)", -2.0), ("ROUNDDOWN(2.79;1)", 2.7),
    ("PMT(0;10;1000)", -100.0), ('CONCATENATE(1.0;" a  b ")', "1 a b"), ("1/0", "DIV/0!"), ('IF(1;"t";"e")', "e"), ('IF(TRUE();"t";1/0)', "t"), ("-2^2", 4.0), ("2-3-4", -5.0),
    ("ISERROR(1/0)", True), ("50%+1", 1.5), ("1&2", "12"), ('"a"="A"', False), ("1<>2", True), ('1<"a"', True), ("NOSUCH(1)", "N/A"), ("2^3^2", 64.0), (".5e1*2", 10.0), ('"x""y"', 'x"y'),
    ("1+1/0", "DIV/0!"), ('"abc"+1', "VALUE!"), ("[#REF!]+1", "REF!"), ("1!2", "N/A"), ("-5%", -0.05), ("MAX()", 0.0), ("EXP(0)", 1.0),
])
def test_expressions(text, want):
    got = ev.evaluate_text(text)
    assert got == want and isinstance(got, bool) == isinstance(want, bool)


def test_annuities(spark):
    assert abs(ev.evaluate_text("PMT(0.01;12;1000)") + 88.84878867834169) < 1e-9 and abs(ev.evaluate_text("PMT(0.01;12;1000;0;1)") + 87.96909770132841) < 1e-9
    row = spark.range(1).select(fn.pmt(F.lit(0.01), F.lit(12.0), F.lit(1000.0), 0.0, True).alias("p"), fn.round_half_away(F.lit(1.005), 2).alias("r")).head()
    assert abs(row.p + 87.96909770132841) < 1e-9 and row.r == 1.0


def test_range_functions():
    column = ev.Grid([[1.0], [ev.EMPTY], [3.0]])
    read = lambda r: column
    want = {"SUM": 4.0, "AVERAGE": 4 / 3, "MAX": 3.0, "MIN": 1.0}
    assert all(ev.evaluate_text(f"{k}([.A1:.A3])", read) == v for k, v in want.items())
    assert ev.evaluate_text('COUNTIF([.A1:.A3];">1")', read) == 1.0 and ev.evaluate_text("COUNTIF([.A1:.A3];3)", read) == 1.0
    ranks = lambda r: ev.Grid([[5.0], [5.0], [3.0]])
    assert [ev.evaluate_text(f"RANK({v};[.A1:.A3]{o})", ranks) for v, o in ((5, ""), (3, ""), (3, ";1"), (5, ";1"), (9, ""))] == [1.0, 3.0, 1.0, 2.0, "N/A"]
    assert ev.evaluate_text("MATCH(3;[.A1:.A3];0)", read) == 3.0 and ev.evaluate_text("MATCH(2;[.A1:.A3];1)", read) == 1.0
    assert ev.evaluate_text("SUM([.A1:.A3])", lambda r: ev.Grid([[1.0], [ev.DIV0]])) == "DIV/0!" and ev.evaluate_text("ISBLANK([.A1])", lambda r: ev.Grid([[ev.EMPTY]])) is True


def test_parser():
    assert references(parse("of:=[.A1]+['My Sheet'.$B$2:.C3]*['file:///x y.ods'#Data.A1]")) == [("ref", "", "", 1, 1, 1, 1), ("ref", "", "My Sheet", 2, 2, 3, 3), ("ref", "file:///x y.ods", "Data", 1, 1, 1, 1)]
    assert parse("of:=[.A1]:[.B2]") == ("ref", "", "", 1, 1, 2, 2) and parse("of:=SUM([.A1]:OFFSET([.A1];2;1))")[2][0] == ("ref", "", "", 1, 1, 2, 3)
    assert parse("of:=[A.A1:B.B2]") == ("err", "REF!") and references(parse("of:=[.B:.B]")) == [("ref", "", "", 2, None, 2, None)]
    assert relative(parse("of:=[.A1]*2"), 2, 1) == relative(parse("of:=[.A5]*2"), 2, 5) != relative(parse("of:=[.A6]*2"), 2, 5)
    for text in ("of:=1+(2*[.A1])", "of:=SUM([.A1:.B2];3)&\"x\"", "of:=-[.A1]%"):
        assert parse("of:=" + text_of(parse(text))) == parse(text)
    for bad in ("=1", "of:=1+", "of:=(1", "of:=F(;)", "of:=[.!]"):
        with pytest.raises(FormulaError):
            parse(bad)


F2 = [("S", x, y, "float", v) for y, (a, b) in zip((8, 9, 10), ((9, 4), (8, 3), (7, 2))) for x, v in ((3, a), (4, b))]
F2 += [("S", 5, y, "float", 5, f"of:=[.C{y}]-[.D{y}]") for y in (8, 9, 10)]


def test_formula_run(spark):
    c = cells(spark, F2)
    group = gen.groups(gen.relative_keys(c)).collect()
    assert len(group) == 1 and group[0].shape == "column" and group[0].n == 3
    made = gen.range_formulas(c).collect()
    assert [(r.sx, r.sy, r.ex, r.ey, r.expr) for r in made] == [(5, 8, 5, 10, "([.C8:.C10]-[.D8:.D10])")] and gen.range_inputs(gen.range_formulas(c)).count() == 2
    assert gen.dependency_edges(c).count() == 6
    assert [r.status for r in ev.verify(c).collect()] == ["passed"] * 3 and ev.statistics(ev.verify(c)).head()["count"] == 3


def test_moving_ranges_areas_and_mixed_ranges(spark):
    moving = cells(spark, [("S", 2, y, "float", 0, f"of:=SUM([.A{y}:.A{y + 1}])") for y in (1, 2)])
    assert {(r.sy, r.expr) for r in gen.range_formulas(moving).collect()} == {(1, "SUM([.A1:.A2])"), (2, "SUM([.A2:.A3])")}
    area = cells(spark, [("S", x, y, "float", 0, f"of:=[.{'ABCD'[x - 3]}{y}]") for x in (3, 4) for y in (1, 2)])
    assert [(r.sx, r.sy, r.ex, r.ey, r.expr) for r in gen.range_formulas(area).collect()] == [(3, 1, 4, 2, "[.A1:.B2]")]
    mixed = cells(spark, [("S", 1, 1, "float", 1), ("S", 1, 2, "float", 1, "of:=[.A1]"), ("S", 2, 1, "float", 2, "of:=SUM([.A1:.A2])"), ("S", 3, 1, "float", 2, "of:=SUM([.A5:.A6])")])
    edges = {(r.src_x, r.src_y, r.src_ex, r.src_ey, r.dst_x, r.dst_y) for r in gen.dependency_edges(mixed).collect()}
    assert edges == {(1, 1, 1, 1, 1, 2), (1, 1, 1, 1, 2, 1), (1, 2, 1, 2, 2, 1), (1, 5, 1, 6, 3, 1)}


def test_evaluation_of_cells(spark):
    rows = [("S", 1, 1, "float", 2), ("T u", 1, 1, "float", 7), ("S", 2, 1, "string", "q"), ("S", 3, 1, "float", 14, "of:=[.A1]*['T u'.A1]"), ("S", 3, 2, "string", "q2", "of:=[.B1]&[.A1]"), ("S", 3, 3, "float", 9, "of:=['gone.ods'#X.A1]+1")]
    rows += [("S", 3, 4, "boolean", True, "of:=ISBLANK([.Z9])"), ("S", 3, 5, "float", 1, "of:=nonsense ["), ("S", 3, 6, "float", 2, "of:=SUM([.A:.A])"), ("S", 3, 7, "string", "#DIV/0!", "of:=1/0"), ("S", 3, 8, "percentage", 0.5, "of:=50%")]
    got = {r.y: (r.v_num, r.v_str, r.v_bool, r.v_err) for r in ev.evaluate(cells(spark, rows)).collect()}
    assert got == {1: (14.0, None, None, None), 2: (None, "q2", None, None), 3: (None, None, None, "REF!"), 4: (None, None, True, None), 5: (None, None, None, "N/A"), 6: (2.0, None, None, None), 7: (None, None, None, "DIV/0!"), 8: (0.5, None, None, None)}
    assert {r.y for r in ev.verify(cells(spark, rows)).collect() if r.status == "failed"} == {3, 5}


def test_precedents_end_on_cycles(spark):
    edges = spark.createDataFrame([("B1", "A1"), ("C1", "A1"), ("D1", "B1"), ("A1", "D1")], "src string, dst string")
    got = {r.vertex for r in gen.precedents(edges, spark.createDataFrame([("A1",)], "vertex string")).collect()}
    assert got == {"B1", "C1", "D1", "A1"}


def test_discovery(spark):
    c = cells(spark, F1)
    found = {(r.type, r.sx, r.sy, r.ex, r.ey) for r in discover.blocks(c).collect()}
    assert found == {("string", 2, 1, 4, 1), ("string", 1, 2, 1, 3), ("float", 2, 2, 4, 3)}
    table = next(r for r in discover.tables(c).collect() if r.type == "float")
    assert [(h.side, h.sx, h.sy, h.ex, h.ey) for h in table.headers] == [("top", 2, 1, 4, 1), ("left", 1, 2, 1, 3)] and (table.ux, table.uy, table.uex, table.uey) == (1, 1, 4, 3)
    column = cells(spark, [("S", 1, 1, "string", "h"), ("S", 1, 2, "float", 1), ("S", 1, 3, "float", 2), ("S", 5, 5, "float", 1)])
    assert [(r.type, len(r.headers)) for r in discover.tables(column).collect()] == [("float", 0)]
    runs = {(r.y, r["class"], r.low, r.high) for r in agg.class_runs(grid.cell_class(c).filter("class <> 'empty'"), "x", "class", "y").collect()}
    assert runs == {(1, "string", 2, 4), (2, "float", 2, 4), (3, "float", 2, 4)}
    parts = discover.segment(c)
    colours = {r.id: r.colour for r in parts["colours"].collect()}
    assert len(colours) == 3 and colours["w/B[S.B2:D3]"] not in (colours["w/B[S.B1:D1]"], colours["w/B[S.A2:A3]"]) and parts["overlaps"].count() == 0
    labels = {(r.side, r.label) for r in rdf.possible_labels(c).filter("x = 3 and y = 3").collect()}
    assert labels == {("left", "y"), ("top", "2011")}


def test_overlapping_blocks(spark):
    df = rects(spark, [(1, 1, 3, 3), (3, 3, 5, 5), (9, 9, 9, 10)]).withColumn("type", F.when(F.col("id") == 1, "string").otherwise("float"))
    merged = {(r.type, r.n, r.sx, r.sy, r.ex, r.ey) for r in discover.data_blocks(df).collect()}
    assert merged == {("hybrid", 2, 1, 1, 5, 5), ("float", 1, 9, 9, 9, 10)}
    assert [(r.x, r.y) for r in discover.overlapping_cells(df).collect()] == [(3, 3)]
    pair = spark.createDataFrame([(1, 1, 1, 3, 3, 3, 3, 5, 5)], "id int, " + ", ".join(f"{p}{c} int" for p in ("a_", "b_") for c in rect.RECT))
    assert sum((r.ex - r.sx + 1) * (r.ey - r.sy + 1) for r in discover.leftovers(pair).collect()) == 25 - 17
    own = cells(spark, [("S", 5, 1, "float", 1), ("S", 1, 1, "float", 1)])
    united = spark.createDataFrame([(0, "S", 1, 1, 5, 5)], "component int, sheet string, sx int, sy int, ex int, ey int")
    parts = df.select(F.lit(0).alias("component"), "sheet", *rect.RECT)
    assert [(r.x, r.y) for r in discover.problems(united, parts, own).collect()] == [(5, 1)]
    assert discover.least_colouring(3, {(0, 1), (1, 2), (0, 2)}) == [1, 2, 3] and discover.least_colouring(3, {(0, 1), (1, 2), (0, 2)}, 2) is None


def test_clusters(spark):
    df = rects(spark, [(x + d, x + d, x + d + 2, x + d + 2) for x in (0, 100) for d in range(5)])
    got = {r.id: r.cluster for r in cluster.k_means(df, 2).collect()}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]
    assert sorted(r.cluster for r in cluster.k_means(df, 10).collect()) == list(range(10))


def workbook(path, body, styles=""):
    ns = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("table", "table"), ("text", "text"), ("style", "style"), ("fo", "xsl-fo-compatible")))
    xml = f'<?xml version="1.0"?><office:document-content {ns} xmlns:dc="http://purl.org/dc/elements/1.1/"><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("content.xml", xml)
    path.write_bytes(buffer.getvalue())


def test_workbooks(spark, tmp_path):
    cell = lambda v, **a: f'<table:table-cell office:value-type="float" office:value="{v}" ' + " ".join(f'table:{k.replace("_", "-")}="{x}"' for k, x in a.items()) + "/>"
    body = '<table:table table:name="A" table:style-name="ta1"><table:table-column table:number-columns-repeated="2" table:style-name="co1"/><table:table-column/>'
    body += '<table:table-row table:number-rows-repeated="2">' + cell(1, number_columns_repeated=3) + "</table:table-row>"
    body += '<table:table-row><table:table-cell office:value-type="string" table:number-columns-spanned="2" table:number-rows-spanned="2"><text:p>a  b</text:p><text:p>c</text:p></table:table-cell><table:covered-table-cell/>' + cell(5) + "</table:table-row>"
    body += '<table:table-row><table:covered-table-cell table:number-columns-repeated="2"/><table:table-cell office:value-type="percentage" office:value="0.19"/><table:table-cell office:value-type="date" office:date-value="2012-03-04"/><table:table-cell office:value-type="boolean" office:boolean-value="true"/></table:table-row>'
    body += '<table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row><table:table-row><table:table-cell table:style-name="ce1"/><table:table-cell><office:annotation><dc:date>2012-01-02T03:04:05</dc:date><text:p>me</text:p><text:p>note</text:p></office:annotation></table:table-cell>'
    body += "<table:table-cell office:value-type=\"float\" office:value=\"8\" table:formula=\"of:=['two.ods'#B.A1]+1\"/><table:table-cell office:value-type=\"float\" office:value=\"8\" table:formula=\"of:=['three.ods'#B.A1]\"/></table:table-row></table:table>"
    workbook(tmp_path / "one.ods", body, '<style:style style:name="co1"><style:table-column-properties style:column-width="2cm"/></style:style>')
    workbook(tmp_path / "two.ods", '<table:table table:name="B"><table:table-row>' + cell(7) + "</table:table-row></table:table>")
    (tmp_path / "bad.ods").write_bytes(b"no archive")
    one = ods.read_ods(spark, f"file://{tmp_path}/one.ods")
    got = {(r.x, r.y): r for r in one.collect()}
    assert [got[x, y].num for y in (1, 2) for x in (1, 2, 3)] == [1.0] * 6 and got[1, 3].str == "a bc" and got[3, 3].num == 5.0
    assert got[3, 4].vtype == "percentage" and got[3, 4].num == 0.19 and str(got[4, 4].dt) == "2012-03-04" and got[5, 4].bool is True
    assert got[1, 8].vtype == "no_type" and got[1, 8].style == "ce1" and got[2, 8].annotations[0].author == "me" and got[2, 8].annotations[0].text == "note"
    assert {(r.x, r.y) for r in ods.read_spans(spark, f"file://{tmp_path}/one.ods").collect()} == {(2, 3), (1, 4), (2, 4)}
    layout = ods.read_layout(spark, f"file://{tmp_path}/one.ods")
    assert layout["sheet"].count() == 1 and layout["col"].count() == 3 and layout["row"].count() == 8 and layout["style"].head().props["column_width"] == "2cm"
    assert ods.read_ods(spark, f"file://{tmp_path}/bad.ods").count() == 0
    linked, status = ods.load_linked(spark, f"file:{tmp_path}/one.ods")
    assert {r.url: r.status for r in status.collect() if "/" not in r.url} == {"two.ods": "loaded", "three.ods": "REF!"}
    values = {(r.x, r.y): (r.v_num, r.v_err) for r in ev.evaluate(linked).collect()}
    assert values[3, 8] == (8.0, None) and values[4, 8] == (None, "REF!")


def test_links_are_followed_until_none_is_new(spark, tmp_path):
    def linking(name, *to):
        cells = "".join(f"<table:table-cell office:value-type=\"float\" office:value=\"1\" table:formula=\"of:=['{url}'#A.A1]\"/>" for url in to)
        workbook(tmp_path / name, f'<table:table table:name="A"><table:table-row>{cells}</table:table-row></table:table>')

    linking("start.ods", "b.ods", "https://example.org/web.ods", "odd:name.ods")
    linking("b.ods", "c.ods")
    linking("c.ods", "d.ods", "b.ods")
    linking("d.ods", f"file://{tmp_path}/e.ods")
    linking("e.ods", "lost.ods")
    cells, status = ods.load_linked(spark, f"file:{tmp_path}/start.ods")
    got = {r.url.rpartition("/")[2]: r.status for r in status.collect()}
    assert got == {"start.ods": "loaded", "b.ods": "loaded", "c.ods": "loaded", "d.ods": "loaded", "e.ods": "loaded", "web.ods": "REF!", "odd:name.ods": "REF!", "lost.ods": "REF!"}
    assert cells.count() == 8


def test_streamed_workbooks(spark, tmp_path):
    from quadrille.streaming import load_directory

    (tmp_path / "in").mkdir()
    workbook(tmp_path / "in/a.ods", '<table:table table:name="B"><table:table-row><table:table-cell office:value-type="float" office:value="7"/></table:table-row></table:table>')
    load_directory(spark, f"file://{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").head().num == 7.0


def test_sinks(spark, tmp_path):
    c = cells(spark, [("S", 1, 1, "float", 3.14159265), ("S", 2, 1, "percentage", 0.19), ("S", 1, 2, "string", "<a&b>"), ("S", 2, 2, "float", 5, "of:=2+3")])
    page = sinks.html_range(c, "S", 1, 1, 2, 3)
    assert "3.1416" in page and "19.000%" in page and "&lt;a&amp;b&gt;" in page and 'class="cell float derived"' in page and "<th>B</th>" in page
    lines = [r.value for r in sinks.ntriples(rdf.cell_triples(c)).collect()]
    assert len(lines) == 8 and any(x.endswith('"0.19"^^<urn:sheet:percentage> .') for x in lines) and all(x.startswith("<urn:sheet:S%2F") for x in lines)
    assert rdf.neighbour_triples(c).count() == 4 and rdf.neighbour_triples(c, strict=True).count() == 2
    v, e = spark.createDataFrame([(0, 'a"b'), (1, "c")], "n int, label string"), spark.createDataFrame([(0, 1)], "src int, dst int")
    assert sinks.dot_text(v, e) == 'digraph G {\n  n0 [label="a\\"b"];\n  n1 [label="c"];\n  n0 -> n1;\n}\n'
    assert sinks.graphml_lines(v, e).count() == 3
    bad = sinks.check_dot(spark.createDataFrame([("N", "label"), ("E", "sides"), ("G", "nope")], "target string, name string"))
    assert {(r.target, r.name) for r in bad.collect()} == {("E", "sides"), ("G", "nope")}
    sinks.labels_csv(agg.label_counts(c), f"{tmp_path}/labels")
    assert spark.read.csv(f"{tmp_path}/labels", header=True).columns == ["File", "Label", "Count"]
    units = ods.unit_symbols(spark.createDataFrame([('om:metre om:symbol "m" ;',), ("other",)], "value string"))
    tokens = rdf.label_tokens(spark.createDataFrame([("Lengte 5 m miljoen",)], "label string"), units).orderBy("pos").collect()
    assert [(r.token, r.kind) for r in tokens] == [("lengte", "word"), ("5", "number"), ("m", "unit"), ("miljoen", "large")]
    assert sinks.unload(c, "w").count() == 0 and c.select(sinks.cell_text(F.lit("a b"), F.col("x"), F.col("y")).alias("t")).head().t == "'a b'.A1"


def test_sk7_all_attributes_of_the_table(spark):
    good = [("E", "arrowtail"), ("S", "rank"), ("C", "pencolor"), ("G", "splines"), ("N", "orientation"), ("G", "orientation"), ("N", "margin"), ("C", "color")]
    bad = [("S", "label"), ("G", "rank"), ("N", "pencolor")]
    got = sinks.check_dot(spark.createDataFrame(good + bad, "target string, name string"))
    assert sorted((r.target, r.name) for r in got.collect()) == sorted(bad)
    assert sum(map(len, sinks.DOT_ATTRIBUTES.values())) == 166


def test_long_repeats_are_expanded(spark, tmp_path):
    def cell(attributes, inside=""):
        return f"<table:table-cell {attributes}>{inside}</table:table-cell>"

    value = cell('office:value-type="float" office:value="1"', "<text:p>1</text:p>")
    styled = 'table:style-name="s" table:number-columns-repeated="10001"'
    body = f"<table:table-row>{value}{cell(styled)}</table:table-row>"
    body += f'<table:table-row table:number-rows-repeated="20000">{cell(styled)}</table:table-row>'
    body += f"""<table:table-row table:number-rows-repeated="10001">{cell('table:formula="of:=1"')}</table:table-row>"""
    body += f'<table:table-row table:number-rows-repeated="1000000">{cell(styled)}</table:table-row>'
    head = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "table", "text"))
    sheet = f'<table:table table:name="S"><table:table-column table:style-name="c" table:number-columns-repeated="16384"/>{body}</table:table>'
    with zipfile.ZipFile(tmp_path / "long.ods", "w") as z:
        z.writestr("content.xml", f"<office:document-content {head}><office:body><office:spreadsheet>{sheet}</office:spreadsheet></office:body></office:document-content>")
    layout = ods.read_layout(spark, f"file://{tmp_path}/long.ods")
    assert layout["col"].agg(F.count("*"), F.max("x")).head() == (16384, 16384)
    assert layout["row"].agg(F.count("*"), F.max("y")).head() == (1030002, 1030002)
    got = ods.read_ods(spark, f"file://{tmp_path}/long.ods").groupBy(F.when(F.col("y") == 1, 1).when(F.col("y") <= 20001, 2).otherwise(3).alias("k")).agg(F.count("*"), F.max("x"), F.max("y"))
    assert sorted(map(tuple, got.collect())) == [(1, 10002, 10002, 1), (2, 20000, 1, 20001), (3, 10001, 1, 30002)]


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_islands_join_over_stretches(spark, monkeypatch, width):
    import random

    from quadrille.operators import aggregate

    monkeypatch.setattr(aggregate, "WIDTH", width)
    rng = random.Random(3)
    held = sorted({("a", p) for p in rng.sample(range(-30, 60), 70)} | {("b", p) for p in range(0, 33)} | {("c", 4), ("c", 5)})
    df = spark.createDataFrame([(k, p, f"{k}{p}") for k, p in held], "k string, p int, f string")
    want = []
    for k, p in held:
        if want and want[-1][0] == k and want[-1][2] == p - 1:
            want[-1][2] = p
        else:
            want.append([k, p, p, f"{k}{p}"])
    got = aggregate.islands(df, "p", "k", first="f").select("k", "low", "high", "f").collect()
    assert sorted(map(list, got)) == sorted(want)


def test_label_ranks_equal_a_plain_sort(spark):
    from quadrille.operators import aggregate

    labels = ["abc", "abcd", "abd", "é", "z", "ab", "zz", "abcd", "z", "ab", "q", "abce"]
    df = spark.createDataFrame([("w", x) for x in labels], "workbook string, str string")
    counted = sorted({(labels.count(x), x) for x in labels}, reverse=True)
    assert [(r.label, r.cnt) for r in sorted(aggregate.label_counts(df).collect(), key=lambda r: r["rank"])] == [(x, n) for n, x in counted]
