"""Structure discovery: blocks, tables, headers, unions of intersecting blocks, colours (SD1-SD15).

Greedy growth depends on order, so a sheet is the unit of work: one group per sheet, held by one task. A sheet is
bounded by the spreadsheet format; sheets spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import checkpoint_dir
from .grid import empty
from .rect import adjacent, inside, intersecting, range_join, subtract

CLASSES = ("float", "percentage", "string")
COLOURS = 10


def grow(kind: dict, x: int, y: int) -> tuple[int, int, int, int] | None:
    """SD3, SD4: the block at (x, y): the widest row first, then equal rows below; else a column; 2 cells at least."""
    c, ex, ey = kind[(x, y)], x, y
    while kind.get((ex + 1, y)) == c:
        ex += 1
    if ex > x:
        while all(kind.get((i, ey + 1)) == c for i in range(x, ex + 1)):
            ey += 1
        return (x, y, ex, ey)
    while kind.get((x, ey + 1)) == c:
        ey += 1
    return (x, y, x, ey) if ey > y else None


def headers(kind: dict, r: tuple[int, int, int, int]) -> list[tuple[str, int, int, int, int]]:
    """SD6: slices of strings on each side, nearest first, until one fails; 2 cells at least."""
    sx, sy, ex, ey = r
    string = lambda xs, ys: all(kind.get((x, y)) == "string" for x in xs for y in ys)
    wide, high, out = range(sx, ex + 1), range(sy, ey + 1), []
    for side, step, line in (("top", -1, sy - 1), ("left", -1, sx - 1), ("right", 1, ex + 1), ("bottom", 1, ey + 1)):
        across = side in ("top", "bottom")
        if len(wide if across else high) < 2:
            continue
        while line > 0 and (string(wide, [line]) if across else string([line], high)):
            out.append((side, sx, line, ex, line) if across else (side, line, sy, line, ey))
            line += step
    return out


def discover(kind: dict, with_headers: bool) -> list[tuple]:
    """SD5, SD7: passes until none finds anything: blocks at unassigned anchors, those contained in others pruned, the
    cells of the rest (with headers: of their unions) assigned. Gives (class, data, headers, union)."""
    assigned: set[tuple[int, int]] = set()
    out: list[tuple] = []
    known: set[tuple] = set()
    while True:
        found = []
        for (x, y), c in sorted(kind.items(), key=lambda i: (i[0][1], i[0][0])):
            border = lambda p: kind.get(p) != c or p in assigned  # noqa: B023, E731
            if (x, y) not in assigned and border((x - 1, y)) and border((x, y - 1)) and (r := grow(kind, x, y)) and r not in known:
                found.append((c, r))
        rects = [r for _, r in found]
        within = lambda a, b: b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3]
        kept = [(c, r) for c, r in found if not any(r != o and within(r, o) for o in rects)]
        if not kept:
            return out
        for c, r in kept:
            known.add(r)
            hs = headers(kind, r) if with_headers else []
            whole = [r, *(h[1:] for h in hs)]
            u = (min(w[0] for w in whole), min(w[1] for w in whole), max(w[2] for w in whole), max(w[3] for w in whole))
            out.append((c, r, hs, u))
            x0, y0, x1, y1 = u if with_headers else r
            assigned.update((x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))


def _per_sheet(cells: DataFrame, fn, schema: str) -> DataFrame:
    own = cells.filter(~empty() & F.col("vtype").isin(*CLASSES)).select("workbook", "sheet", "x", "y", F.col("vtype").alias("class"))
    return own.groupBy("workbook", "sheet").applyInPandas(fn, schema)


def blocks(cells: DataFrame) -> DataFrame:
    """SD4, SD5: workbook, sheet, type, sx, sy, ex, ey."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = dict(zip(zip(pdf.x.tolist(), pdf.y.tolist()), pdf["class"]))
        rows = [(pdf.workbook.iloc[0], pdf.sheet.iloc[0], c, *r) for c, r, _, _ in discover(kind, False)]
        return pd.DataFrame(rows, columns=["workbook", "sheet", "type", "sx", "sy", "ex", "ey"])

    return _per_sheet(cells, run, "workbook string, sheet string, type string, sx int, sy int, ex int, ey int")


_RECT = "sx:int,sy:int,ex:int,ey:int"


def tables(cells: DataFrame) -> DataFrame:
    """SD6, SD7: workbook, sheet, type, sx, sy, ex, ey (the data), headers, ux, uy, uex, uey (the union)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = dict(zip(zip(pdf.x.tolist(), pdf.y.tolist()), pdf["class"]))
        rows = []
        for c, r, hs, u in discover(kind, True):
            rows.append((pdf.workbook.iloc[0], pdf.sheet.iloc[0], c, *r, [dict(zip(("side", "sx", "sy", "ex", "ey"), h)) for h in hs], *u))
        return pd.DataFrame(rows, columns=["workbook", "sheet", "type", "sx", "sy", "ex", "ey", "headers", "ux", "uy", "uex", "uey"])

    return _per_sheet(cells, run, f"workbook string, sheet string, type string, sx int, sy int, ex int, ey int, headers array<struct<side:string,{_RECT}>>, ux int, uy int, uex int, uey int")


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """SD11: vertex, component (the least vertex reachable) by min-label rounds with pointer jumping; each round is cut by
    a checkpoint. edges: a, b; vertices: vertex."""
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = vertices.select("vertex", F.col("vertex").alias("component")).checkpoint()
    while True:
        near = both.join(now, F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("component").alias("m"))
        lower = now.join(near, F.col("vertex") == F.col("a"), "left").select("vertex", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = now.select(F.col("vertex").alias("_v"), F.col("component").alias("_c"))
        after = lower.join(jump, F.col("c") == F.col("_v")).select("vertex", F.least("c", "_c").alias("component")).checkpoint()
        changed = after.join(now.select("vertex", F.col("component").alias("old")), "vertex").filter("component <> old")
        if changed.isEmpty():
            return after
        now = after


def data_blocks(rects: DataFrame, id_: str = "id", keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """SD8: intersecting blocks become one bounding box; its type is hybrid if theirs differ. Single ones stay."""
    pairs = intersecting(rects, id_, keys).select(F.col(f"a_{id_}").alias("a"), F.col(f"b_{id_}").alias("b"))
    marked = rects.join(components(pairs, rects.select(F.col(id_).alias("vertex"))), F.col(id_) == F.col("vertex"))
    kind = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise("hybrid") if "type" in rects.columns else F.lit(None).cast("string")
    return marked.groupBy(*keys, "component").agg(kind.alias("type"), F.count("*").alias("n"), F.min("sx").alias("sx"), F.min("sy").alias("sy"), F.max("ex").alias("ex"), F.max("ey").alias("ey"))


def problems(united: DataFrame, parts: DataFrame, cells: DataFrame) -> DataFrame:
    """SD9, SD10: the non-empty cells of each union that none of its parts covers. united: component, sheet and box;
    parts: component, sheet and box."""
    own = cells.filter(~empty()).select("workbook", "sheet", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    hit = lambda rects: range_join(rects, own, ["sheet"]).select(F.col("a_component").alias("component"), F.col("b_sheet").alias("sheet"), F.col("b_sx").alias("x"), F.col("b_sy").alias("y")).distinct()
    return hit(united).join(hit(parts), ["component", "sheet", "x", "y"], "left_anti")


def leftovers(pairs: DataFrame) -> DataFrame:
    """What of the union of a_ and b_ neither covers: union less a, less b. pairs: a_sx.., b_sx.., id."""
    u = pairs.withColumns({f"u_{c}": (F.least if c[0] == "s" else F.greatest)(f"a_{c}", f"b_{c}") for c in ("sx", "sy", "ex", "ey")})
    first = u.select("*", F.inline(subtract("u_", "a_")))
    named = first.withColumns({f"p_{c}": F.col(c) for c in ("sx", "sy", "ex", "ey")}).drop("piece", "sx", "sy", "ex", "ey")
    return named.select("id", F.inline(subtract("p_", "b_")))


def least_colouring(n: int, edges: set[tuple[int, int]], colours: int = COLOURS) -> list[int] | None:
    """The lexicographically smallest valid colouring of vertices 0..n-1 in order, or None."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        if a != b:
            near[max(a, b)].append(min(a, b))
    chosen, i = [0] * n, 0
    while 0 <= i < n:
        taken = {chosen[j] for j in near[i]}
        free = next((c for c in range(chosen[i] + 1, colours + 1) if c not in taken), None)
        chosen[i] = free or 0
        i += 1 if free else -1
    return chosen if i == n else None


def colour_sheets(rects: DataFrame, id_: str = "id") -> DataFrame:
    """SD13: sheet, id, colour of objects that touch or intersect another; neighbours differ. Vertices come in order of first
    appearance: adjacent pairs, then intersecting ones, each by ids. No colour if more than 10 are needed."""
    touch = adjacent(rects, id_).select(F.col("a_sheet").alias("sheet"), F.col(f"a_{id_}").alias("a"), F.col(f"b_{id_}").alias("b"), F.lit(0).alias("k"))
    cut = intersecting(rects, id_).select(F.col("a_sheet").alias("sheet"), F.col(f"a_{id_}").alias("a"), F.col(f"b_{id_}").alias("b"), F.lit(1).alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(pdf.sort_values(["k", "a", "b"])[["a", "b"]].itertuples(index=False, name=None))
        order = {v: i for i, v in enumerate(dict.fromkeys(v for p in pairs for v in p))}
        found = least_colouring(len(order), {(order[a], order[b]) for a, b in pairs})
        return pd.DataFrame({"sheet": pdf.sheet.iloc[0], "id": list(order), "colour": found or [None] * len(order)})

    return touch.unionByName(cut).groupBy("sheet").applyInPandas(run, f"sheet string, id {dict(rects.dtypes)[id_]}, colour int").filter("colour is not null")


def overlapping_cells(rects: DataFrame, id_: str = "id") -> DataFrame:
    """SD14: the cells of each intersection, with both ids."""
    pairs = intersecting(rects, id_)
    box = pairs.select(F.col("a_sheet").alias("sheet"), F.col(f"b_{id_}").alias("id1"), F.col(f"a_{id_}").alias("id2"), *[(F.greatest if c[0] == "s" else F.least)(f"a_{c}", f"b_{c}").alias(c) for c in ("sx", "sy", "ex", "ey")])
    return inside(box).select("sheet", "x", "y", "id1", "id2")


def segment(cells: DataFrame) -> dict[str, DataFrame]:
    """SD15: labels, blocks with ids, colours and overlapping cells of a workbook."""
    from .aggregate import label_counts
    from .rect import rect_id

    found = blocks(cells).withColumn("id", F.concat_ws("/", "workbook", rect_id("B")))
    own = found.withColumn("sheet", F.concat_ws("/", "workbook", "sheet"))
    return {"labels": label_counts(cells), "blocks": found, "colours": colour_sheets(own), "overlaps": overlapping_cells(own)}
