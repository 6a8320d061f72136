"""Near-duplicate embeddings by product quantisation over coarse inverted lists.

Vectors of unit length with the same label link when their cosine reaches the threshold, that is when they
are within distance t. A coarse k-means, fitted on a bounded sample, gives each vector its inverted list;
the residual is coded per subspace (product quantisation), and the distance between a vector and its code,
its error, is stored. Only codes are moved, never vectors: with subspaces of one coordinate each a code takes a byte a
coordinate. The distance of two vectors differs from that of their codes by their errors at most, so
pairs of codes are taken as linked or not where the errors leave no doubt, and the rest are reranked by exact
cosine of the vectors. Pairs of lists are left out only where centroids and radii put all their members further
apart than t. So no link is lost, whatever the sample; recall is 1, and the fit only decides how much is read.

Equal vectors with equal labels are one node with a count, so copies are never paired; they are told by two 64-bit
hashes. The nodes of a label are dealt into blocks by hash, and each pair of blocks is a task's work, which returns a
count of links per node and a spanning forest of its links, not the links. Blocks are large, as a node is sent
once for each block of its label: disk grows with the number of blocks, time with the square of a label's nodes.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with null labels, link
with nothing: n_links 0, own component, kept. Vectors of other dimensions than the commonest of the sample form one list
per dimension, in which they stand whole. Rows that repeat an id and vector count as linked to each other; an id names
one component. Further columns are kept; those named n_links, component_id and kept are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Own, forest, map_batches, materialize, small, table
from .components import components
from .vectors import SAMPLE, distances, kmeans, matrix, usable

#: Nodes of a block, and of a label that is not cut in two.
BLOCK, WHOLE = 400_000, 64
#: Words of a subspace's codebook.
WORDS = 256
#: Rows and columns of the tiles in which codes are compared.
ROWS, COLUMNS = 256, 2048
FOUND = "kind int, a long, ha long, b long, hb long, n long"
LINK, COUNT, DOUBT = range(3)


def _book(x: np.ndarray) -> np.ndarray:
    """The words of a subspace of one coordinate, ascending: Lloyd's rounds from quantiles and the ends."""
    c = np.unique(np.r_[x.min(), np.quantile(x, (np.arange(WORDS - 2) + 0.5) / (WORDS - 2)), x.max()])
    for _ in range(8):
        at = np.searchsorted((c[1:] + c[:-1]) / 2, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n > 0, np.bincount(at, weights=x, minlength=len(c)) / np.maximum(n, 1), c)
    return c


class Index:
    """Coarse centroids and residual codebooks for vectors of one dimension."""

    def __init__(self, x: np.ndarray, lists: int):
        self.dim = x.shape[1] if len(x) else 0
        self.coarse = kmeans(x, lists) if len(x) else np.zeros((1, 0))
        rest = x - self.coarse[distances(x, self.coarse).argmin(1)] if len(x) else x
        self.books = np.zeros((self.dim, WORDS))
        self.cuts = []
        for m in range(self.dim):
            book = _book(rest[:, m])
            self.books[m, : len(book)] = book
            self.cuts.append((book[1:] + book[:-1]) / 2)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance to the coded vector."""
        at = distances(x, self.coarse).argmin(1)
        rest = x - self.coarse[at]
        codes = np.stack([np.searchsorted(c, rest[:, m]) for m, c in enumerate(self.cuts)], 1).astype(np.uint8)
        return at, codes, np.sqrt(((x - self.decode(at, codes)) ** 2).sum(1))

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[at] + self.books[np.arange(self.dim), codes]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sample(named: DataFrame) -> tuple[np.ndarray, int]:
    """The vectors of the SAMPLE least hashes, those of their commonest dimension, and the number of all hashes."""
    hashes = named.select("h").distinct()
    last = hashes.orderBy("h").limit(SAMPLE).agg(F.max("h")).head()[0]
    if last is None:
        return np.zeros((0, 0)), 0
    picked = named.filter(F.col("h") <= last).dropDuplicates(["h"]).orderBy("h").select("v").toArrow().column("v").combine_chunks()
    dims = np.diff(picked.offsets.to_numpy())
    found, n = np.unique(dims, return_counts=True)
    return unit(matrix(picked.take(pa.array(np.flatnonzero(dims == found[n.argmax()]))))), hashes.count()


def _coded(named: DataFrame, index: Index) -> DataFrame:
    """named with list, err and code for v. A vector of another dimension has the list -dim - 1 and is its own code."""

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column(batch.schema.get_field_index("v"))
        dims = np.diff(lists.offsets.to_numpy())
        at, errors, codes = -dims.astype(np.int64) - 1, np.zeros(len(dims)), [b""] * len(dims)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = unit(matrix(lists.take(pa.array(rows))))
            if dim == index.dim:
                at[rows], x, errors[rows] = index.code(x)
            for k, i in enumerate(rows):
                codes[i] = x[k].tobytes()
        return {"list": at, "err": errors, "code": codes}

    return map_batches(named, run, "list int, err double, code binary", ("v",))


class _Links:
    """What is found of links between a cell's nodes."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, err: np.ndarray, t: float):
        self.ids, self.copies, self.err, self.t = ids, copies, err, t
        self.parent, self.n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        self.doubt: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while not np.array_equal(up := self.parent[root], root):
            root = up
        self.parent[x] = root
        return root

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in ((i, j), (j, i)):
            low = x.min()
            sums = np.bincount(x - low, weights=self.copies[y]).astype(np.int64)
            self.n[low : low + len(sums)] += sums
        x, y = self.roots(i), self.roots(j)
        apart = x != y
        if apart.any():
            u, v = forest(x[apart], y[apart])
            self.parent[u] = v

    def judge(self, i: np.ndarray, j: np.ndarray, g: np.ndarray, slack: float) -> None:
        """g: minus half the squared distance of the codes, right up to the slack."""
        off = self.err[i] + self.err[j]
        near = np.maximum(self.t - off, 0)
        sure = (near > 0) & (g >= slack - near * near / 2)
        far = g < -((self.t + off) ** 2) / 2 - slack
        if sure.any():
            self.add(i[sure], j[sure])
        rest = ~sure & ~far
        if rest.any():
            self.doubt.append((i[rest], j[rest]))


def _tiles(links: _Links, z: np.ndarray, lists: np.ndarray, left: np.ndarray, right: np.ndarray, index: Index) -> None:
    """Compares the nodes left and right (places in z and links, ordered by list; the same ones to compare them all)."""
    same = left is right
    slack = max(1e-5, 2e-7 * z.shape[1])
    half = -0.5 * np.einsum("ij,ij->i", z, z, dtype=np.float64).astype(np.float32)
    one = np.ones((len(z), 1), np.float32)
    x, y = np.hstack([z, one, half[:, None]]), np.hstack([z, half[:, None], one])
    y = y[right]
    starts, ends, names, radius = [], [], [], []
    for rows in (left, right):
        at = np.flatnonzero(np.r_[True, lists[rows[1:]] != lists[rows[:-1]]])
        starts.append(at)
        ends.append(np.r_[at[1:], len(rows)])
        names.append(lists[rows[at]])
        if lists[rows[0]] >= 0:
            from_centre = np.sqrt(np.maximum(((z[rows] - index.coarse[lists[rows]]) ** 2).sum(1), 0)) + links.err[rows]
            radius.append(np.maximum.reduceat(from_centre, at))
    for s in range(len(starts[0])):
        if radius:
            apart = np.sqrt(((index.coarse[names[1]] - index.coarse[names[0][s]]) ** 2).sum(1))
            met = apart <= links.t + radius[0][s] + radius[1] + 1e-4
        else:
            met = np.ones(len(starts[1]), bool)
        edges = np.flatnonzero(np.diff(np.r_[False, met, False]))
        for a in range(starts[0][s], ends[0][s], ROWS):
            rows = left[a : min(a + ROWS, ends[0][s])]
            part, most = x[rows], links.err[rows].max()
            for low, high in zip(starts[1][edges[::2]], ends[1][edges[1::2] - 1]):
                for c in range(max(low, a) if same else low, high, COLUMNS):
                    columns = right[c : min(c + COLUMNS, high)]
                    g = part @ y[c : c + len(columns)].T
                    reach = links.t + most + links.err[columns].max()
                    hit = np.flatnonzero(g >= np.float32(-reach * reach / 2 - slack))
                    if len(hit):
                        i, j = np.divmod(hit, len(columns))
                        ok = links.ids[rows[i]] != links.ids[columns[j]]
                        if same:
                            ok &= c + j > a + i
                        if ok.any():
                            links.judge(rows[i[ok]], columns[j[ok]], g.ravel()[hit[ok]].astype(np.float64), slack)


def _compare(index: Index, threshold: float):
    t = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("list", "ascending"), ("h", "ascending")])
        lists, ids, h, mine = (cell.column(c).to_numpy() for c in ("list", "node", "h", "mine"))
        links = _Links(ids, cell.column("copies").to_numpy(), cell.column("err").to_numpy(), t)
        i, j = (cell.column(c)[0].as_py() for c in "ij")
        for rows in _parts(lists):
            left, right = (np.flatnonzero(mine[rows] == k) for k in (i, j))
            if not len(left) or not len(right):
                continue
            data = b"".join(cell.column("code").take(pa.array(rows)).to_pylist())
            if lists[rows[0]] >= 0:
                codes = np.frombuffer(data, np.uint8).reshape(len(rows), -1)
                z = np.concatenate([index.decode(lists[rows[k : k + 20_000]], codes[k : k + 20_000]).astype(np.float32) for k in range(0, len(rows), 20_000)])
            else:
                z = np.frombuffer(data, np.float64).reshape(len(rows), -1).astype(np.float32)
            part = _Links(ids[rows], links.copies[rows], links.err[rows], t)
            _tiles(part, z, lists[rows], left, left if i == j else right, index)
            links.parent[rows], links.n[rows] = rows[part.parent], part.n
            links.doubt += [(rows[a], rows[b]) for a, b in part.doubt]
        root = links.roots(np.arange(len(ids)))
        inner, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(links.n)
        a, b = (np.concatenate([d[k] for d in links.doubt] or [inner[:0]]) for k in range(2))
        first, second = np.r_[inner, some, a], np.r_[root[inner], some, b]
        kind = np.repeat(np.array([LINK, COUNT, DOUBT], np.int32), [len(inner), len(some), len(a)])
        return pa.table({"kind": kind, "a": ids[first], "ha": h[first], "b": ids[second], "hb": h[second], "n": links.n[first]})

    return run


def _parts(lists: np.ndarray) -> list[np.ndarray]:
    """The rows of lists of codes together, those of each other dimension by themselves."""
    kind = np.minimum(lists, 0)
    return [np.flatnonzero(kind == k) for k in np.unique(kind)]


def _reranked(doubt: DataFrame, named: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs in doubt those whose exact cosine reaches the threshold, with the copies of both, written."""
    wanted = materialize(doubt.select(F.explode(F.array("ha", "hb")).alias("h")).distinct(), "wanted")
    known = named.join(small(wanted), "h", "left_semi").dropDuplicates(["h"]).select("h", "v")
    known = materialize(known.join(nodes.select("h", "copies"), "h").dropDuplicates(["h"]), "vectors")
    both = doubt
    for c in "ab":
        both = both.join(known.select(F.col("h").alias(f"h{c}"), F.col("v").alias(f"v{c}"), F.col("copies").alias(f"copies_{c}")), f"h{c}")

    def run(batch: pa.RecordBatch) -> dict:
        one, two = (batch.column(batch.schema.get_field_index(c)) for c in ("va", "vb"))
        dims = np.diff(one.offsets.to_numpy())
        out = np.zeros(len(dims), bool)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x, y = (unit(matrix(v.take(pa.array(rows)))) for v in (one, two))
            out[rows] = np.einsum("ij,ij->i", x, y) >= threshold
        return {"linked": out}

    return materialize(map_batches(both, run, "linked boolean", ("va", "vb")).filter("linked"), "reranked")


def near_duplicates(
    df: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id",
    threshold: float = 0.93, block: int = BLOCK, rows_per_list: int = 1500, most_lists: int = 256,
) -> DataFrame:
    """df with n_links, component_id and kept."""
    own = Own(df, ("n_links", "component_id", "kept"))
    df, vector, label, vec_id = own.df, own.name(vector), own.name(label), own.name(vec_id)
    good = usable(F.col(vector)) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    v = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    # A node is told by two hashes of its label and vector.
    h, h2 = F.xxhash64(F.col(label), v), F.xxhash64(F.lit(1), F.col(label), v)
    named = df.filter(good).select(F.col(vec_id).cast("long").alias("node"), F.col(label).alias("l"), h.alias("h"), h2.alias("h2"), v.alias("v"))
    data, n = _sample(named)
    index = Index(data, max(1, min(most_lists, n // rows_per_list)))
    one = F.first(F.struct("list", "err", "code")).alias("one")
    nodes = _coded(named, index).groupBy("l", "h", "h2").agg(F.min("node").alias("node"), F.count("*").alias("copies"), one)
    nodes = materialize(nodes.select("l", "h", "h2", "node", "copies", "one.*"), "coded")

    size = nodes.groupBy("l").agg(F.count("*").alias("size"))
    cuts = F.when(F.col("size") <= min(WHOLE, block), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("size") / block))).cast("int")
    dealt = (
        nodes.join(small(size.select("l", cuts.alias("blocks"))), "l").withColumn("mine", F.pmod(F.col("h2"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("l", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "node", "h", "copies", "list", "err", "code")
    )
    found = materialize(dealt.groupBy("l", "i", "j").applyInArrow(_compare(index, threshold), FOUND), "links")
    links = found.filter(F.col("kind") == LINK).select("a", "b")
    counts = found.filter(F.col("kind") == COUNT).select("a", "ha", "n")
    doubt = found.filter(F.col("kind") == DOUBT).select("a", "ha", "b", "hb")
    if doubt.limit(1).count():
        sure = _reranked(doubt, named, nodes, threshold)
        links = links.union(sure.select("a", "b"))
        counts = counts.union(sure.select("a", "ha", "copies_b")).union(sure.select("b", "hb", "copies_a"))
    counts = counts.groupBy(F.col("a").alias("counted"), F.col("ha").alias("counted_h")).agg(F.sum("n").alias("n"))
    roots = components(links)
    known = (
        nodes.join(roots.withColumnRenamed("node", "rooted"), F.col("node") == F.col("rooted"), "left")
        .join(counts, (F.col("node") == F.col("counted")) & (F.col("h") == F.col("counted_h")), "left")
        .select(
            F.col("h").alias("k"), F.col("h2").alias("k2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component"),
        )
    )
    whole = df.select("*", F.when(good, h).alias("h"), F.when(good, h2).alias("h2"))
    joined = whole.join(known, (F.col("h") == F.col("k")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component", F.col(vec_id).cast("long"))
    return joined.select(
        *own.back(), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col(vec_id).cast("long") == component, F.lit(True)).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def brute_force(rows: pd.DataFrame, threshold: float = 0.93) -> pd.DataFrame:
    """All pairs, for tests: rows with vec_id, embedding, label."""
    good = [
        v is not None and len(v) and l is not None and l == l and all(c is not None and np.isfinite(c) for c in v) and any(v)
        for v, l in zip(rows.embedding, rows.label)
    ]
    n, parent, ids = [0] * len(rows), list(range(len(rows))), rows.vec_id.tolist()
    units = [unit(np.array([v], np.float64))[0] if g else None for v, g in zip(rows.embedding, good)]

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows.label.iloc[i] == rows.label.iloc[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = root(i), root(j)
                if x != y:
                    parent[x if ids[x] > ids[y] else y] = y if ids[x] > ids[y] else x
    component = [ids[root(i)] for i in range(len(rows))]
    return pd.DataFrame({"vec_id": ids, "n_links": n, "component_id": component, "kept": [a == b for a, b in zip(ids, component)]})
