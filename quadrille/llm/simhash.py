"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share
at least 4 bytes at the same position. The index posts each distinct fingerprint under triples of
positioned bytes: the 20 triples of COVER, of which every set of 4 positions holds one, so each pair to be
found meets in some posting list. In a list, shared positional bytes are tallied per pair, pairs that
reach 4 are retained, and retained pairs are verified bit by bit. A list longer than `block` fingerprints
is cut into blocks by hash, and each pair of blocks is a task's work of its own, so no list is gathered
whole. Of the verified links of a list, a spanning forest is emitted: as many rows as members at most.

Null text counts as empty; a document without words has fingerprint zero, linked like any other. Equal
fingerprints are one node, so copies are never paired. A null doc_id is never a component's id, unless
the component has no other. Repeated rows give repeated results. Further columns are kept; those named
fingerprint and component_id are replaced.

The pipeline's stage (near_copies) takes texts whose sets of five-word shingles are similar at 0.8. Fingerprints of 64 bits and 4
differing bits reach few of them, so it votes 128 bits over the distinct shingles and posts them under the 56 pairs
of byte positions of the same half: all that share 3 of the 16 bytes meet in a list. Fingerprints that differ in WIDE bits at
most are candidates, and their whole sets are compared. A pair at 0.8 differs in some 19 bits, and shares less than two bytes of a
half in one case of ten, so the lists of jaccard then check what fingerprints leave apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import Own, forest, map_batches, materialize, partitions, table, texts
from .components import components
from .jaccard import node_of

SEED = 42


def _cover() -> list[tuple[int, ...]]:
    """Turan's 20 triples of 8 positions: within a third, or two of a third and one of the next."""
    third = [0, 0, 0, 1, 1, 1, 2, 2]
    kinds = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [c for c in combinations(range(8), 3) if tuple(sorted(third[i] for i in c)) in kinds]


COVER = _cover()
#: The stage's fingerprints: differing bits at most, and members behind one in a list that it is compared with.
WIDE, WINDOW = 32, 1000


def fingerprint(text: bytes, words: int = 4) -> int:
    """Of the shingles of a text in UTF-8, a bit is 1 if it is set in over half their hashes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(g + 1 for g in gaps)]
    ends = [*gaps[words - 1 :], len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _keys(fp: Column) -> Column:
    byte = [F.shiftright(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    return F.array(*[sum(((byte[p] * (1 << 8 * j)) for j, p in enumerate(c)), F.lit(n << 24)) for n, c in enumerate(COVER)])


def _pairs(f: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes, and are then verified."""
    x = f[i] ^ f[j]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def _lists(group: np.ndarray, f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group, as a forest per call."""
    a, b = [], []
    size = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]))
    start = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(len(f)) - np.repeat(start, size)
    left = np.repeat(size, size) - place  # rows from here to the end of the run
    step, at = 1, np.flatnonzero(left > 1)
    while len(at):
        ok = at[_pairs(f, at, at + step, bits)]
        a.append(f[ok])
        b.append(f[ok + step])
        if sum(map(len, a)) > 500_000:
            x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            a, b = [x.view(np.uint64)], [y.view(np.uint64)]
        step += 1
        at = at[left[at] > step]
    none = np.zeros(0, np.int64)
    return forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)) if a else (none, none)


def links(fps: DataFrame, bits: int = 4, block: int = 1000) -> DataFrame:
    """fps: distinct non-null fp. Returns links a, b that join all fingerprints within `bits` bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the index finds pairs of 4 differing bits at most")
    n = partitions(fps.sparkSession)
    posted = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    long = posted.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(mine, o) * F.col("n") + F.greatest(mine, o))
    dealt = posted.join(long, "key", "left").select("key", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))
    dealt = dealt.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)

        def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1]:
                new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
                a, b = _lists(np.cumsum(new), np.ascontiguousarray(rows[2]).view(np.uint64), bits)
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "cell", "fp")])
            held = np.concatenate([held, rows], axis=1)
            last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            if held.shape[1] >= 20_000 and len(last):
                yield from give(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
        yield from give(held)

    return dealt.select("key", F.col("cell").cast("long").alias("cell"), "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with fingerprint (16 lowercase hex digits) and component_id."""
    own = Own(docs, ("fingerprint", "component_id", *drop))
    text, doc_id = own.name(text), own.name(doc_id)

    def run(batch: pa.RecordBatch) -> dict:
        return {"fp": np.array([fingerprint(t) for t in texts(batch, text)], np.uint64).view(np.int64)}

    columns = [f"c{i}" for i in own.kept]
    every = own.df.select(*dict.fromkeys([*columns, doc_id, text]))
    marked = materialize(map_batches(every, run, "fp long", () if text in columns else (text,)), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    text_of = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(classes, "fp").select(*own.back(), text_of, "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))


def vote(hashes: np.ndarray) -> np.ndarray:
    """128 bits as two longs, of distinct shingles' hashes: the hash and a mix of it. Ties are as in the least hash."""
    if not len(hashes):
        return np.zeros(2, np.int64)
    h = hashes.view(np.uint64)
    mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([h, mixed ^ (mixed >> np.uint64(31))], axis=1)
    total = np.zeros(128, np.int64)
    for at in range(0, len(both), 255):
        bits = np.unpackbits(both[at : at + 255].view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
        if not at:
            least = bits[0]
    out = np.where(2 * total == len(both), least, 2 * total > len(both))
    return np.packbits(out.astype(np.uint8), bitorder="little").view(np.int64)


def _wide_keys() -> Column:
    byte = [[F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)] for c in ("f0", "f1")]
    return F.array(*[b[i] * 256 + b[j] + F.lit(n << 16) for n, (b, i, j) in enumerate((b, i, j) for b in byte for i, j in combinations(range(8), 2))])


def _tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (key, node, f0, f1) in order of key: nodes of pairs of a list that differ in WIDE bits at most, as many as
    join the members, or some more."""
    new = np.r_[True, rows[0, 1:] != rows[0, :-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, rows.shape[1]])
    run = np.cumsum(new) - 1
    left = np.repeat(start + size, size) - np.arange(rows.shape[1])
    f = np.ascontiguousarray(rows[2:].T).view(np.uint64)
    root, a, b = np.arange(rows.shape[1]), [], []
    step, at = 1, np.flatnonzero(left > 1)
    while len(at) and step <= WINDOW:
        x = at[root[at] != root[at + step]]
        x = x[np.bitwise_count(f[x] ^ f[x + step]).sum(axis=1, dtype=np.int64) <= WIDE]
        if len(x):
            a.append(x)
            b.append(x + step)
            u, v = forest(root[x], root[x + step])
            to = np.arange(len(root))
            to[u] = v
            root = to[root]
        step += 1
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start) if step % 8 == 1 else None
        at = at[(left[at] > step) & (mixed[run[at]] if mixed is not None else True)]
    x, y = (rows[1, np.concatenate(p)] if p else rows[1, :0] for p in (a, b))
    return np.minimum(x, y), np.maximum(x, y)


def wide_pairs(fps: DataFrame) -> DataFrame:
    """fps: node, f0, f1. Candidates a, b by the positional byte index; a list's candidates join those of its members that
    stand within WINDOW and are joined by WIDE bits."""
    n = partitions(fps.sparkSession)
    posted = fps.dropDuplicates(["node"]).select("node", "f0", "f1", F.explode(_wide_keys()).alias("key"))
    posted = posted.select("key", "node", "f0", "f1").repartition(n, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in jaccard._runs(batches, ["key", "node", "f0", "f1"], 1):
            a, b = _tree(rows)
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

    return posted.mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """docs: text, doc_id. node, root of each distinct text, and the least doc_id that has it."""
    marked = docs.select("doc_id", "text", node_of(F.col("text")).alias("node"))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    roots = jaccard.links(marked.select("node", "text"), vote=vote, near=wide_pairs)
    return nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents joined by a similarity of 0.8 of their five-word shingles (see near_copies) the one with the
    least id stays, once; of rows that repeat an id, each text for itself. Rows without an id stay."""
    del spark, sf_dir
    own = Own(docs)
    text, doc_id = own.name("text"), own.name("doc_id")
    # Ids are compared as they are, whatever their type.
    known = near_copies(own.df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).filter("least_id is not null")
    kept = known.groupBy("root").agg(F.min(F.struct("least_id", "node")).alias("kept")).select(F.col("kept.least_id").alias(doc_id), F.col("kept.node").alias("node"))
    marked = own.df.withColumn("node", node_of(F.col(text)))
    stays = marked.join(kept, [doc_id, "node"], "left_semi").dropDuplicates([doc_id, "node"])
    return stays.select(*own.back()).unionByName(docs.filter(F.col("doc_id").isNull()))
