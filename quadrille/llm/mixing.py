"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Sizes are words. The mix shares `share` times all sizes among the sources by weight; a target stops at `most`
times its source's size and the excess is shared again by weight among the others until none is above. Since
each source then gets min(most * size, level * weight), the level is found in one pass over the sources in
order of most * size / weight.

Within a source each document's expected copies are target / source size. Their prefix sum, plus one offset per
source, crosses whole numbers; a document is emitted once for each that it crosses, so at most
ceil(expected) times. Documents are summed in order of size class and hash, so that every size class is
sampled evenly. The prefix sum is dealt out: counts of (source, size class, hash bucket) are summed first,
and only ranks within a bucket are counted row by row, so a hot source spans many tasks.

A null text has size 0, a null source is a source of its own, last in order. A source of size 0 has target 0
and takes nothing. Repeated rows are documents of their own. An empty table gives an empty mix. Nothing is
random: reruns agree. Further columns are kept; those named size, source_size, target, copies and taken are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Own, materialize, table

#: Hash buckets that each size class of a source is dealt into, at least; tables of more than BUCKETS x BUCKET_ROWS rows get
#: more, so that a bucket doesn't grow with the table.
BUCKETS, BUCKET_ROWS = 64, 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: none (a null source), src, source_size. Adds target. Sources get the weights in order of code point, null
    last. The table has a row per source, and its windows are a single task's."""
    order = Window.orderBy("none", "src")
    repeat = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("w", F.get(repeat, (F.row_number().over(order) - 1) % len(weights)))
    rising = Window.orderBy(F.col("source_size") * most / F.col("w"), "none", "src")
    before, all_ = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # The first source in rising order that its level leaves below its bound sets the level.
    free = F.when(level * F.col("w") <= F.col("source_size") * most, F.struct(F.row_number().over(rising).alias("at"), level.alias("level")))
    leveled = weighed.withColumn("free", free).withColumn("level", F.min("free").over(all_)["level"])
    whole = F.col("source_size") * most
    return leveled.select("none", "src", "source_size", F.least(whole, F.coalesce(F.col("level") * F.col("w"), whole)).cast("double").alias("target"))


def row_hash(own: Own) -> Column:
    """A hash of all the row's columns, in order of their names; those that hold maps by their JSON."""
    kinds = {f.name: f.dataType for f in own.df.schema}
    order = sorted(range(len(own.names)), key=lambda i: (own.names[i], i))
    return F.xxhash64(*[F.to_json(F.struct(f"c{i}")) if "map<" in kinds[f"c{i}"].simpleString() else F.col(f"c{i}") for i in order])


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mixed(own: Own, text: str, source: str, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The table's own columns that are kept, size, source_size, target and copies."""
    # Texts are read once here, unless they are kept: then they move once, to their cells.
    size = words(F.col(text))
    rows = own.df.select(*[f"c{i}" for i in own.kept], F.coalesce(source, F.lit("")).alias("src"), F.col(source).isNull().alias("none"), size.alias("size"), row_hash(own).alias("hash"))
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    if int(text[1:]) not in own.kept:
        rows = materialize(rows, "sizes")
    buckets = max(BUCKETS, 1 << (max(1, rows.count()) // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    cells = rows.groupBy("none", "src", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    # A row for each source and size class, its buckets in an array.
    classes = cells.groupBy("none", "src", "class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    classes = materialize(classes, "classes")
    goals = targets(classes.groupBy("none", "src").agg(F.sum("s").alias("source_size")), weights, share, most)
    up = Window.partitionBy("none", "src").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    begun = classes.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).join(goals, ["none", "src"])
    # A bucket begins behind the classes before its own and the buckets before it.
    each = F.transform("cells", lambda c, k: F.struct(c["bucket"].alias("bucket"), (F.col("before") + F.aggregate(F.slice("cells", F.lit(1), k), F.lit(0).cast("long"), lambda t, x: t + x["n"])).alias("before")))
    starts = begun.select("none", "src", "class", "source_size", "target", F.inline(each))
    cell = ["none", "src", "class", "bucket"]
    within = Window.partitionBy(*cell).orderBy("size", "hash")
    # The window and the join deal rows by the same columns, so rows move once.
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(starts, cell)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("src", F.lit("offset")), F.lit(1 << 20)) / float(1 << 20)
    at = F.col("before") + F.col("rank")
    copies = F.least(F.floor(expected * at + offset) - F.floor(expected * (at - 1) + offset), F.ceil(expected)).cast("long")
    return ranked.select(*[f"c{i}" for i in own.kept], "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix emits the document) and taken."""
    own = Own(docs, ("size", "source_size", "target", "copies", "taken", *drop))
    found = _mixed(own, own.name(text), own.name(source), weights, share, most)
    return found.select(*own.back(), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), drop=("text",)).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of documents."""
    del spark, sf_dir
    own = Own(docs)
    mixed = _mixed(own, own.name("text"), own.name("source")).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*own.back())
