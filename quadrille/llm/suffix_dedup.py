"""Repeated passages by sparse suffix arrays.

Words are runs of anything but ASCII white space, compared byte by byte. A passage repeats where `passage`
words in a row also stand elsewhere: in another document or further on in the same one.

Suffixes are retained only at minimisers: a word position whose 5-word hash is least in some stretch of
`span` positions. A repeated passage holds, at the same place in each copy, a retained suffix that begins
within its first `span` words, so the copies share at least passage - span + 1 words from there on. Retained
suffixes are sorted by that many words (by their hash, which keeps equal beginnings together), and those
with an equal neighbour are candidates. A candidate is extended to the left, up to the candidate before
it or span - 1 words, and to the right to the full length: each position thus reached stands for the passage
that begins there, and passages are sorted and compared in turn. All passages that repeat are found, and the
hashes (64 bits) decide which are equal.

Equal texts (by a 128-bit hash) are searched once.

Of equal passages the first is kept, that of the least doc_id and there the first; the words of later ones are
removed. Counting is pre-aggregated and joins are left to Spark to split, so a passage that
a third of all documents share isn't gathered anywhere. Positions are gathered per document.

Null text counts as empty. Documents of less than `passage` words have no passage. Rows that repeat a doc_id
and text are one document; where one id stands on several texts each of them is a document, and of equal passages these
documents' are kept last (or, where no higher numbers are free, first). Rows without an id take no part. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Own, discard, map_batches, materialize, table, texts

PASSAGE, GRAM, SPAN = 50, 5, 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.uint64(0x100000001B3)
#: Bytes whose words are hashed, or documents compared, at once.
_PART = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes."""
    space = np.r_[True, _SPACE[joined], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: two polynomials over 2^64, mixed."""
    if len(data) > _PART and len(start) > 1:
        # In parts that end between words, so that long texts need no more memory.
        cut = np.unique(np.searchsorted(start, np.arange(0, len(data), _PART)))
        cut = np.unique(np.r_[0, cut, len(start)])
        made = [word_hashes(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a]) for a, b in zip(cut[:-1], cut[1:]) if b - a < len(start)]
        if made:
            return np.concatenate(made)
    out = np.zeros(len(start), np.uint64)
    for base in (_BYTE, _BASE):
        powers = _powers(base, len(data) + 1)
        total = np.r_[np.uint64(0), np.cumsum(_mixed(data.astype(np.uint64) + base) * powers[: len(data)], dtype=np.uint64)]
        back = _powers(_inverse(base), len(data) + 1)
        out = _mixed(out ^ ((total[end] - total[start]) * back[start]))
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; shorter than h by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)]
    return _mixed((total[n:] - total[:-n]) * _powers(_inverse(_BASE), len(h) + 1)[: len(h) - n + 1])


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each n in a row."""
    width, out = 1, x
    while 2 * width <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(x) - n + 1], out[n - width : len(x) - width + 1]) if width < n else out


def retained(grams: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Positions whose gram is least in some `span` in a row that belong to one document."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least = _slide(grams, span, np.minimum)
    whole = owner[: len(least)] == owner[span - 1 :]
    least = np.where(whole, least, 0)
    most = _slide(np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)], span, np.maximum)
    return np.flatnonzero((grams <= most) & (most > 0))


def parts(batches, read):
    """The batches' rows in slices of some _PART bytes of text, and their texts by read(batch)."""
    for b in batches:
        if b.num_rows:
            rows = read(b)
            sizes = np.cumsum([len(t) for t in rows])
            cut = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(_PART, sizes[-1], _PART)) + 1, b.num_rows])
            yield from ((b.slice(i, j - i), rows[i:j]) for i, j in zip(cut[:-1], cut[1:]))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as zstandard frames, for the one join that moves them."""
    return map_batches(docs, lambda b: {"packed": [zstandard.compress(t, 1) for t in texts(b, "text")]}, "packed binary", ("text",))


def _unpacked(b: pa.RecordBatch) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(x) for x in b.column(b.schema.get_field_index("packed")).to_pylist()]


class Words:
    """Words of a batch of documents end to end: hash and document of each, and where each document begins."""

    def __init__(self, rows: list[bytes]):
        data = np.frombuffer(b" ".join(rows), np.uint8)
        begins = np.r_[0, np.cumsum([len(r) + 1 for r in rows])].astype(np.int64)
        self.start, self.end = words_of(data)
        self.hash = word_hashes(data, self.start, self.end)
        self.owner = np.searchsorted(begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(rows) + 1))

    def suffixes(self, passage: int, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Retained positions and the hash of their beginning, of passage - span + 1 words."""
        grams = runs(self.hash, gram)
        own = self.owner[: len(grams)]
        grams = np.where(own == self.owner[gram - 1 :], grams, np.uint64(0xFFFFFFFFFFFFFFFF)) if len(grams) else grams
        # A span of grams counts if it lies within one document, grams and all.
        last = np.minimum(np.arange(len(grams)) + gram - 1, len(self.owner) - 1)
        inside = np.where(self.owner[last] == own, own, -1 - np.arange(len(own))) if len(own) else own
        at = retained(grams, inside, span)
        keys = runs(self.hash, n := passage - span + 1)
        at = at[at < len(keys)]
        at = at[self.owner[at] == self.owner[at + n - 1]]
        return at, keys[at]


def _anchors(docs: DataFrame, passage: int, gram: int, span: int) -> DataFrame:
    def run(batches):
        for b, rows in parts(batches, texts):
            words = Words(rows)
            at, keys = words.suffixes(passage, gram, span)
            ids = b.column(b.schema.get_field_index("doc_id")).to_numpy()
            doc, n = words.owner[at], len(rows)
            digests = [xxhash.xxh3_128_digest(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[keys.view(np.int64), np.zeros(n, np.int64)]),
                    pa.array(np.r_[ids[doc], ids]),
                    pa.array(np.r_[at - words.first[doc], np.diff(words.first)].astype(np.int32)),
                    pa.array([None] * len(at) + digests, pa.binary()),
                ],
                names=["key", "doc_id", "at", "digest"],
            )

    return docs.mapInArrow(run, "key long, doc_id long, at int, digest binary")


def _with_neighbour(anchors: DataFrame) -> DataFrame:
    """doc_id, at of the suffixes that begin as one of their neighbours in sorted order. The order is total, so a
    hot beginning spreads over partitions; a partition's first and last are let through."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy() for i in range(3)])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            same = rows[0, 1:] == rows[0, :-1]
            use = np.r_[held is None or flag, same] | np.r_[same, False]
            yield pack(rows[:, :-1], use[:-1])
            held, flag = rows[:, -1:], bool(len(same) and same[-1]) or (rows.shape[1] == 1 and bool(use[0]))
        if held is not None:
            yield pack(held, np.array([True]))

    def pack(rows, use):
        return pa.RecordBatch.from_arrays([pa.array(rows[1][use]), pa.array(rows[2][use].astype(np.int32))], names=["doc_id", "at"])

    order = ["key", "doc_id", "at"]
    sorted_ = anchors.filter("digest is null").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("key", "doc_id", F.col("at").cast("long")).mapInArrow(run, "doc_id long, at int")


def _passages(docs: DataFrame, passage: int, gram: int, span: int) -> DataFrame:
    """docs: doc_id, packed, at (the document's candidates). Gives hash, doc_id, start for each passage that a
    candidate reaches. `again`: it stands earlier in the document; `twice`: it does so later."""

    def run(batches):
        for b, rows in parts(batches, _unpacked):
            words = Words(rows)
            at, _ = words.suffixes(passage, gram, span)
            doc = words.owner[at]
            wanted = b.column(b.schema.get_field_index("at"))
            of = np.repeat(np.arange(len(rows)), np.diff(wanted.offsets.to_numpy()))
            chosen = np.unique(words.first[of] + wanted.flatten().to_numpy())
            # From behind the candidate before, and at most span - 1 to the left.
            use = np.isin(at, chosen)
            at, doc = at[use], doc[use]
            before = np.where(np.r_[True, doc[1:] != doc[:-1]], words.first[doc] - 1, np.r_[-1, at[:-1]]) if len(at) else at
            low, high = np.maximum(before + 1, at - span + 1), at
            counts = high - low + 1
            start = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)
            hashes = runs(words.hash, passage)
            start = start[start < len(hashes)]
            start = start[words.owner[start] == words.owner[start + passage - 1]]
            owner, found = words.owner[start], hashes[start]
            order = np.lexsort((start, found, owner))
            again = np.r_[False, (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1])] if len(order) else np.zeros(0, bool)
            ids = b.column(b.schema.get_field_index("doc_id")).to_numpy()
            start, owner, found = start[order], owner[order], found[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(ids[owner]), pa.array((start - words.first[owner]).astype(np.int32)), pa.array(again), pa.array(np.r_[again[1:], False][: len(again)])],
                names=["hash", "doc_id", "start", "again", "twice"],
            )

    return docs.mapInArrow(run, "hash long, doc_id long, start int, again boolean, twice boolean")


def _named(docs: DataFrame, text: Column, doc_id: Column) -> tuple[DataFrame, DataFrame | None]:
    """docs with `doc`, a number of each id and text: the id itself or, where an id stands on several texts, a number of
    its own for each of them; null without an id. And, if there are such ids, doc and doc_id of their texts."""
    keyed = docs.withColumns({"doc": doc_id.cast("long"), "digest": F.xxhash64(F.coalesce(text, F.lit("")))})
    seen = keyed.filter("doc is not null").select("doc", "digest")
    span = seen.agg(F.min("doc"), F.max("doc")).head()
    several = seen.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc")
    several = materialize(several, "several")
    if several.isEmpty():
        return keyed.drop("digest"), None
    texts_of = seen.join(several, "doc", "left_semi").distinct().repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest")
    # In order of id and text; behind all ids, or before them where there is no room.
    numbered = materialize(texts_of.withColumn("n", F.monotonically_increasing_id()), "numbered")
    most = numbered.agg(F.max("n")).head()[0] + 1
    base = span[1] + 1 if span[1] + most < 1 << 63 else span[0] - most
    if base < -(1 << 63):
        raise ValueError("ids fill the range of long, and some stand on several texts")
    numbered = numbered.select("doc", "digest", (F.col("n") + F.lit(base)).alias("own"))
    named = keyed.join(numbered, ["doc", "digest"], "left").withColumn("doc", F.coalesce("own", "doc")).drop("digest", "own")
    return named, numbered.select(F.col("own").alias("doc"), F.col("doc").alias("doc_id"))


_SPAN_TYPE = "array<struct<start:int,end:int>>"


def _merged(starts: np.ndarray, passage: int) -> list[dict]:
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > passage)
    return [{"start": int(a), "end": int(b) + passage} for a, b in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]])]


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", passage: int = PASSAGE, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """One row for each document that holds a repeated passage: doc_id, repeated (spans of words, from start
    until before end), removed (the spans of later copies), n_repeated, n_removed,
    first_doc_ids (the documents where its passages stand first, and the first
    of its equals)."""
    named, several = _named(docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id")), F.col("text"), F.col("id"))
    found = _repeated(named.select(F.col("doc").alias("doc_id"), "text"), passage, gram, span)
    if several is None:
        return found
    found = materialize(found, "found")
    names = several.withColumnRenamed("doc", "number").withColumnRenamed("doc_id", "name")
    firsts = found.select("doc_id", F.explode("first_doc_ids").alias("number")).join(names, "number", "left")
    firsts = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.coalesce("name", "number"))).alias("firsts"))
    out = found.join(firsts, "doc_id", "left").join(names, found.doc_id == names.number, "left")
    return out.select(F.coalesce("name", "doc_id").alias("doc_id"), "repeated", "removed", "n_repeated", "n_removed", F.coalesce("firsts", "first_doc_ids").alias("first_doc_ids"))


def _repeated(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """repeated_passages() of docs: doc_id long, which no two texts share, and text."""
    if not 0 < gram <= passage - span + 1:
        raise ValueError("passage is too short for gram and span")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    anchors = materialize(_anchors(own, passage, gram, span), "suffixes")
    # Of equal texts only the first is searched; later ones are copies from end to end.
    info = anchors.filter("digest is not null").select("doc_id", "digest", F.col("at").alias("n_words")).distinct()
    equal = info.groupBy("digest").agg(F.min("doc_id").alias("like"), F.count("*").alias("n")).filter("n > 1").select("digest", "like")
    members = materialize(info.filter(F.col("n_words") >= passage).join(equal, "digest").select("doc_id", "like", "n_words"), "copies")
    chosen = _with_neighbour(anchors).groupBy("doc_id").agg(F.collect_set("at").alias("at"))
    chosen = chosen.join(members.filter("doc_id <> like"), "doc_id", "left_anti")
    passages = materialize(_passages(_packed(own).join(chosen, "doc_id"), passage, gram, span), "passages")
    discard(anchors)
    # A passage repeats if it is in two documents or twice in one. Later places in a document are decided.
    each = passages.filter("not again")
    firsts = each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("twice").alias("two"))
    firsts = firsts.filter("first <> last or two").select("hash", "first")
    placed = each.join(firsts, "hash").select("doc_id", "start", "first", (F.col("doc_id") != F.col("first")).alias("later"))
    placed = placed.unionByName(passages.filter("again").select("doc_id", "start", F.lit(None).cast("long").alias("first"), F.lit(True).alias("later")))
    gathered = placed.groupBy("doc_id").agg(
        F.collect_list("start").alias("_all"), F.collect_list(F.when(F.col("later"), F.col("start"))).alias("_later"), F.collect_set("first").alias("first_doc_ids")
    )

    def spans(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"repeated": [], "removed": [], "n_repeated": [], "n_removed": []}
        for name, to in (("_all", "repeated"), ("_later", "removed")):
            for starts in batch.column(batch.schema.get_field_index(name)):
                found = _merged(starts.values.to_numpy(), passage)
                out[to].append(found)
                out[f"n_{to}"].append(sum(s["end"] - s["start"] for s in found))
        return out

    found = map_batches(gathered, spans, f"repeated {_SPAN_TYPE}, removed {_SPAN_TYPE}, n_repeated long, n_removed long", ("_all", "_later"))
    found = materialize(found.select("doc_id", "repeated", "removed", "n_repeated", "n_removed", "first_doc_ids"), "spans")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    first = F.array_union(F.coalesce("first_doc_ids", F.array().cast("array<long>")), F.array("like"))
    n = F.col("n_words").cast("long")
    later = (
        members.filter("doc_id <> like").join(found.select(F.col("doc_id").alias("like"), "first_doc_ids"), "like", "left")
        .select("doc_id", whole.alias("repeated"), whole.alias("removed"), n.alias("n_repeated"), n.alias("n_removed"), first.alias("first_doc_ids"))
    )
    heads = (
        found.join(members.filter("doc_id = like"), "doc_id", "full")
        .select(
            "doc_id", F.when(n.isNull(), F.col("repeated")).otherwise(whole).alias("repeated"), F.coalesce("removed", F.array().cast(_SPAN_TYPE)).alias("removed"),
            F.coalesce(n, "n_repeated").alias("n_repeated"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
            F.when(n.isNull(), F.col("first_doc_ids")).otherwise(first).alias("first_doc_ids"),
        )
    )
    return heads.unionByName(later).withColumn("first_doc_ids", F.array_sort("first_doc_ids"))


def cut_words(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; each word goes with the white space behind it."""
    data = text.encode()
    start, _ = words_of(np.frombuffer(data, np.uint8))
    border = np.r_[start, len(data)]
    out, at = [], 0
    for s in spans:
        out.append(data[at : border[s["start"]]])
        at = int(border[min(s["end"], len(start))])
    return b"".join([*out, data[at:]]).decode()


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut from the texts and n_chars follows. Documents of which
    nothing is left are dropped."""
    del spark, sf_dir
    own = Own(docs)
    text = own.name("text")
    named, _ = _named(own.df, F.col(text), F.col(own.name("doc_id")))
    cuts = _repeated(named.select(F.col("doc").alias("doc_id"), F.col(text).alias("text"))).filter("n_removed > 0")
    cuts = materialize(cuts.select(F.col("doc_id").alias("doc"), "removed"), "removed")
    joined = named.join(cuts, "doc", "left").drop("doc")

    def cut(batch: pa.RecordBatch) -> dict:
        rows = zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("removed")).to_pylist())
        return {text: [cut_words(t, s) if s and t else t for t, s in rows]}

    out = map_batches(joined, cut, f"{text} string")
    gone = F.col("removed").isNotNull() & (F.trim(F.regexp_replace(text, r"[\x09-\x0D]", " ")) == "")
    out = out.filter(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in (n.lower() for n in own.names):
        n = own.name("n_chars")
        out = out.withColumn(n, F.when(F.col("removed").isNull(), F.col(n)).otherwise(F.length(text)).cast(own.df.schema[n].dataType))
    return out.select(*own.back())
