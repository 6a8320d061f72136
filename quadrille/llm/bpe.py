"""Byte-level BPE encoding and decoding by ranked merges over the byte arrays of distinct words.

Encoding. A text is cut into pieces by the tokenizer's pattern. A piece starts as the array of its
bytes; merges are folded over it: every step finds the adjacent pair of least rank (leftmost on ties),
puts the merged token in its place and looks up the ranks of the two pairs that arise, until no pair has
a rank. Only the distinct words of a block of texts are folded, all of one length side by side as rows of an
array. Decoding concatenates the ids' byte strings.

`Coder` is the same fold as Spark higher-order functions over a literal rank map (a map from a token's bytes
to its rank, dealt into hash buckets because a Spark map is searched entry by entry; in it a byte is a
latin-1 character). It gives the same ids, but costs too much for whole corpora (see the README), so
`encode` folds in Arrow batches.

Null text counts as empty; empty text has no ids. Rows are handled one by one: repeated rows and ids
give repeated results. Long texts are processed whole; a piece of n bytes takes at most n - 1 steps.
Further columns of the input are kept; those named n_tokens, ids, decoded, ids_sha256 and decoded_sha256 are
replaced by what a function returns.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import string
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Cut, blocks, gather
from .common import map_batches, table

#: Bytes of pieces that are folded side by side, and those of a piece that is folded by a heap, alone.
FOLDED, LONG = 400_000, 64
NONE = 2147483647  #: rank of a pair that doesn't merge
#: Unicode's White_Space, which \s means in the tokenizer's pattern but not in Java's.
SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S written out, within brackets too."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def latin(text: Column) -> Column:
    """The text's UTF-8 bytes, each as one latin-1 character."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def literal_map(entries: DataFrame, buckets: int, value_type: str) -> Column:
    """A literal array of `buckets` maps: entries' k (string) -> v lies in map pmod(xxhash64(k), buckets)."""
    at = F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")
    held = entries.groupBy(at).agg(F.collect_list(F.struct("k", "v")).alias("m"))
    every = entries.sparkSession.range(buckets).select(F.col("id").alias("b")).join(held, "b", "left")
    in_order = F.array_sort(F.collect_list(F.struct("b", "m")))
    maps = F.transform(in_order, lambda x: F.map_from_entries(F.coalesce(x["m"], F.array().cast(f"array<struct<k:string,v:{value_type}>>"))))
    text = every.agg(F.to_json(maps)).head()[0]
    return F.from_json(F.lit(text), f"array<map<string,{value_type}>>")


def find(literal: Column, buckets: int, key: Column) -> Column:
    return F.try_element_at(F.get(literal, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), key)


class Coder:
    """Columns that encode with one set of ranks."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, buckets: int = 16384):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"ranks lack the bytes {missing[:5]}")
        import pandas as pd  # workers don't need it

        self.spark, self.ranks, self.pattern, self.buckets = spark, ranks, java_pattern(pattern), buckets
        rows = pd.DataFrame({"k": [t.decode("latin-1") for t in ranks], "v": list(ranks.values())})
        self.map = literal_map(spark.createDataFrame(rows, "k string, v int"), buckets, "int")

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def rank(self, token: Column) -> Column:
        return F.coalesce(find(self.map, self.buckets, token), F.lit(NONE))

    def fold(self, piece: Column) -> Column:
        """The piece's ids; the piece as latin() gives it."""
        none = F.array().cast("array<int>")

        def merge(state, _):
            parts, ranks = state["parts"], state["ranks"]

            def put(at):
                p, new, n = at["p"], at["new"], F.size(parts)
                left = F.when(p > 1, F.array(self.rank(F.concat(F.get(parts, p - 2), new)))).otherwise(none)
                right = F.when(p + 1 < n, F.array(self.rank(F.concat(new, F.get(parts, p + 1))))).otherwise(none)
                before = F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0)))
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), p - 1), F.array(new), F.slice(parts, p + 2, n)).alias("parts"),
                    F.concat(before, left, right, F.slice(ranks, p + 2, n)).alias("ranks"),
                )

            p = F.array_position(ranks, F.array_min(ranks)).cast("int")
            at = F.transform(F.array(p), lambda p: F.struct(p.alias("p"), F.concat(F.get(parts, p - 1), F.get(parts, p)).alias("new")))
            ended = F.coalesce(F.array_min(ranks), F.lit(NONE)) == NONE
            return F.when(ended, state).otherwise(F.get(F.transform(at, put), 0))

        chars = F.split(piece, "")
        first = F.zip_with(F.slice(chars, 1, F.length(piece) - 1), F.slice(chars, 2, F.length(piece)), lambda a, b: self.rank(F.concat(a, b)))
        folded = F.aggregate(
            F.sequence(F.lit(2), F.length(piece)), F.struct(chars.alias("parts"), first.alias("ranks")), merge, lambda s: F.transform(s["parts"], self.rank)
        )
        whole = self.rank(piece)
        return F.when(F.length(piece) == 0, none).when(whole != NONE, F.array(whole)).otherwise(folded)


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > LONG:
        return _fold_long(piece, ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        p = pair.index(least)
        new = parts[p] + parts[p + 1]
        parts[p : p + 2] = [new]
        del pair[p]
        if p:
            pair[p - 1] = get(parts[p - 1] + new, NONE)
        if p < len(pair):
            pair[p] = get(new + parts[p + 1], NONE)
    return [ranks[x] for x in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps: a heap of (rank, place), whose stale entries are passed over."""
    n = len(piece)
    part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [ranks.get(piece[i : i + 2], NONE) for i in range(n - 1)] + [NONE]
    heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if part[i] is None or rank[i] != r:
            continue
        j = after[i]
        part[i], part[j] = part[i] + part[j], None
        after[i] = k = after[j]
        rank[j] = NONE
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0:
                rank[x] = ranks.get(part[x] + part[y], NONE) if y < n else NONE
                if rank[x] != NONE:
                    heapq.heappush(heap, (rank[x], x))
    return [ranks[x] for x in part if x is not None]


class Merges:
    """The merges of a set of ranks as a hash table over pairs of ids, for folding many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        made = np.array(pairs, np.int64).reshape(-1, 3)
        keys, rank = made[:, 0] << 32 | made[:, 1], made[:, 2]
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        self.probes, left, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            # Of keys that want one slot the last written stays.
            self.keys[at[left[free]]] = keys[left[free]]
            done = free & (self.keys[at[left]] == keys[left])
            self.values[at[left[done]]] = rank[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of a's and b's tokens joined, NONE without one or where either is NONE."""
        keys = a << 32 | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (self.keys[at[left]] != -1)]
        return out

    def fold(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of one length, a row of bytes each: an array of ids, and how many are a row's."""
        rows, width = data.shape
        ids, count = self.bytes[data], np.full(rows, width)
        ids = np.c_[ids, np.full(rows, NONE)]
        pair = np.full((rows, width + 1), NONE, np.int64)
        for k in range(width - 1):
            pair[:, k] = self.rank(ids[:, k], ids[:, k + 1])
        out, place, now = np.full((rows, width), NONE, np.int64), np.arange(rows), np.arange(width + 1)
        while len(place):
            at = pair.argmin(1)
            row = np.arange(len(place))
            least = pair[row, at]
            ended = least == NONE
            if ended.any():
                out[place[ended]] = ids[ended, :width]
                go = ~ended
                ids, pair, place, at, least = ids[go], pair[go], place[go], at[go], least[go]
                row = np.arange(len(place))
                if not len(place):
                    break
            count[place] -= 1
            # The id right of the pair goes, and its pair with it.
            moved = np.minimum(now + (now > at[:, None]), width)
            ids = np.take_along_axis(ids, moved, 1)
            pair = np.take_along_axis(pair, np.minimum(now + (now >= at[:, None]), width), 1)
            ids[row, at] = least
            pair[row, at] = self.rank(least, ids[row, at + 1])
            left = np.flatnonzero(at > 0)
            pair[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], least[left])
        return out, count

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and how many each has."""
        get = self.ranks.get
        whole = np.array([get(p, -1) for p in pieces], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        count = np.ones(len(pieces), np.int64)
        parts, of = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        for n in np.unique(size[whole < 0]).tolist():
            every = np.flatnonzero((whole < 0) & (size == n))
            for k in range(0, len(every), max(1, FOLDED // n)):
                chosen = every[k : k + max(1, FOLDED // n)]
                if n > LONG:
                    made = [fold(pieces[i], self.ranks) for i in chosen]
                    count[chosen] = [len(m) for m in made]
                    parts.append(np.array([i for m in made for i in m], np.int64))
                else:
                    ids, count[chosen] = self.fold(np.frombuffer(b"".join([pieces[i] for i in chosen]), np.uint8).reshape(-1, n))
                    parts.append(ids[ids != NONE])
                of.append(chosen)
        # The parts lie in the order of `of`; put them in the pieces' order.
        of_all, flat = np.concatenate(of), np.concatenate(parts)
        held = count[of_all]
        start = np.zeros(len(pieces), np.int64)
        start[of_all] = np.cumsum(held) - held
        total = np.r_[0, np.cumsum(count)]
        return flat[np.repeat(start - total[:-1], count) + np.arange(total[-1])], count


class Words:
    """Ids of texts, a block at a time. Texts are cut at single spaces and line ends between other characters, where
    the pattern always ends a piece (a space begins the next, a line end is a piece of its own); each distinct word
    of a block is cut by the pattern, and each distinct piece is folded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.merges = regex.compile(pattern), Merges(ranks)
        self.spaced = pattern == public_tokenizers.PATTERN

    def _cut(self, word: str, space: str) -> list[str]:
        """The pattern's pieces of a word that has `space` before it."""
        stem = word.rstrip(string.punctuation)
        if stem.isalpha():
            # Letters, then a run of punctuation.
            return [space + stem, word[len(stem) :]] if len(stem) < len(word) else [space + word]
        return [m.group() for m in self.pattern.finditer(space + word)]

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Of each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        pieces: dict[str, int] = {"": 0}
        number = pieces.setdefault
        if self.spaced:
            cut = Cut(texts)
            # A text with white space next to other white space, or at an end, is cut as a whole.
            words = cut.words.to_pylist()
            odd_word = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
            odd = np.maximum.reduceat(odd_word[cut.at], cut.first[:-1]) if len(texts) else np.zeros(0, bool)
            plain = np.repeat(~odd, np.diff(cut.first))
            # Each word with the space before it, if any, is a word of its own.
            coded = cut.at * 2 + (cut.before == 32)
            used = np.zeros(2 * len(words), bool)
            used[coded[plain]] = True
            used = np.flatnonzero(used)
            numbers = [[number(p, len(pieces)) for p in self._cut(words[u >> 1], " " * (u & 1))] for u in used.tolist()]
            end = number("\n", len(pieces))
            of_word = np.zeros(2 * len(words), np.int64)
            of_word[used] = np.arange(len(used))
        else:
            odd = np.ones(len(texts), bool)
        whole = {int(k): [number(m.group(), len(pieces)) for m in self.pattern.finditer(texts[int(k)].as_py() or "")] for k in np.flatnonzero(odd)}
        ids, count = self.merges.pieces([p.encode() for p in list(pieces)[1:]])
        ids, length = ids.astype("<u4"), np.r_[0, count]
        start = np.cumsum(length) - length
        out = [memoryview(ids[np.concatenate([np.arange(start[p], start[p] + length[p]) for p in whole[k]])].tobytes() if whole.get(k) else b"") for k in range(len(texts))] if odd.any() else []
        if odd.all():
            return out
        # Ids of each word, of which the first place is a line end's or none's.
        n = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, int(n.sum()))
        each = np.add.reduceat(length[flat], np.cumsum(n) - n)
        own = ids[np.repeat(start[flat] - (np.cumsum(length[flat]) - length[flat]), length[flat]) + np.arange(length[flat].sum())]
        table = np.r_[own, ids[start[end] : start[end] + length[end]]]
        begin, size = np.r_[np.cumsum(each) - each, len(own), 0], np.r_[each, length[end], 0]
        seq = np.stack([np.where(cut.before == 10, len(each), len(each) + 1), of_word[coded]], 1)
        seq[~plain] = len(each) + 1
        made = gather(table, begin, size, seq.ravel(), 2 * np.diff(cut.first))
        return [out[k] if odd[k] else m for k, m in enumerate(made)] if out else made


class Decoder:
    """Byte strings of ids. Ids without a token are an error."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.pieces[r] = t

    def decode(self, ids: bytes | memoryview | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids or b"").cast("I")))


_WORKERS: dict[str, Words] = {}


def _worker(key: str, ranks: dict[bytes, int], pattern: str) -> Words:
    return _WORKERS.get(key) or _WORKERS.setdefault(key, Words(ranks, pattern))


def _key(ranks: dict[bytes, int], pattern: str) -> str:
    return hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_tokens and ids (binary, little-endian unsigned 32-bit integers)."""
    key = _key(ranks, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text))
        ids = [bytes(x) for i, j in blocks(batch, text) for x in _worker(key, ranks, pattern).encode(column.slice(i, j - i))]
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_batches(docs, run, "n_tokens long, ids binary", drop)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with decoded (binary). Ids without a token are an error; null ids count as none."""
    decoder = Decoder(ranks)

    def run(batch: pa.RecordBatch) -> dict:
        return {"decoded": [decoder.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

    return map_batches(df, run, "decoded binary", drop)


def coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, text: str = "text", keep_ids: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_tokens, ids (unless keep_ids is false), ids_sha256 and decoded_sha256, encoded and decoded in one pass."""
    key = _key(ranks, pattern)
    decoder = Decoder(ranks)

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text))
        out: dict[str, list] = {"n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for i, j in blocks(batch, text):
            for x in _worker(key, ranks, pattern).encode(column.slice(i, j - i)):
                out["n_tokens"].append(len(x) // 4)
                if keep_ids:
                    out["ids"].append(bytes(x))
                out["ids_sha256"].append(hashlib.sha256(x).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoder.decode(x)).hexdigest())
        return out

    ids = "ids binary, " if keep_ids else ""
    return map_batches(docs, run, f"n_tokens long, {ids}ids_sha256 string, decoded_sha256 string", drop)


RANKS = "byte_bpe_multi_50k.tiktoken"


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded(docs, load_ranks(public_tokenizers.path(RANKS)), keep_ids=False, drop=("text",))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document that the mix emits, as ids, with digests of ids and decoded bytes."""
    del spark, sf_dir
    return coded(docs, load_ranks(public_tokenizers.path(RANKS)), drop=("text",))
