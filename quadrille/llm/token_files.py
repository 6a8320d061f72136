"""Token ids as binary files of independent zstandard frames with a trailing seek table.

A file holds documents in order of id. Frames are cut at document borders once they reach `frame_bytes`, and
each is compressed on its own, so a reader decompresses only the frames of the documents it wants. The trailer
is a skippable frame in zstandard's seekable format (compressed size, decompressed size and checksum of
each frame, here the low 32 bits of XXH64 of the decompressed bytes), preceded by another skippable frame
that lists the documents of each frame: id, n_tokens. Any zstandard reader can read the file.

Files are written by tasks into a folder that all executors share, to a name of their own, and then moved to
their final name, so a task that is run again does no harm. Document ids are dealt by range, so files in
order of number are in order of id. Null text counts as empty (the end id alone). Null ids come first (their
frame's number is written as its complement). Rows that repeat an id are written in order of their text. Empty
tables give no file. Columns other than the text and id don't matter.

Special tokens' strings in a text become the special tokens' ids, as the library does unless it is told otherwise.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Cut, blocks, gather
from .common import BATCH_ROWS, new_path, table, together

SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
DOCS = 0x184D2A50
#: Bytes of text that are coded at once.
BLOCK = 8_000_000
#: Characters that the normaliser composes, or doesn't lower-case into one letter.
UNSAFE = "[\u0130\u0300-\U0010ffff]"


#: What the cuts of Words rely on; a tokenizer of any other make is given whole texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers' letter for each byte: printable ones are themselves, others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


class Words:
    """Ids by the tokenizers library, a block of texts at a time.

    Texts are cut at ASCII spaces and line ends, which end every word of this tokenizer and no special token holds.
    A distinct word of letters, and ASCII punctuation behind them, is lower-cased and cut between the two, as the tokenizer
    does, if it has only characters below U+0300 other than U+0130: these the tokenizer's normaliser lower-cases one by
    one into letters and doesn't compose. Its letters go to the library's model many words at once, and each word ends
    with an id that ends words. All other words (among them those that hold `<|`) go through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        self.cuts = (
            (made["normalizer"] or {}).get("normalizers") == NORMALIZER
            and [p["type"] for p in cut.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and cut["pretokenizers"][0] | {"pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True} == cut["pretokenizers"][0]
            and cut["pretokenizers"][1] | {"add_prefix_space": False, "use_regex": False} == cut["pretokenizers"][1]
            and (model["type"], model["end_of_word_suffix"], model["dropout"], model["byte_fallback"]) == ("BPE", "</w>", None, False)
            and all("<|" in t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in made["added_tokens"])
        )
        if self.cuts:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            self.letters = _byte_letters() | {32: " "}
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters, end to end, and how many each has; one of the words may be empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        none = stems.index("") if "" in stems else len(stems)
        every = stems[:none] + stems[none + 1 :]
        for k in range(0, len(every), 500):
            part = every[k : k + 500]
            text = " ".join(part)
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            got = np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) != len(part) or len(got) - 1 != last[-1]:
                raise ValueError("the model doesn't end each word with an id that ends words")
            ids.append(got)
            counts.append(np.diff(np.r_[-1, last]))
        count = np.concatenate(counts)
        return np.concatenate(ids), np.insert(count, none, 0) if none < len(stems) else count

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """Of each text (null: empty) its ids as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            every = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return [memoryview(np.array(e.ids, "<u4").tobytes()) for e in every]
        cut = Cut(texts)
        # A word's two pieces: a stem, or none, and what goes through the whole tokenizer, or none.
        stem = pc.utf8_rtrim(cut.words, string.punctuation)
        ok = pc.and_(pc.utf8_is_alpha(stem), pc.invert(pc.match_substring_regex(cut.words, UNSAFE)))
        tail = pc.if_else(pc.equal(pc.binary_length(stem), pc.binary_length(cut.words)), "", pc.replace_substring_regex(cut.words, r"^\pL+", ""))
        stems = pc.if_else(ok, pc.utf8_lower(stem), "").dictionary_encode()
        rest = pc.if_else(ok, tail, cut.words).dictionary_encode()
        of_stems, n = self._stems(stems.dictionary.to_pylist())
        others = [e.ids for e in self.tokenizer.encode_batch_fast(rest.dictionary.to_pylist(), add_special_tokens=False)]
        m = np.fromiter(map(len, others), np.int64, len(others))
        ids = np.r_[of_stems, np.fromiter(chain.from_iterable(others), np.uint32, int(m.sum()))].astype("<u4")
        length = np.r_[n, m]
        start = np.cumsum(length) - length
        pieces = np.stack([stems.indices.to_numpy(), rest.indices.to_numpy() + np.int32(len(n))], 1)
        return gather(ids, start, length, pieces[cut.at].ravel(), 2 * np.diff(cut.first))


_WORKERS: dict[str, Words] = {}


def _fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class FileWriter:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, uri: str, frame_bytes: int = 1 << 20, level: int = 3):
        self.fs, self.path = _fs(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames, self.docs, self.n_docs, self.n_tokens = [], 0, [], [], 0, 0

    def add(self, doc_id: int | None, *ids: bytes | memoryview) -> None:
        self.held += ids
        n = sum(map(len, ids))
        k = len(self.frames)
        self.docs.append((~k, 0, n // 4) if doc_id is None else (k, doc_id, n // 4))
        self.size += n
        self.n_docs += 1
        self.n_tokens += n // 4
        if self.size >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._end_frame()
        listed = zstandard.ZstdCompressor(level=3).compress(np.array(self.docs, "<i8").tobytes())
        self.out.write(struct.pack("<II", DOCS, len(listed)) + listed)
        entries = [struct.pack("<III", 8 + len(listed), 0, 0)]
        table = b"".join([*(struct.pack("<III", *f) for f in self.frames), *entries])
        footer = struct.pack("<IBI", len(self.frames) + 1, 0x80, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.fs.move(self.own, self.path)


class FileReader:
    """Reads the trailer, then single frames or documents. A frame whose checksum is wrong is an error."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER:
            raise ValueError(f"{uri} has no seek table")
        entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.frames = np.column_stack([np.r_[0, np.cumsum(entries[:-1, 0])], entries])
        at, length = self.frames[-1][:2]
        listed = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length - 8))
        self.frames = self.frames[:-1]
        self.docs = np.frombuffer(listed, "<i8").reshape(-1, 3).copy()
        self.unnamed = self.docs[:, 0] < 0
        self.docs[self.unnamed, 0] = ~self.docs[self.unnamed, 0]
        self.first = np.searchsorted(self.docs[:, 0], np.arange(len(self.frames)))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(n))

    def frame(self, k: int) -> bytes:
        at, packed, raw, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=int(raw))
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids) of all documents in order, or only of those wanted: other frames aren't read."""
        for k in range(len(self.frames)):
            own = slice(self.first[k], self.first[k + 1] if k + 1 < len(self.first) else None)
            docs = [None if no else d for d, no in zip(self.docs[own, 1].tolist(), self.unnamed[own])]
            if wanted is None or not wanted.isdisjoint(docs):
                data, at = self.frame(k), 0
                for doc, n in zip(docs, self.docs[own, 2].tolist()):
                    if wanted is None or doc in wanted:
                        yield doc, data[at : at + 4 * n]
                    at += 4 * n


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, text: str = "text", doc_id: str = "doc_id", frame_bytes: int = 1 << 20) -> pd.DataFrame:
    """Write docs' ids under `folder`; returns per file: file, n_docs, n_tokens, start (ids before it)."""
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    end = struct.pack("<I", end_id)
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange("doc").sortWithinPartitions("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKERS.get(tokenizer) or _WORKERS.setdefault(tokenizer, Words(tokenizer))
        number, writer = TaskContext.get().partitionId(), None
        for b in together(batches, BLOCK):
            for i, j in blocks(b, "text", BLOCK):
                writer = writer or FileWriter(f"{folder}/{number:07d}.tok.zst", frame_bytes)
                for doc, own in zip(b.column(0).slice(i, j - i).to_pylist(), words.encode(b.column(1).slice(i, j - i))):
                    writer.add(doc, own, end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([number], pa.int32()), "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_tokens], pa.int64())})

    files = sorted(dealt.mapInArrow(run, "file int, n_docs long, n_tokens long").collect())
    table_of = pd.DataFrame([(f"{folder}/{f.file:07d}.tok.zst", f.n_docs, f.n_tokens) for f in files], columns=["file", "n_docs", "n_tokens"])
    table_of["start"] = table_of.n_tokens.cumsum() - table_of.n_tokens
    return table_of


def read(spark: SparkSession, files: pd.DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, ids_crc32, from the files that write() lists.
    With `wanted` (a bounded set), only the frames that hold these documents are decompressed, and start is null."""
    schema = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    if not len(files):
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files[["file", "start"]], "file string, start long").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc, ids in FileReader(file).documents(wanted):
                    rows.append((doc, None if wanted is not None else start, len(ids) // 4, ids, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) >= 500:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return listed.mapInArrow(run, schema)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, new_path(spark, "tokens"))
    return read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")
