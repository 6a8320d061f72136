"""Texts coded a block at a time: cut at spaces and line ends, each distinct word coded once, ids gathered by array.

A block's words are numbered by Arrow (a dictionary of the distinct ones), an operator gives each distinct word its
pieces, and the ids of all texts are gathered from the pieces' ids in whole arrays. Nothing is kept from one block
to the next, so memory is that of a block and a lost worker loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are coded at once; a longer text is a block of its own. Larger blocks hold fewer distinct words a
#: byte, and need some 25 times their size of a worker's memory.
BLOCK = 2_000_000


def blocks(batch: pa.RecordBatch, name: str, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """The batch's rows in slices (from, until) of some `size` bytes of the column's text."""
    column = batch.column(batch.schema.get_field_index(name))
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


class Cut:
    """Texts cut at spaces and line ends. words: the distinct ones (an Arrow array); at: the place of each word of the texts among
    them; first: of each text its first word's number (and the number of all words); before: the byte before each
    word, 0 for the first of a text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # The copy has no offset, and its bytes lie where those of the texts do.
        plain = pa.concat_arrays([texts, pa.array([], pa.large_string())])
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.at = coded.indices.to_numpy()
        self.first = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        lengths = pc.binary_length(split.flatten()).to_numpy().astype(np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1 - np.repeat(np.arange(len(texts)), np.diff(self.first))
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)
        self.before = np.zeros(len(starts), np.uint8)
        inner = np.ones(len(starts), bool)
        inner[self.first[:-1]] = False
        self.before[inner] = data[np.frombuffer(plain.buffers()[1], np.int64)[0] + starts[inner] - 1]


def gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray, seq: np.ndarray, per_text: np.ndarray) -> list[memoryview]:
    """The ids of texts: those of the pieces `seq`, where per_text pieces are a text's; ids start[p]:start[p] + length[p]
    are piece p's. Texts are done some at a time, so that the arrays of places stay small."""
    out: list[memoryview] = []
    ends = np.cumsum(per_text)
    a = 0
    while a < len(ends):
        low = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, low + 1_000_000, "right")))
        part = seq[low : ends[b - 1]]
        n = length[part]
        total = np.r_[0, np.cumsum(n)]
        places = np.repeat(start[part] - total[:-1], n) + np.arange(total[-1])
        data = memoryview(ids[places].tobytes())
        border = 4 * total[np.r_[low, ends[a:b]] - low]
        out += [data[i:j] for i, j in zip(border[:-1].tolist(), border[1:].tolist())]
        a = b
    return out

