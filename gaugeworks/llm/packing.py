"""Packing by power-of-two decomposition (operator 10).

A document of n tokens becomes n // size pieces of the full size, then one piece for each set bit of
the remainder, longest first. Pieces of equal length share a bucket, so a batch from one bucket needs
no padding and no sequence crosses documents: every piece is a sequence of its own.

Scale: a map over documents with no shuffle. Numbers of sequences come from the partition and a count
in it, so tasks need not talk to each other; the input's partitions must be the same when a task is
run again, as those of a file scan are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gaugeworks.llm.bpe import _byte_symbols
from gaugeworks.llm.shared import id_and_text

SEQUENCE = 2048
#: Closes each document.
END = 1
#: Fixed value: the split pattern of byte-level vocabularies with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file, whose ids are in order of rank, for tiktoken."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {s: b for b, s in enumerate(_byte_symbols())}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Runs of white space from this length on are left to the tokenizers library: the other's pattern engine
#: recurses once for each character of them, and near a million its stack is full.
LONG_RUN = 100_000
_BLANKS = re.compile(r"\s+")


class Encoder:
    """Ids of a text, by a fast library where it can and by the tokenizers library, whose ids are equal, where not."""

    def __init__(self, path: str) -> None:
        self.path, self.fast = path, encoding(path)
        self.exact: Tokenizer | None = None

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _BLANKS.finditer(text)):
            self.exact = self.exact or Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all") if "<|" in text else self.fast.encode_ordinary(text)


def cut(n: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of a document of n tokens; ``size`` is a power of two."""
    rest = n % size
    return [size] * (n // size) + [1 << b for b in range(size.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece.

    ids holds the piece's token ids as little-endian unsigned 32-bit numbers. start counts the
    document's tokens before the piece, doc_tokens all of them, the closing ``END`` included. A
    sequence's bucket is its length; sequence_id carries the bucket's exponent in its top bits, then the
    partition, then a count, so sorting by it gives one bucket after another. offset is 0 throughout:
    a piece fills its sequence, which as a power of two takes no padding.

    Null and empty texts are one piece, END alone. Strings of special tokens in a text become their
    ids; texts of any length and any runs are encoded whole. Repeated rows are packed each; a null doc_id stays null. An empty table gives an empty one.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("the size of a sequence must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        partition = TaskContext.get().partitionId()
        made = dict.fromkeys((1 << b for b in range(size.bit_length())), 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text)
                    ids.append(END)
                    raw, n, start = np.array(ids, "<u4").tobytes(), len(ids), 0
                    for length in cut(n, size):
                        number = (length.bit_length() - 1) << 58 | partition << 34 | made[length]
                        made[length] += 1
                        rows.append((i, start, length, raw[4 * start : 4 * (start + length)], n, number, 0))
                        start += length
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl)
