"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries (operator 11).

One edit leaves a half of a word intact. Words of m and m + 1 letters are filed by their first m // 2
letters in the forward dictionary and by their last m - m // 2 in the reversed one; both are sorted, and a
block of words with the same half is scanned at once. A block that is too large is filed anew: among words
that share ``a`` letters in front and ``b`` behind, the edit lies in one of the two halves of what is left,
so they share more in front or more behind. At one letter left, the alphabet bounds a block. Where the
edit lies (how many letters two words share in front) says which of all blocks a pair belongs to, so no
pair is taken twice, and a task returns sums for each word, never pairs.

Scale: words are counted in tasks before the first shuffle, so a frequent word costs a row a task. The
dictionaries are dealt out by ranges of their keys. Forms are followed to their roots by doubling: each
form has twice its word's count or more, so the rounds are about the logarithm of the logarithm of it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import id_and_text, staged

#: Letters and occurrences from which a result is a word.
LETTERS, OCCURRENCES = 5, 3
#: One run in CUT loses a letter; a form has RATIO times a word's count or more.
CUT, RATIO = 97, 2
#: Words of a block that one task scans, and of a part of it whose pairs are tried.
BLOCK, FEW = 1024, 8
#: Bytes of text that are split and counted at once.
CHUNK = 1 << 22
_LOWER = np.array([*range(65), *range(97, 123), *range(91, 256)], np.uint8)
_LETTER = np.array([97 <= b <= 122 or b == 0xC3 for b in range(256)])
#: Lengths for which a prefix's crc32 is carried on for all documents at once.
_SHORT = 40


def runs_of(raw: bytes, ends: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The runs of a-z, A-Z and U+00C0 to U+00FF of texts in UTF-8, A-Z in lower case: (runs, bytes, number of the text).

    ``raw`` holds the texts, each followed by a blank, and ``ends`` where they end. U+00C0 to U+00FF are
    the two-byte characters that begin with C3, and C3 begins no other.
    """
    text = _LOWER[np.frombuffer(raw, np.uint8)]
    own = _LETTER[text]
    own[1:] |= text[:-1] == 0xC3
    edges = np.diff(own.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    size = end - begin
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    runs = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(text[own].tobytes()))
    return runs, size, np.searchsorted(ends, begin, side="right")


def _carried(prefix: np.ndarray, size: int) -> np.ndarray:
    """crc32 of ``size`` zero bytes after each crc32 of ``prefix``, without what zero alone gives."""
    zeros = bytes(size)
    own = zlib.crc32(zeros)
    return np.array([zlib.crc32(zeros, int(p)) ^ own for p in prefix], np.uint32)


def counted(ids: list, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The results of some texts' runs with their counts; fewer than ``LETTERS`` letters are left out.

    crc32 is linear: that of a prefix and a run is the run's own, combined with the prefix's carried over
    as many zero bytes. So runs are hashed once, however many documents have them.
    """
    parts = [t.encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    runs, size, of = runs_of(b" ".join(parts) + b" ", ends)
    enough = size >= LETTERS
    coded = runs.filter(pa.array(enough)).dictionary_encode()
    size, of, place = size[enough], of[enough], coded.indices.to_numpy()
    words = coded.dictionary
    own = np.fromiter((zlib.crc32(w.as_py().encode()) for w in words), np.uint32, len(words))
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = own[place]
    short = size < _SHORT
    table = np.stack([_carried(prefix, n) if (size == n).any() else np.zeros_like(prefix) for n in range(_SHORT)])
    h[short] ^= table[size[short], of[short]]
    for n in np.unique(size[~short]).tolist():
        those = size == n
        docs, back = np.unique(of[those], return_inverse=True)
        h[those] ^= _carried(prefix[docs], n)[back]
    cut = h % CUT == 0
    n = np.bincount(place[~cut], minlength=len(words))
    known = np.flatnonzero(n)
    less: dict[str, int] = defaultdict(int)
    for w, x in zip(words.take(pa.array(place[cut])).to_pylist(), h[cut].tolist(), strict=True):
        at = x % len(w)
        less[w[:at] + w[at + 1 :]] += 1
    out = pa.concat_arrays([words.take(pa.array(known)), pa.array(list(less), pa.large_string())])
    n = np.concatenate([n[known], np.fromiter(less.values(), np.int64, len(less))])
    long = pc.greater_equal(pc.utf8_length(out), LETTERS)
    return out.filter(long), n[long.to_numpy(zero_copy_only=False)]


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of whole texts, after the cuts, with their counts over all rows."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        room = CHUNK
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[0].append(i)
                held[1].append(t)
                room -= len(t)
                if room <= 0:
                    words, n = counted(*held)
                    yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], schema=schema)
                    held, room = ([], []), CHUNK
        if held[0]:
            words, n = counted(*held)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

    rows = id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


_KEY = ["m", "head", "tail"]


def _filed(words: DataFrame) -> DataFrame:
    """(m, head, tail, word, n): each word in its two blocks of both dictionaries."""
    half = F.expr("m div 2").cast("int")
    rows = words.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m")).where(F.col("m") >= LETTERS)
    forward = rows.select("m", F.col("word").substr(F.lit(1), half).alias("head"), F.lit("").alias("tail"), "word", "n")
    backward = rows.select("m", F.lit("").alias("head"), F.expr("right(word, cast(m - m div 2 as int))").alias("tail"), "word", "n")
    return forward.unionByName(backward)


def _subdivided(rows: DataFrame) -> DataFrame:
    """Blocks of more than ``BLOCK`` words filed anew, by more letters in front or behind, until none can be."""
    done = None
    rows = staged(rows, "filed")
    while True:
        room = F.col("m") - F.length("head") - F.length("tail")
        large = staged(rows.groupBy(*_KEY).agg(F.count("*").alias("_many")).where((F.col("_many") > BLOCK) & (room > 1)).select(*_KEY), "large-blocks")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        more = rows.join(large, _KEY).select("*", F.expr("cast((m - length(head) - length(tail)) div 2 as int)").alias("_half"))
        front = more.select("m", F.expr("left(word, length(head) + _half)").alias("head"), "tail", "word", "n")
        behind = more.select("m", "head", F.expr("right(word, cast(m - length(head) - _half as int))").alias("tail"), "word", "n")
        rows = staged(front.unionByName(behind), "filed")


def shared(u: str, v: str, a: int) -> int:
    """Letters that u and v, which share ``a``, share in front."""
    m = min(len(u), len(v))
    while a < m and u[a] == v[a]:
        a += 1
    return a


def scan(rows: list[tuple[str, int]], m: int, a: int, b: int) -> dict[str, list]:
    """word -> [number of near words, -n and word of the best] among words that share ``a`` and ``b`` letters.

    Only pairs whose edit lies between those letters, one of them at least of ``m`` letters.
    """
    found: dict[str, list] = {}

    def meet(u: tuple[str, int], v: tuple[str, int]) -> None:
        for (w, _), (x, n) in ((u, v), (v, u)):
            own = found.setdefault(w, [0, 1, ""])
            own[0] += 1
            if (-n, x) < (own[1], own[2]):
                own[1], own[2] = -n, x

    def part(rows: list[tuple[str, int]], a: int, b: int) -> None:
        left = m - a - b
        if len(rows) <= FEW or left <= 1:
            short = [r for r in rows if len(r[0]) == m]
            long = [r for r in rows if len(r[0]) > m]
            for i, u in enumerate(short):
                for v in short[i + 1 :]:
                    p = shared(u[0], v[0], a)
                    if p < m - b and u[0][p + 1 :] == v[0][p + 1 :]:
                        meet(u, v)
                for v in long:
                    p = shared(u[0], v[0], a)
                    if (p < m - b or not b) and u[0][p:] == v[0][p + 1 :]:
                        meet(u, v)
            return
        half = left // 2
        groups: dict[tuple[int, str], list] = defaultdict(list)
        for r in rows:
            w = r[0]
            groups[0, w[a : a + half]].append(r)
            groups[1, w[len(w) - (m - a - half) : len(w) - b]].append(r)
        for (side, _), those in groups.items():
            if len(those) > 1:
                part(those, *((a + half, b) if not side else (a, m - a - half)))

    part(rows, a, b)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words; best is that of the largest n, the smaller of equal ones."""
    schema = pa.schema([("word", pa.string()), ("k", pa.int64()), ("less", pa.int64()), ("best", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            m, head, tail = key
            found = scan(held, m, len(head), len(tail))
            columns = [list(found), *([v[i] for v in found.values()] for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for *own, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if len(held) > 1:
                        yield flush()
                    key, held = own, []
                held.append((word, n))
        if len(held) > 1:
            yield flush()

    blocks = _subdivided(_filed(words)).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "word")
    found = blocks.mapInArrow(run, "word string, k long, less long, best string")
    found = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("less", "best")).alias("top"))
    return found.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that each leads to, by pointer doubling."""
    at = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        far = at.join(then, "root", "left")
        stepped = staged(far.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")), "roots")
        if stepped.where("_went").isEmpty():
            return stepped.select("word", "root")
        at = stepped.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the texts with the word that it is a variant of.

    form is the near word of largest count (of equal ones the smallest in code-point order), if it has
    ``RATIO`` times the word's count or more, else null; root is where following forms ends. A null text
    has no words, a null doc_id counts as an empty string where runs are hashed, and rows that repeat
    count as often as they stand. An empty table gives an empty one.
    """
    words = staged(dictionary(docs, id_col, text_col), "dictionary")
    near = staged(near_words(words), "near-words")
    own = words.join(near, "word", "left")
    fits = F.col("best_n") >= RATIO * F.col("n")
    own = own.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n"))
    own = staged(own, "variants")
    roots = _roots(own.where("form is not null"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
