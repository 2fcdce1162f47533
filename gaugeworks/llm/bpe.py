"""BPE encoding and decoding with a pair occurrence index (operator 8).

All distinct pre-tokens of a block of documents are laid out in one row of symbols. An index maps each
pair's rank to all positions where the pair stands; the active ranks are applied in ascending order,
each to all its positions at once, and the lists of the pairs that change are updated. A merge yields
only pairs of higher rank, so one ascending sweep does what a word-by-word encoder does.

Scale: a map over documents with no shuffle. A block is bounded by ``BLOCK_CHARS`` and the memory of
pre-tokens already encoded by ``KEPT``; a document longer than a block is a block of its own.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers

from gaugeworks.llm.shared import id_and_text

BLOCK_CHARS = 6_000_000
KEPT = 500_000
#: These four count as white space for str.split(), but not for the vocabulary's normaliser.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space of both, without the four.
_SPACE = regex.compile(f"[^\\S{_SEPARATORS}]+")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


_BYTES = {s: b for b, s in enumerate(_byte_symbols())}


@lru_cache(maxsize=1)
def _disagreed() -> tuple[re.Pattern[str], frozenset[str]]:
    """The code points on which Unicode tables of different versions disagree: a pattern up to U+FFFF, a set beyond.

    They are those that have no name yet in Python's tables, and the marks that the tokenizers library puts into
    another order than Python does.
    """
    nfc = normalizers.NFC().normalize_str
    odd = []
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        kind = unicodedata.category(c)
        if kind == "Cn" or (kind == "Mn" and nfc(t := f"a\u0301{c}\u0323{c}") != unicodedata.normalize("NFC", t)):
            odd.append(c)
    # re looks a character of a class up in a table only where the class ends at U+FFFF
    return re.compile("[" + "".join(re.escape(c) for c in odd if c <= "\uffff") + "]"), frozenset(c for c in odd if c > "\uffff")


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _unsure(text: str) -> bool:
    """Whether a text has code points on which Unicode tables disagree."""
    if text.isascii():
        return False
    low, high = _disagreed()
    return low.search(text) is not None or any(c in high for c in _BEYOND.findall(text))


class Vocabulary:
    """A BPE vocabulary file of the tokenizers library: split pattern, merges, ids."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.strings = {i: s for s, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.final = np.array([ids[s + suffix] for s in symbols], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) << 32 | self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.mark = regex.compile(f"({marks})") if marks else None

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, which normalises and splits what ``_unsure`` finds."""
        return Tokenizer.from_file(self.path)

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk, in UTF-8."""
        if not _unsure(chunk):
            return [w.encode() for w in self.pattern.findall(chunk)]
        return [bytes(_BYTES[c] for c in piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where a pair has none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], len(self._keys))

    def encode_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids begin (with the end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate(([0], ends[:-1]))
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        nxt = np.arange(1, len(raw) + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, len(raw) - 1)
        prv[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        none = len(self.left)

        def enter(at: np.ndarray) -> None:
            ranks = self.rank(sym[at], sym[nxt[at]])
            known = ranks < none
            at, ranks = at[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks)) + 1
            for r, places in zip(ranks[np.concatenate(([0], edges))].tolist() if len(ranks) else [], np.split(at, edges), strict=False):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            places = index.pop(r)
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            a, b = self.left[r], self.right[r]
            after = nxt[at]
            fits = (sym[at] == a) & (after >= 0) & (sym[after] == b)
            at, after = at[fits], after[fits]
            if a == b and len(at) > 1 and (after[:-1] == at[1:]).any():
                # places that overlap merge from the left
                keep, taken = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
                    if p != taken:
                        keep.append(i)
                        taken = q
                at, after = at[keep], after[keep]
            if not len(at):
                continue
            beyond = nxt[after]
            sym[at] = self.merged[r]
            sym[after] = -1
            nxt[at] = beyond
            inside = beyond >= 0
            prv[beyond[inside]] = at[inside]
            before = prv[at]
            changed = np.concatenate((before[before >= 0], at[inside]))
            if len(changed):
                enter(np.unique(changed))
        live = sym >= 0
        kept = np.concatenate(([0], np.cumsum(live)))
        return sym[live], kept[np.concatenate(([0], ends))]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Encoder:
    """Encodes blocks of texts; remembers the ids of chunks (runs without white space) it has seen."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        special = sorted(self.vocab.special.items())
        self.codes = {" " + s: i for i, (s, _) in enumerate(special)}  # no chunk holds a space
        self.ids = np.array([i for _, i in special], np.int32)
        self.bounds = np.arange(len(special) + 1, dtype=np.int64)
        self.strings = [s for s, _ in special]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; a special token stands as a chunk of its own."""
        mark = self.vocab.mark
        if mark is not None and "<" in text and mark.search(text):
            out = []
            for i, part in enumerate(mark.split(text)):
                out += [" " + part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _unsure(text):
                return [c for c in self.vocab.library.normalizer.normalize_str(text).split(" ") if c]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no word-final form
        if any(c in text for c in _SEPARATORS):
            return _SPACE.split(text.lower())
        return text.lower().split()

    def learn(self, words: set[str]) -> None:
        """Encodes the chunks that are new, all together."""
        new = sorted(words - self.codes.keys())
        parts = [self.vocab.words(c) for c in new]
        distinct = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(distinct)}
        flat, at = self.vocab.encode_all(distinct)
        which = np.fromiter((place[w] for p in parts for w in p), np.int64)
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        sizes = (at[1:] - at[:-1])[which]
        ids = flat[_ragged(at[:-1][which], sizes)]
        token_ends = np.concatenate(([0], np.cumsum(sizes)))
        bounds = token_ends[np.concatenate(([0], np.cumsum(n_words)))]
        base = len(self.codes)
        self.codes.update((c, base + i) for i, c in enumerate(new))
        listed = list(map(self.vocab.strings.__getitem__, ids.tolist()))
        self.strings += [" ".join(listed[s:e]) for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        self.bounds = np.concatenate((self.bounds, bounds[1:] + self.bounds[-1]))
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        split = [self.chunks(t) for t in texts]
        if len(self.codes) > KEPT:
            self.forget()
        self.learn(set().union(*split))
        out, decoded = [], []
        for chunks in split:
            codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
            begin = self.bounds[codes]
            size = self.bounds[codes + 1] - begin
            out.append(self.ids[_ragged(begin, size)])
            full = codes[size > 0]
            decoded.append(" ".join(map(self.strings.__getitem__, full.tolist())))
        return out, decoded


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... size[0] of them, then those of begin[1], and so on."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - size, size) + np.repeat(begin, size)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): one row for each row of ``docs``.

    ``tokenizer`` is the path of a vocabulary file with an end-of-word suffix that every executor has.
    ids are those of the tokenizers library without added special tokens (strings of special tokens in
    a text become their ids); decoded is its decode() with special tokens kept, which for a vocabulary
    without a decoder joins the tokens by spaces. Null and empty texts have no ids and decode to
    nothing. Texts with code points on which Unicode tables disagree (``_unsure``) are normalised and split into
    words by the library itself. Repeated rows and null doc_ids keep their rows. An empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(vocabulary(tokenizer))

        def encoded(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            tokens, decoded = encoder.encode(texts)
            for at in range(0, len(ids), 512):
                some = tokens[at : at + 512]
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in some]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some)))
                arrays = [pa.array(ids[at : at + 512], pa.int64()), column, pa.array(decoded[at : at + 512], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        ids: list = []
        texts: list = []
        chars = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chars + len(t) > BLOCK_CHARS and ids:
                    yield from encoded(ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(t)
                chars += len(t)
        if ids:
            yield from encoded(ids, texts)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
