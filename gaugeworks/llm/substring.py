"""Fuzzy repeated passages: shared k-mer seeds, collinear chains, alignment (operator 6).

1. Seeds. A window of word k-mers gives its smallest; any run of k + window - 1 words that two documents
   share gives both the same seed.
2. Matches. Each hash found in two documents or more has a head, its first occurrence in the smallest
   doc_id. Every other occurrence is matched with the head, so a passage that n documents share makes
   n - 1 matches a seed and not n * (n - 1) / 2.
3. Chains. The matches of two documents are chained in order in both, with gap costs that grow with the
   distance, by a Fenwick tree over the second document's positions.
   Where a document goes over from one partner to another, documents that do so at the same places are
   matched with each other too (``_joints``), so a passage whose parts were first seen apart is found.
4. Alignment. The words around each chain are fetched once for each document that takes part, and the
   chain is aligned and extended with tolerance for words that differ.
5. Passages. Spans that touch and go on in the same partner are one stretch; a stretch of enough words in
   one partner counts, and counted stretches that touch are one passage. Short spans with different
   partners side by side, such as stock lines, make no passage.

Scale: two shuffles of seeds' worth and one of the texts. Heads come from a sum that combines on the map
side, and seeds meet them in a join of two scans, so AQE can split the rows of a hot seed; words are
fetched in slices on a fixed grid, so thousands of chains into one document ask for the same few slices.
What a step leaves that no later one reads, staged tables and shuffle files, is freed before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaugeworks.llm.shared import finished, id_and_text, small_batches, staged

#: Words of a seed, and seeds of which a window gives one.
K, WINDOW = 6, 16
#: Words from which a passage counts, an aligned span is kept, and spans that far apart are one passage.
PASSAGE, SPAN, JOIN = 50, 16, 2
#: Words by which a partner's place may shift between two spans that make one stretch.
DRIFT = 8
#: Cost of a gap, by word of distance and by word of difference between the two distances.
GAP, SHIFT = 0.1, 0.5
#: Words between two matches from which a chain is cut there.
CUT = 40
#: Words fetched on either side of a chain, and the grid on which slices are cut.
AROUND, GRID = 48, 128
#: Share of equal words that an alignment must reach.
SAME = 0.8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of other than ASCII white space, A-Z in lower case."""
    return text.encode().translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(0))), ">u8").astype(np.uint64)


def seeds(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a text's seeds; a text of fewer than k words has none."""
    h = word_hashes(words_of(text))
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    if n <= window:
        at = np.array([int(g.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(g, window)
        at = np.unique(np.concatenate([view[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(view))) for i in range(0, len(view), 65536)]))
    at = _thinned(g, at, window)
    return g[at].view(np.int64), at.astype(np.int32)


def _thinned(g: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Seeds without those that repeat a seed's hash less than half a window after it, as in runs of one word."""
    if not ((g[at[1:]] == g[at[:-1]]) & (np.diff(at) < window // 2)).any():
        return at
    kept, last = [], {}
    for i, h in zip(at.tolist(), g[at].tolist(), strict=True):
        if i - last.get(h, -window) >= window // 2:
            kept.append(i)
            last[h] = i
    return np.array(kept)


def _seed_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, pos, first): the seeds of every document; first marks a hash's first place in it."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [seeds(t) for t in part.column(1).to_pylist()]
                firsts = []
                for h, _ in found:
                    first = np.zeros(len(h), bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    firsts.append(first)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(p) for _, p in found])
                if len(ids):
                    columns = [np.concatenate([h for h, _ in found]), ids.astype(np.int64), np.concatenate([p for _, p in found]), np.concatenate(firsts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.mapInArrow(run, "h long, doc_id long, pos int, first boolean")


def _heads(seed_rows: DataFrame) -> DataFrame:
    """(h, partner, at): the head of each hash that two documents or more have."""
    heads = seed_rows.where("first").groupBy("h").agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("_last"), F.min_by("pos", "doc_id").alias("at"))
    return heads.where("partner <> _last").drop("_last")


def _matches(seed_rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, partner, pos, at): each seed's occurrences against its head, for documents that differ."""
    return seed_rows.join(heads, "h").where("doc_id <> partner").select("doc_id", "partner", "pos", "at")


def chain(pos: list[int], at: list[int], k: int = K) -> list[list[tuple[int, int]]]:
    """Best collinear chains of matches (pos, at), sorted by both; each is a list of matches in order.

    A match adds up to k words; going on from an earlier one costs GAP for each word between and SHIFT
    for each word by which the two distances differ. The Fenwick tree holds, for each position in the
    second document, the best chain that ends at or before it.
    """
    order = sorted(set(at))
    rank = {a: i + 1 for i, a in enumerate(order)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(order) + 1)
    score, back = [0.0] * len(pos), [-1] * len(pos)

    def best(i: int) -> tuple[float, int]:
        top = (-1e18, -1)
        while i:
            top = max(top, tree[i])
            i &= i - 1
        return top

    i = 0
    while i < len(pos):
        j = i
        while j < len(pos) and pos[j] == pos[i]:
            j += 1
        for m in range(i, j):
            value, prev = best(rank[at[m]] - 1)
            gain = value - GAP * (pos[m] + at[m])
            if prev >= 0:
                step, other = pos[m] - pos[prev], at[m] - at[prev]
                gain += min(k, step, other) - SHIFT * abs(step - other)
            score[m] = float(k)
            if prev >= 0 and gain > k:
                score[m], back[m] = gain, prev
        for m in range(i, j):
            entry, r = (score[m] + GAP * (pos[m] + at[m]), m), rank[at[m]]
            while r < len(tree):
                if tree[r] < entry:
                    tree[r] = entry
                r += r & -r
        i = j
    used, chains = [False] * len(pos), []
    for m in sorted(range(len(pos)), key=lambda m: (-score[m], m)):
        if used[m]:
            continue
        used[m] = True
        links = [m]
        while back[links[-1]] >= 0 and not used[back[links[-1]]]:
            prev, last = back[links[-1]], links[-1]
            if max(pos[last] - pos[prev], at[last] - at[prev]) > CUT:
                chains.append([(pos[x], at[x]) for x in reversed(links)])
                links = []
            used[prev] = True
            links.append(prev)
        chains.append([(pos[x], at[x]) for x in reversed(links)])
    return chains


def _apart(chains: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Chains without single matches that repeat one less than ``CUT`` words before, in the same place of the partner.

    They come from words said over and over; what the first reaches by alignment holds the others. A
    passage that counts has several matches, so none is lost.
    """
    kept, last = [], {}
    for c in sorted(chains):
        p, a = c[0]
        if len(c) == 1 and p - last.get(a, -CUT) < CUT:
            continue
        if len(c) == 1:
            last[a] = p
        kept.append(c)
    return kept


def _chains(matches: DataFrame) -> DataFrame:
    """(doc_id, partner, s, e, ps, pe, pos, at): chains as word spans, ends exclusive, and their matches."""
    names = ("doc_id", "partner", "s", "e", "ps", "pe")
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("pos", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def spans(cols: list[np.ndarray], bounds: list[int]) -> pa.RecordBatch:
            rows = []
            for s, e in zip(bounds, bounds[1:], strict=False):
                for c in _apart(chain(cols[2][s:e].tolist(), cols[3][s:e].tolist())):
                    p, a = zip(*c, strict=True)
                    rows.append((int(cols[0][s]), int(cols[1][s]), p[0], p[-1] + K, a[0], a[-1] + K, p, a))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            edges = (np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist()
            if edges:
                yield spans(cols, [0, *edges])
            held = [c[edges[-1] if edges else 0 :] for c in cols]
        if held is not None and len(held[0]):
            yield spans(held, [0, len(held[0])])

    dealt = matches.repartition("doc_id", "partner").sortWithinPartitions("doc_id", "partner", "pos", "at")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", pos array<int>, at array<int>")


def _joints(chains: DataFrame) -> DataFrame:
    """Chains, like ``chains``, across places where a document's chains go over from one partner to another.

    Heads alone may each hold only a part of a passage that two later documents both hold whole. Both then have
    chains with the same heads, one after the other: the last place in one head and the first in the next name
    the joint, and every document with the joint is matched there with the smallest that has it. As with
    seeds, n documents make n - 1 matches a joint; alignment carries them over the passage.
    """
    first, last = lambda c: F.element_at(c, 1), lambda c: F.element_at(c, -1)
    # only a chain's ends go to its document's task
    ends = chains.select("doc_id", "s", "e", "partner", "ps", *[f(c).alias(f"{c}_{n}") for c in ("pos", "at") for n, f in (("first", first), ("last", last))])
    by_start = Window.partitionBy("doc_id").orderBy("s", "e", "partner", "ps")
    start = F.struct("partner", F.col("pos_first").alias("pos"), F.col("at_first").alias("at"))
    # the next chain may lie inside this one, so the one after it is taken too
    after = F.array(*[F.lead(start, n).over(by_start) for n in (1, 2)])
    turns = ends.select("doc_id", F.col("partner").alias("_a"), F.col("at_last").alias("_at_a"), F.col("pos_last").alias("_p"), after.alias("_b"))
    turns = turns.withColumn("_b", F.explode("_b"))
    near = (F.col("_b.partner") != F.col("_a")) & (F.col("_b.pos") > F.col("_p")) & (F.col("_b.pos") - F.col("_p") <= CUT)
    key = ["_a", "_at_a", "_c", "_at_c"]
    turns = staged(turns.where(near).select("doc_id", "_a", "_at_a", F.col("_b.partner").alias("_c"), F.col("_b.at").alias("_at_c"), F.col("_p").alias("p"), F.col("_b.pos").alias("q")), "joints")
    heads = turns.groupBy(*key).agg(F.min(F.struct("doc_id", "p", "q")).alias("_head"), F.max("doc_id").alias("_last")).where("_head.doc_id <> _last").drop("_last")
    found = turns.join(heads, key).where("doc_id <> _head.doc_id")
    return found.selectExpr("doc_id", "_head.doc_id as partner", "cast(p as long) as s", f"cast(q + {K} as long) as e", "cast(_head.p as long) as ps", f"cast(_head.q + {K} as long) as pe", "array(p, q) as pos", "array(_head.p, _head.q) as at")


def _grid(chains: DataFrame) -> DataFrame:
    """Chains with the slices (on a grid) of both documents' words that their alignment needs."""
    low = lambda c: F.greatest(F.floor((F.col(c) - AROUND) / GRID) * GRID, F.lit(0)).cast("long")
    high = lambda c: (F.ceil((F.col(c) + AROUND) / GRID) * GRID).cast("long")
    return chains.select("*", low("s").alias("from"), high("e").alias("to"), low("ps").alias("p_from"), high("pe").alias("p_to"))


def _slices(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, from, to, words): hashes of a document's words from..to, for each slice asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                part = batch.slice(at, 128)
                for i, text, asks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    h = (word_hashes(words_of(text)) >> np.uint64(32)).astype("<u4")
                    rows += [(i, a["from"], a["to"], h[a["from"] : a["to"]].tobytes()) for a in asks]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    asks = asked.groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("asks"))
    # rows that repeat meet in the join's tasks; the words themselves are not dealt out for that
    got = docs.join(asks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "asks").dropDuplicates(["doc_id"])
    return got.mapInArrow(run, "doc_id long, from long, to long, words binary")


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, at: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Aligns a and b along a chain's matches and extends both ways: (s, e, ps, pe, equal words).

    Matches of one diagonal are compared word by word from the first to the end of the last; where the
    diagonal changes, the words between are aligned by their longest equal blocks. Ends move outwards
    over equal words and over words that differ, as long as two of three are equal.
    """

    def reach(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        n = min(len(x), len(y))
        if not n:
            return 0, 0
        equal = x[:n] == y[:n]
        gain = np.cumsum(np.where(equal, 1, -2))
        worst = gain < np.maximum.accumulate(gain) - 8
        stop = int(worst.argmax()) if worst.any() else n
        if not stop or gain[:stop].max() <= 0:
            return 0, 0
        far = int(gain[:stop].argmax()) + 1
        return far, int(equal[:far].sum())

    s, e, ps, pe = int(pos[0]), int(pos[-1]) + k, int(at[0]), int(at[-1]) + k
    left, equal = reach(a[:s][::-1], b[:ps][::-1])
    right, more = reach(a[e:], b[pe:])
    equal += more
    turns = np.flatnonzero(np.diff(pos - at)) + 1
    x, y = s, ps  # what lies before has been counted
    for i, j in zip([0, *turns], [*turns, len(pos)], strict=True):
        p, q = int(pos[i]), int(at[i])
        if x < p and y < q:
            equal += sum(m.size for m in SequenceMatcher(None, a[x:p].tolist(), b[y:q].tolist(), autojunk=False).get_matching_blocks())
        skip = max(0, x - p, y - q)
        x, y = int(pos[j - 1]) + k, int(at[j - 1]) + k
        equal += int((a[p + skip : x] == b[q + skip : y]).sum())
    return s - left, e + right, ps - left, pe + right, equal


def _aligned(chains: DataFrame, slices: DataFrame) -> DataFrame:
    names = ("doc_id", "partner", "s", "e", "ps", "pe", "equal")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["words"], "<u4"), np.frombuffer(r["p_words"], "<u4")
                f, g = r["from"], r["p_from"]
                s, e, ps, pe, equal = align(a, b, np.array(r["pos"]) - f, np.array(r["at"]) - g)
                if e - s >= SPAN and equal >= SAME * max(e - s, pe - ps):
                    rows.append((r["doc_id"], r["partner"], s + f, e + f, ps + g, pe + g, equal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    other = slices.select(F.col("doc_id").alias("partner"), F.col("from").alias("p_from"), F.col("to").alias("p_to"), F.col("words").alias("p_words"))
    both = chains.join(slices, ["doc_id", "from", "to"]).join(other, ["partner", "p_from", "p_to"])
    return both.select("doc_id", "partner", "pos", "at", "from", "p_from", "words", "p_words").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """(doc_id, passage_start, passage_end, partner_id, start, end, partner_start, partner_end, equal_words).

    One row for each aligned span, in words from 0, ends exclusive; passage_start and passage_end are the
    whole repeated passage that the span is part of: ``passage`` words or more of it stand in one partner
    in the same order. The document with the
    smallest doc_id of those that share a seed keeps its passage: it stands as a partner only. Repeats
    inside one document, null doc_ids, null and empty texts and texts of fewer than ``K`` words have no
    rows. Rows of one doc_id must have one text; rows that repeat count once. An empty table gives an
    empty one.
    """
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    found = staged(_seed_rows(rows), "seeds")
    heads = staged(_heads(found), "heads")
    finished(docs.sparkSession)
    chains = staged(_chains(_matches(found, heads)), "chains")
    finished(docs.sparkSession, found, heads)
    chains = _grid(chains.unionByName(staged(_joints(chains), "turns")))
    asked = chains.select("doc_id", "from", "to").unionByName(chains.selectExpr("partner as doc_id", "p_from as from", "p_to as to"))
    slices = staged(_slices(rows, asked), "slices")
    finished(docs.sparkSession)
    spans = _aligned(chains, slices).distinct()
    stretches = _numbered(spans.withColumn("drift", F.col("ps") - F.col("s")), ["doc_id", "partner"], "stretch", apart=lambda w: F.abs(F.col("drift") - F.lag("drift").over(w)) > DRIFT)
    stretch = Window.partitionBy("doc_id", "partner", "stretch")
    counted = stretches.withColumn("words", F.max("e").over(stretch) - F.min("s").over(stretch)).where(F.col("words") >= passage)
    islands = _numbered(counted, ["doc_id"], "island")
    whole = Window.partitionBy("doc_id", "island")
    found = islands.withColumn("passage_start", F.min("s").over(whole)).withColumn("passage_end", F.max("e").over(whole))
    return found.where(F.col("passage_end") - F.col("passage_start") >= passage).selectExpr(
        "doc_id", "passage_start", "passage_end", "partner as partner_id", "s as start", "e as end", "ps as partner_start", "pe as partner_end", "equal as equal_words"
    )


def _numbered(spans: DataFrame, keys: list[str], name: str, apart: Callable[[WindowSpec], Column] | None = None) -> DataFrame:
    """Adds ``name``: spans of the keys by start, numbered anew after a gap of over ``JOIN`` words, or where ``apart`` holds."""
    by_start = Window.partitionBy(*keys).orderBy("s", "e", "partner", "ps")
    reached = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("s") > F.coalesce(reached, F.lit(-JOIN - 1)) + JOIN
    if apart is not None:
        new = new | F.coalesce(apart(by_start), F.lit(False))
    return spans.withColumn("new", new.cast("int")).withColumn(name, F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of every repeated passage taken out of ``text_col``; nothing else changes.

    Other words keep the white space before them. A document of which nothing is left is dropped.
    ``found`` is what ``repeated_passages`` gives; documents without rows in it stay as they were.
    """
    cuts = found.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.collect_set(F.struct(F.col("passage_start").alias("a"), F.col("passage_end").alias("b"))).alias("_cuts"))

    @F.pandas_udf("string")
    def keep(texts, cuts):  # noqa: ANN001, ANN202
        return texts.combine(cuts, lambda t, c: t if t is None or c is None else _without(t, [(x["a"], x["b"]) for x in c]))

    joined = small_batches(docs).join(cuts.hint("shuffle_hash"), docs[id_col] == F.col("_cut_id"), "left")
    kept = joined.withColumn(text_col, F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(keep(F.col(text_col), F.col("_cuts"))))
    return kept.where(F.col("_cuts").isNull() | (F.length(F.trim(text_col)) > 0)).select(*docs.columns)


def _without(text: str, cuts: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    space = np.isin(np.frombuffer(raw, np.uint8), (9, 10, 11, 12, 13, 32))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    bounds = list(zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True))
    for a, b in sorted(cuts):
        if a < len(bounds):
            start = bounds[a - 1][1] if a else 0
            end = bounds[min(b, len(bounds)) - 1][1]
            if start > at:
                out.append(raw[at:start])
            at = max(at, end)
    out.append(raw[at:])
    return b"".join(out).decode()
