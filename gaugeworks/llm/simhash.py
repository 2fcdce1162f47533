"""Near-duplicate groups: SimHash fingerprints, linked through a pigeonring filter (operator 7).

A 64-bit fingerprint is a ring of eight 8-bit segments. If two fingerprints differ in at most ``t``
bits, some segment starts a chain whose first ``l`` segments differ in at most ``l * t / 8`` bits, for
every ``l``. With ``t = 3`` the budgets are 0, 0, 1, 1, 1, 2, 2, 3: the first two segments are equal
and at most one of the next three differs. So equal (start, two segments, two of the next three), a
32-bit key, finds every pair; the rest of the chain prunes what a key brings together before the full
Hamming check.

Scale: fingerprints are made distinct first, so copies of a text cost nothing more. A key held by more
than ``BLOCK`` fingerprints is dealt out as pairs of blocks, each compared in a task of its own, and a
task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.graph import components
from gaugeworks.llm.shared import id_and_text, per_batch, staged

SEED = 42
SEGMENTS = 8
#: Fingerprints of one key that are compared in one task.
BLOCK = 2048
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FULL = (1 << 64) - 1


def simhash64(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number.

    Words are runs of other than ASCII white space, with A-Z in lower case; shingles are ``shingle``
    words joined by a space, repeats included. Fewer words make one shingle; none makes zero.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return int(_vote(grams, SEED)) & _FULL


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(ids: list, texts: list) -> dict:
        fps = np.array([simhash64(t, shingle) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": fps}

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return per_batch(id_and_text(docs, id_col, text_col), run, schema, "doc_id long, fp long")


def _keys(fp: Column, table: int = 0) -> Column:
    """The 24 chain keys of a table's fingerprint: where the chain starts, two segments, two of the next three."""
    part = lambda i: F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))
    keys = []
    for start in range(SEGMENTS):
        for v, (p, q) in enumerate(((2, 3), (2, 4), (3, 4))):
            bits = F.lit((3 * (SEGMENTS * table + start) + v) << 32)
            for shift, i in ((24, 0), (16, 1), (8, p), (0, q)):
                bits = bits + F.shiftleft(part(start + i), shift)
            keys.append(bits)
    return F.array(*keys)


def _near(x: np.ndarray, start: int, t: int) -> np.ndarray:
    """Which differences ``x`` keep within the chain's budgets from ``start``, and then within ``t`` in all."""
    ring = (x >> np.uint64(8 * start)) | (x << np.uint64((64 - 8 * start) % 64)) if start else x
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS):
        ok &= np.bitwise_count(ring & np.uint64((1 << 8 * length) - 1)) <= length * t // SEGMENTS
    ok[ok] = np.bitwise_count(x[ok]) <= t
    return ok


def _forest(rows: tuple[np.ndarray, ...], left: np.ndarray, right: np.ndarray, start: int, t: int, bits: int | None) -> list[tuple[int, int]]:
    """Links between two blocks of rows (or within one): a spanning forest of them.

    ``rows`` are nodes, fingerprints and any further fingerprints; ``left`` and ``right`` number the rows.
    """
    node, fp, *more = rows
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    links = []
    for n, i in enumerate(left):
        others = right[n + 1 :] if right is left else right
        others = others[_near(fp[others] ^ fp[i], start, t)]
        if bits is not None and len(others):
            others = others[sum(np.bitwise_count(m[others] ^ m[i]).astype(np.int64) for m in more) <= bits]
        for x, y in zip(repeat(int(node[i])), node[others].tolist(), strict=False):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def _link_blocks(t: int, bits: int | None):
    """Rows (key, bi, bj, side, node, fp, ...), sorted, to links; one group of rows is at most two blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(key: int, side: np.ndarray, rows: tuple[np.ndarray, ...]) -> list[tuple[int, int]]:
        start = (key >> 32) % (3 * SEGMENTS) // 3
        if len(side) == 2:
            (a, b), (x, y), *more = (r.tolist() for r in rows)
            close = (x ^ y).bit_count() <= t and (bits is None or sum((u ^ v).bit_count() for u, v in more) <= bits)
            return [(a, b)] if close else []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return _forest(rows, left, right if len(right) else left, start, t, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list, last: bool) -> tuple[list, list]:
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            key, bi, bj, side, *rows = cols
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
            bounds = [0, *edge.tolist(), *([len(key)] if last else [])]
            out = []
            for s, e in zip(bounds, bounds[1:], strict=False):
                out += links_of(int(key[s]), side[s:e], tuple(r[s:e] for r in rows))
            rest = [] if last else [tuple(c[bounds[-1] :] for c in cols)]
            return out, rest

        def batch_of(out: list) -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((*cols[:4], *(c.astype(np.int64).view(np.uint64) for c in cols[4:])))
            out, held = flush(held, last=False)
            if out:
                yield batch_of(out)
        if held and len(held[0][0]):
            out, _ = flush(held, last=True)
            if out:
                yield batch_of(out)

    return run


def _links_of_keys(rows: DataFrame, t: int, bits: int | None = None) -> DataFrame:
    """(a, b) from rows (key, node, fp, ...): a spanning forest of the links that each key's rows have."""
    rest = [c for c in rows.columns if c != "key"]
    # keys are counted before rows meet: sums combine on the map side, so a hot key gathers in no task
    hot = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot-keys")
    few = rows.join(hot.select("key"), "key", "left_anti").selectExpr("key", *rest, "count(*) over (partition by key) as n").where("n > 1")
    few = few.selectExpr("key", "0 as bi", "0 as bj", "0 as side", *rest)
    many = (
        rows.join(hot, "key")
        .withColumn("blocks", F.ceil(2 * F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .selectExpr("key", "least(own, other) as bi", "greatest(own, other) as bj", "if(own <= other, 0, 1) as side", *rest)
    )
    found = [
        few.sortWithinPartitions("key", "bi", "bj", "side"),
        many.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "side"),
    ]
    found = [x.mapInArrow(_link_blocks(t, bits), "a long, b long") for x in found]
    return found[0].unionByName(found[1]).distinct()


def links(fps: DataFrame, t: int = 3) -> DataFrame:
    """(a, b): enough links at ``t`` or fewer differing bits to reach all that any links reach.

    ``fps`` has distinct fingerprints ``fp``. Exact: no link between components is lost.
    """
    if not 0 <= t <= 3:
        raise ValueError("the chain keys hold for 0 to 3 differing bits")
    return _links_of_keys(fps.select(F.explode(_keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"), "fp"), t)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, t: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``.

    component_id is the smallest doc_id among all documents that links of ``t`` or fewer differing bits
    reach, itself included. Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat keep one row each. A null doc_id stays null and is never a component_id, unless its
    component has no other. An empty table gives an empty one.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp"), t))
    return _with_lowest(fps, distinct, roots, "fp").select("doc_id", "fp", "component_id")


def _vote(grams: list[bytes], seed: int) -> np.ndarray:
    """The 64 bits that are set in over half the hashes of ``grams``, as a signed number."""
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(seed))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(h)).view(">i8")[0]


#: Bands of a shingle sketch and values of a band. Two texts of Jaccard similarity s share no band with the
#: chance (1 - s ** ROWS) ** BANDS: 5e-5 at 0.8, 5e-7 at 0.85, below 1e-9 at 0.9.
BANDS, ROWS = 25, 5
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes kept of a shingle's hash where two sets are compared, unless a caller says otherwise.
KEPT_BYTES = 5


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer words make one shingle, none makes none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) or [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), ">u8").astype(np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima under ``BANDS`` x ``ROWS`` orders; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.empty(len(_MULTIPLIERS), np.uint64)
    for i, (a, b) in enumerate(_MULTIPLIERS):
        low[i] = (((own ^ b) * a) >> np.uint64(16)).min()
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _numbers(raw: bytes, kept: int) -> np.ndarray:
    """A set's hashes, of ``kept`` bytes each, as numbers."""
    out = np.zeros((len(raw) // kept, 8), np.uint8)
    out[:, :kept] = np.frombuffer(raw, np.uint8).reshape(-1, kept)
    return out.view("<u8").ravel()


def _sets_of(asked: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, kept: int) -> DataFrame:
    """(node, shingles): the whole sets of the nodes of ``asked``, written once."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_set(t, shingle).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept], axis=0).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=schema)

    wanted = asked.join(nodes.select("node", "low", "tid"), "node").hint("merge")
    texts = rows.select("text", F.col("doc_id").alias("low"), F.xxhash64("text").alias("tid"))
    # rows that repeat meet where they are joined: their one text is taken with no further shuffle
    joined = wanted.alias("q").join(texts.alias("t"), F.expr("q.tid = t.tid and q.low <=> t.low")).select("q.tid", "q.low", "node", "text")
    joined = joined.groupBy("tid", "low", "node").agg(F.first("text").alias("text")).select("node", "text")
    return staged(joined.mapInArrow(sets, "node long, shingles binary"), "shingles")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, kept: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets of shingles have the Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _numbers(x, kept), _numbers(y, kept)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    known = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows, shingle, kept)
    full = pairs.join(known.selectExpr("node as b", "shingles as y"), "b").join(known.selectExpr("node as a", "shingles as x"), "a")
    return full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


#: Sets of one group that are compared with each other, or with as many others, in one task.
SET_BLOCK = 256


def _links_between_roots(members: DataFrame, similarity: float, kept: int) -> DataFrame:
    """(a, b) from (cand, node, root, shingles): enough links of the similarity to join what any links join.

    Nodes of one cand and different roots are compared by their whole sets. A cand of more than
    ``SET_BLOCK`` nodes is dealt out as pairs of blocks; a task holds two blocks, compares one set with
    all of a block at once, and returns a spanning forest of the links, never all pairs.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(side: list[int], node: list[int], root: list[int], raw: list[bytes]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        left = [i for i, s in enumerate(side) if not s]
        right = [i for i, s in enumerate(side) if s] or left
        sets = [_numbers(r, kept) for r in raw]
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        end = np.cumsum(size)
        others = np.concatenate([place[end[j] - size[j] : end[j]] for j in right])
        begin = np.concatenate(([0], np.cumsum(size[right])[:-1]))
        marked, out = np.zeros(len(values), np.uint8), []
        for n, i in enumerate(left):
            own = place[end[i] - size[i] : end[i]]
            marked[own] = 1
            both = np.add.reduceat(marked[others], begin, dtype=np.int64)
            marked[own] = 0
            near = both >= similarity * (size[i] + size[right] - both) - 1e-9
            if right is left:
                near[: n + 1] = False
            for j in np.flatnonzero(near).tolist():
                p, q = top(root[i]), top(root[right[j]])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((node[i], node[right[j]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            side, node, root, raw = map(list, zip(*held, strict=True))
            found = links_of(side, node, root, raw) if len(set(root)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

        for batch in batches:
            for cand, bi, bj, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and group != (cand, bi, bj):
                    yield flush()
                    held = []
                group = (cand, bi, bj)
                held.append(tuple(row))
        if held:
            yield flush()

    rest = ["node", "root", "shingles"]
    hot = staged(members.groupBy("cand").agg(F.count("*").alias("n")).where(F.col("n") > SET_BLOCK), "hot-groups")
    few = members.join(hot.select("cand"), "cand", "left_anti").selectExpr("cand", "0 as bi", "0 as bj", "0 as side", *rest)
    many = (
        members.join(hot, "cand")
        .withColumn("blocks", F.ceil(2 * F.col("n") / SET_BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .selectExpr("cand", "least(own, other) as bi", "greatest(own, other) as bj", "if(own <= other, 0, 1) as side", *rest)
    )
    dealt = few.unionByName(many).repartition("cand", "bi", "bj").sortWithinPartitions("cand", "bi", "bj", "side")
    return dealt.mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of documents that links of a Jaccard similarity of ``similarity`` or more reach.

    Sets of shingles of ``shingle`` words are compared. Candidates share a band of their sketches, which
    at 0.8 misses one pair in 20,000 and fewer above; every candidate is decided by its whole sets.
    Candidates are first checked against their band's smallest node only. Components that then still
    share a band with others are compared with them set by set, block by block inside tasks, so no
    table of a group's pairs is ever made. What a band holds is counted by sums that combine on the map
    side.

    Null and empty texts are one group; a text of fewer words than a shingle links with none but its like.
    Rows that repeat keep one row each; a null doc_id stays null. An empty table gives an empty one.
    """
    return sketched_groups(docs, bands, id_col, text_col, shingle, similarity).select("doc_id", "component_id")


def sketched_groups(docs: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, kept: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): the groups of ``similar_groups``, with candidates that share a key of ``keys_of(set)``.

    Whole sets, of ``kept`` bytes of each shingle's hash, decide every candidate.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            node = [xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63) for own in found]
            columns = (node, [len(own) for own in found], [keys_of(own) for own in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    made = rows.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, "doc_id long, tid long, node long, n int, keys array<long>")
    made = staged(made, "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")).alias("first")
    nodes = staged(made.groupBy("node").agg(first, F.any_value("n").alias("n"), F.any_value("keys").alias("keys")).selectExpr("node", "first.doc_id as low", "first.tid as tid", "n", "keys"), "nodes")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("_shares")).where("_shares > 1").select("key", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    shared = staged(keyed.join(heads, "key"), "shared")

    def fits(n: str, m: str) -> Column:
        return F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - F.lit(1e-6)

    to_head = shared.where("node <> head").where(fits("n", "head_n")).selectExpr("head as a", "node as b").distinct()
    near = staged(_verified(staged(to_head, "pairs"), nodes, rows, shingle, similarity, kept), "links")
    roots = components(near)
    rooted = staged(shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    opened = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key", "_low")
    rooted = staged(rooted.join(opened, "key").select("node", "root", "_low").distinct(), "open")
    # groups of components that share a band; within a group, whole sets are compared block by block
    cands = components(rooted, "root", "_low").select(F.col("node").alias("root"), F.col("root").alias("cand"))
    members = rooted.select("node", "root").distinct().join(cands, "root")
    more = _links_between_roots(members.join(_sets_of(members.select("node"), nodes, rows, shingle, kept), "node"), similarity, kept)
    roots = components(near.unionByName(more))
    return _with_lowest(made.selectExpr("doc_id", "cast(n as long) as n_shingles", "node"), nodes.select("node", "low"), roots, "node").select("doc_id", "n_shingles", "component_id")


def _with_lowest(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``rows`` with component_id: the smallest ``low`` among the nodes of their node's component."""
    member = nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    lowest = staged(member.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    ids = staged(member.join(lowest, "root").select(node, "component_id"), "component_ids")
    return rows.join(ids, node)


def joined_groups(*groups: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the documents that links of any of ``groups`` join with others; documents without links have no row.

    component_id is the smallest doc_id that links of all ``groups`` together reach.
    """
    links = [g.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")) for g in groups]
    return components(reduce(DataFrame.unionByName, links)).withColumnsRenamed({"node": "doc_id", "root": "component_id"})


def one_of_each_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose doc_id is their group's component_id, with all their columns.

    ``groups`` is what ``similar_groups``, ``near_duplicate_groups`` or ``joined_groups`` gives. Rows that repeat a doc_id
    leave one; rows with a null doc_id stay.
    """
    gone = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "near-duplicates")
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if docs.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).isEmpty():
        return kept
    named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return named.unionByName(kept.where(F.col(id_col).isNull()))
