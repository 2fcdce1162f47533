"""Document fingerprints from closed syncmers (operator 9).

A k-mer of characters is a closed syncmer if the smallest hash among its inner s-mers stands first or
last. That depends on the k-mer alone, so an edit moves no anchor but those whose k-mers it touches.
A fingerprint is a one-permutation sketch of a document's anchors with their places: each anchor falls
into one of ``BINS`` by its hash, each bin keeps its smallest value and where that anchor first stands.
Two fingerprints are matched by position: bins of equal value are pairs of places, and of these the
longest series that stands in the same order in both documents counts. Likeness is its length over the
number of bins that either fills; without the order it would estimate the Jaccard coefficient.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import id_and_text, per_batch

K, S, BINS = 12, 5, 64
_EMPTY = 0xFFFF
#: A bin of a sketch: the anchor's value, and its place in code points.
_BIN = np.dtype([("value", ">u2"), ("place", ">u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads neighbouring numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _mers(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
    return _mix(h)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points) of a text's closed syncmers.

    A text shorter than k has one anchor, the whole text; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < k:
        return _mers(codes, len(codes)), np.zeros(1, np.int64)
    small = _mers(codes, s)
    inner = k - s + 1
    n = len(codes) - k + 1
    low, width = small, 1
    while 2 * width <= inner:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[inner - width : inner - width + n])
    at = np.flatnonzero((low == small[:n]) | (low == small[inner - 1 : inner - 1 + n]))
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + codes[at + i]
    return _mix(h), at


def sketch(found: tuple[np.ndarray, np.ndarray], bins: int = BINS) -> np.ndarray:
    """Of anchors (hashes, positions): each bin's smallest value and where it first stands; 0xFFFF where empty."""
    hashes, positions = found
    value = np.minimum((hashes >> np.uint64(32)) & np.uint64(0xFFFF), _EMPTY - 1).astype(np.int64)
    bin_of = (hashes % np.uint64(bins)).astype(np.int64)
    order = np.lexsort((positions, value, bin_of))
    first = order[np.concatenate(([True], np.diff(bin_of[order]) > 0))] if len(order) else order
    out = np.zeros(bins, _BIN)
    out["value"] = _EMPTY
    out["value"][bin_of[first]] = value[first]
    out["place"][bin_of[first]] = np.minimum(positions[first], 0xFFFFFFFF)
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """How many pairs of places (a, b) stand in strictly the same order in both, at most."""
    ends: list[int] = []
    for x in b[np.lexsort((-b, a))].tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sketches, from 0 to 1: matches in order, over bins that either fills; two empty ones are alike."""
    filled = (a["value"] != _EMPTY) | (b["value"] != _EMPTY)
    if not filled.any():
        return 1.0
    same = (a["value"] == b["value"]) & filled
    return in_order(a["place"][same].astype(np.int64), b["place"][same].astype(np.int64)) / int(filled.sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, hashes, positions, fingerprint): the anchors of each row's text and their sketch in hex.

    Null and empty texts have no anchors and the sketch of empty bins; rows that repeat and null
    doc_ids keep their rows; an empty table gives an empty one. hashes are signed longs.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64())), ("fingerprint", pa.string())])

    def run(ids: list, texts: list) -> dict:
        found = [anchors(t, k, s) for t in texts]
        return {"doc_id": ids, "hashes": [h.view(np.int64) for h, _ in found], "positions": [p for _, p in found], "fingerprint": [_hex(sketch(f)) for f in found]}

    return per_batch(id_and_text(docs, id_col, text_col), run, schema, "doc_id long, hashes array<long>, positions array<long>, fingerprint string", rows=128)


def _hex(x: np.ndarray) -> str:
    return x.tobytes().hex()


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, doc_id, text, carry) in order within each bucket, for passes that look one document ahead.

    Buckets are ranges of doc_id, about as many as there are shuffle partitions; each ends with a copy
    of the next bucket's first document (the last with the first document of all), marked by ``carry``.
    Only the bounds of the ranges and the first rows' ids, a few for each partition, come to the driver.
    Whole texts cross the network once.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})

    def bucket(low: int, high: int) -> Column:
        """Of buckets low to high the one of doc_id, by halving; a null doc_id comes first."""
        if low == high:
            return F.lit(low)
        half = (low + high) // 2
        return F.when(F.coalesce(F.col("doc_id") < bounds[half], F.lit(True)), bucket(low, half)).otherwise(bucket(half + 1, high))

    rows = rows.withColumn("bucket", bucket(0, len(bounds)))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    found = sorted((r.bucket, r.first.doc_id) for r in firsts.collect())
    sends = {found[i][0]: (found[i][1], found[i - 1][0] if i else found[-1][0]) for i in range(len(found))}
    # a row can only be the first of its own bucket
    first_of = F.array(*[F.lit(sends.get(i, (None, 0))[0]).cast("long") for i in range(len(bounds) + 1)])
    goes_to = F.array(*[F.lit(sends.get(i, (None, 0))[1]) for i in range(len(bounds) + 1)])
    extra = F.when(F.get(first_of, F.col("bucket")).eqNullSafe(F.col("doc_id")), F.get(goes_to, F.col("bucket")))
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("carry")), F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(True).alias("carry")))))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("place")).select("place.bucket", "doc_id", "text", "place.carry")
    return dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "carry", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    edited: the text with its last n_chars // 4 code points replaced by the first as many (or all) of
    the next document's in ascending doc_id; after the last comes the first. Null texts are empty. Rows
    of one doc_id follow each other by text; a null doc_id comes before all others. A document alone
    follows itself. An empty table gives an empty one.
    """
    columns = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        last: tuple | None = None  # bucket, doc_id, text, sketch, of the document that waits for its next

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for bucket, i, text, carry in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = sketch(anchors(text))
                    if last is not None and last[0] == bucket:
                        _, j, before, a = last
                        n = len(before)
                        edited = before[: n - n // 4] + text[: n // 4]
                        e = sketch(anchors(edited))
                        out.append((j, n, edited, _hex(a), _hex(e), likeness(a, e), likeness(a, own)))
                        chars += len(edited)
                        if chars > 4_000_000:
                            yield flush()
                            out.clear()
                            chars = 0
                    # of several rows of the next bucket's first doc_id, only the first follows
                    last = None if carry else (bucket, i, text, own)
        if out:
            yield flush()

    ddl = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, ddl)


