"""Substring dedup by relative Lempel-Ziv parsing.

The whole corpus is the reference, indexed in blocks by hash. A text is cut
where the smallest 8-gram of its 20-word windows changes (winnowing), so equal
passages are cut at the same places wherever they stand. Windows with the same
smallest gram form one segment; a segment that stands earlier in the corpus as
a whole is a factor of the parse, and a run of such factors is a long one. At
factor boundaries, where a segment's gram is known but its text differs, the
segment's windows are looked up one by one, so no repeated window is missed.

Segments are routed to the index block that holds their gram. What one task has
several times it settles itself and sends on once, so a passage that very many
documents share costs each task one entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import blobs, bloom
from . import words as ws

WINDOW = 20
GRAM = 8
#: Segments or windows a task gathers before it passes them on.
FLUSH = 100_000

_ENTRY, _KNOWN = 0, 1
_SEGMENTS = {
    _ENTRY: (np.uint32, np.uint64, np.int64, np.int64, np.int32, np.int32),
    _KNOWN: (np.int64, np.int64, np.int32, np.int32),
}
_WINDOWS = {
    _ENTRY: (np.uint64, np.uint64, np.int64, np.int64, np.int32),
    _KNOWN: (np.int64, np.int64, np.int32),
}
_R = ws.constants(1, 77)[0]
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for base in (_R, _R_INVERSE):
            steps = np.full(size, base)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _up, _down = both
    return _up, _down


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equal) value in every ``width`` consecutive ones."""
    at = np.arange(len(h))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    return at


def segments(found: ws.Words) -> tuple[np.ndarray, ...]:
    """Segments of a chunk: document in chunk, first window, number of windows, gram hash, text hash."""
    empty = np.zeros(0, np.int64)
    n = len(found.hash)
    counts = np.diff(found.bounds)
    has = counts >= WINDOW
    if not has.any():
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = ws.grams(found.hash, GRAM, 8)
    place = _least(grams, WINDOW - GRAM + 1)
    starts = ws.ranges(found.bounds[:-1][has], counts[has] - WINDOW + 1)
    own = place[starts]
    doc = np.repeat(np.flatnonzero(has), counts[has] - WINDOW + 1)
    head = np.flatnonzero(ws.firsts(own, doc))
    length = np.diff(np.r_[head, len(starts)])
    first = starts[head]
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hash * up[:n])])
    last = first + length + WINDOW - 1
    text = ws.mix((sums[last] - sums[first]) * down[first] + length.astype(np.uint64))
    return doc[head], first - found.bounds[doc[head]], length, grams[own[head]], text


def _earliest(keys, orders):
    """Sort by ``keys`` then ``orders``. Returns the order, the groups' heads and which rows come strictly later."""
    order = np.lexsort([*reversed(orders), *reversed(keys)])
    keys = [k[order] for k in keys]
    head = ws.firsts(*keys)
    at = np.flatnonzero(head)
    of = np.repeat(at, np.diff(np.r_[at, len(order)]))
    later = np.zeros(len(order), bool)
    for o in orders:
        o = o[order]
        later |= o != o[of]
    return order, head, later


def _index_segments(buckets: int):
    """Map side: a task's segments, each once; repeats inside the task are known at once."""

    def flush(parts):
        if not parts:
            return
        gram, text, doc, tie, first, length = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, head, later = _earliest([gram, text], [doc, tie, first])
        gram, text, doc, tie, first, length = (c[order] for c in (gram, text, doc, tie, first, length))
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        high = (gram >> np.uint64(32)).astype(np.uint32)
        yield from blobs.pack(_ENTRY, bucket[head], [c[head] for c in (high, text, doc, tie, first, length)], 6)
        yield from blobs.pack(_KNOWN, doc[later] % buckets, [c[later] for c in (doc, tie, first, length)], 6)

    def run(batches):
        parts, total = [], 0
        for batch in batches:
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, buf, offsets in ws.chunks(batch.column(2)):
                of, first, length, gram, text = segments(ws.split(buf, offsets))
                parts.append((gram, text, doc[a + of], tie[a + of], first.astype(np.int32), length.astype(np.int32)))
                total += len(of)
                if total >= FLUSH:
                    yield from flush(parts)
                    parts, total = [], 0
        yield from flush(parts)

    return run


def _rows(kind: int, doc, tie, first, length):
    for at in range(0, len(doc), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(doc[cut]), kind, np.int32)),
                *[pa.array(np.asarray(c[cut], np.int64)) for c in (doc, tie, first, length)],
            ],
            ["kind", "doc", "tie", "first", "n"],
        )


def _settle_segments(batches):
    """Reduce side: repeated segments (kind 0), and segments whose windows must be looked up (kind 1)."""
    found = blobs.gather(batches, _SEGMENTS)
    bucket, high, text, doc, tie, first, length = found[_ENTRY]
    order, head, later = _earliest([bucket, high, text], [doc, tie, first])
    bucket, high, text, doc, tie, first, length = (c[order] for c in (bucket, high, text, doc, tie, first, length))
    yield from _rows(0, *[c[later] for c in (doc, tie, first, length)])
    yield from _rows(0, *found[_KNOWN][1:])
    # grams with several texts: the earliest segment of each text stands for all of them
    gram = np.cumsum(ws.firsts(bucket, high)) - 1
    texts = np.bincount(gram[head], minlength=gram[-1] + 1 if len(gram) else 0)
    ask = head & (texts[gram] > 1) if len(gram) else head
    yield from _rows(1, *[c[ask] for c in (doc, tie, first, length)])


def _window_hashes(found: ws.Words) -> tuple[np.ndarray, np.ndarray]:
    return ws.grams(found.hash, WINDOW, 21), ws.grams(found.hash, WINDOW, 22)


def _index_windows(buckets: int):
    """Map side: the windows asked for, from texts with their list of ``(first, n)``."""

    def flush(parts):
        if not parts:
            return
        g1, g2, doc, tie, first = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, head, later = _earliest([g1, g2], [doc, tie, first])
        g1, g2, doc, tie, first = (c[order] for c in (g1, g2, doc, tie, first))
        yield from blobs.pack(_ENTRY, (g1 % np.uint64(buckets)).astype(np.int64)[head], [c[head] for c in (g1, g2, doc, tie, first)], 6)
        yield from blobs.pack(_KNOWN, doc[later] % buckets, [c[later] for c in (doc, tie, first)], 6)

    def run(batches):
        parts, total = [], 0
        for batch in batches:
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            spans = batch.column(3)
            at, values = spans.offsets.to_numpy() - spans.offsets[0].as_py(), spans.flatten()
            starts, counts = (values.field(i).to_numpy() for i in (0, 1))
            for a, b, buf, offsets in ws.chunks(batch.column(2)):
                found = ws.split(buf, offsets)
                g1, g2 = _window_hashes(found)
                lo, hi = at[a], at[b]
                of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                first = ws.ranges(starts[lo:hi], counts[lo:hi])
                of = np.repeat(of, counts[lo:hi])
                place = found.bounds[of] + first
                parts.append((g1[place], g2[place], doc[a + of], tie[a + of], first.astype(np.int32)))
                total += len(of)
                if total >= FLUSH:
                    yield from flush(parts)
                    parts, total = [], 0
        yield from flush(parts)

    return run


def _settle_windows(batches):
    found = blobs.gather(batches, _WINDOWS)
    _, g1, g2, doc, tie, first = found[_ENTRY]
    order, _, later = _earliest([g1, g2], [doc, tie, first])
    doc, tie, first = (c[order][later] for c in (doc, tie, first))
    # neighbouring windows of a document as one span
    for d, t, f in ((doc, tie, first), found[_KNOWN][1:]):
        order = np.lexsort((f, t, d))
        d, t, f = d[order], t[order], f[order].astype(np.int64)
        at = np.flatnonzero(ws.firsts(d, t, f - np.arange(len(f))))
        yield from _rows(0, d[at], t[at], f[at], np.diff(np.r_[at, len(d)]))


_FOUND = "kind int, doc bigint, tie bigint, first bigint, n bigint"


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``doc``, ``tie``, ``spans``: runs of windows (first word, number of windows) that stand earlier too.

    ``keyed`` has ``doc``, ``tie`` (which order documents) and ``text``.
    """
    n = blobs.partitions(keyed)
    index = keyed.select("doc", "tie", "text").mapInArrow(_index_segments(n), blobs.schema(6)).repartition(n, "bucket")
    settled = materialize(index.mapInArrow(_settle_segments, _FOUND), "segments")

    span = F.struct("first", "n")
    ask = settled.where("kind = 1").groupBy("doc", "tie").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    ask = materialize(ask, "ask").withColumnsRenamed({"doc": "_doc", "tie": "_tie"})
    likely = bloom.build(ask.select(F.xxhash64("_doc")))
    texts = keyed.where(likely.might_contain(F.xxhash64("doc")))
    texts = texts.join(ask, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie"))).select("doc", "tie", "text", "spans")
    windows = texts.mapInArrow(_index_windows(n), blobs.schema(6)).repartition(n, "bucket")
    windows = materialize(windows.mapInArrow(_settle_windows, _FOUND), "windows")
    both = settled.where("kind = 0").unionByName(windows)
    return both.groupBy("doc", "tie").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def _keep(text: str | None, spans) -> tuple[list[bytes], int]:
    """Words of a text outside all spans, and how many there were."""
    found = (text or "").encode("utf-8").split()
    n = len(found)
    if not spans:
        return found, n
    gone = np.zeros(n + 1, np.int32)
    first = np.array([s["first"] for s in spans], np.int64)
    size = np.array([s["n"] for s in spans], np.int64)
    np.add.at(gone, np.minimum(first, n), 1)
    np.add.at(gone, np.minimum(first + size + WINDOW - 1, n), -1)
    return [w for w, g in zip(found, np.cumsum(gone[:-1]).tolist(), strict=True) if not g], n


def keyed(docs: DataFrame, *others: str) -> DataFrame:
    """``doc`` and ``tie`` order the documents: the id (null first), then a hash of the text.

    Rows equal in both are one document: copies of a row do not repeat each other.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tie"), "text", *others
    )


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    spans = materialize(spans, "spans").withColumnsRenamed({"doc": "_doc", "tie": "_tie", "spans": "_spans"})
    return rows.join(spans, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").drop("_doc", "_tie")


def kept_words(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row of ``docs``.

    A word goes when a 20-word window over it stands earlier in the corpus
    (``keyed`` says what earlier means). Null and empty texts have no words.
    Other columns are not read.
    """
    rows = keyed(docs)
    joined = _with_spans(rows, repeated_spans(rows)).select("doc", "text", "_spans")

    def run(batches):
        for batch in batches:
            words, gone, sums = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, n = _keep(text, spans)
                words.append(n)
                gone.append(n - len(kept))
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())],
                ["doc", "n_words", "n_removed", "kept_sha256"],
            )

    out = joined.mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; texts without any stay as they are.

    What is left of a cut text are its kept words with one space between. All
    other columns pass through.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    joined = _with_spans(rows, repeated_spans(rows)).select("_row", "text", "_spans")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = batch.column(2).to_pylist()
            out = [b" ".join(_keep(t, s)[0]).decode("utf-8") if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "text"])

    out = joined.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
