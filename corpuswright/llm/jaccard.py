"""N-gram Jaccard join by partitioning the universe of shingles.

The hashes of a document's distinct word shingles are split into segments by
value, as many as its size band asks for. Sets of ``a`` and ``b`` shingles with
the wanted similarity differ in at most ``H`` of them, so of any ``H + 1``
segments one is the same in both: each document indexes its first ``H + 1``
segments that are not empty. A document with too few of those (the dearer
case, so segments are numbered to make it rare) indexes all it has, their
one-deletion neighbourhoods, and where even those may miss, single shingles.
Documents that share an index entry are candidates and verified exactly.

Exact copies are one class. Within an index entry candidates first meet its
smallest class only. Members that these links have not joined are compared
afterwards inside tasks, by sketches first and by their sets where sketches cannot
rule a pair out; only links that join something become rows, so groups of similar
documents never expand into all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import blobs, bloom, rows
from . import words as ws
from .components import components

SHINGLE = 5
#: Wanted similarity as a fraction.
NUM, DEN = 3, 4
#: Index entries a task gathers before it passes them on.
FLUSH = 100_000
#: Cells of the parity sketch per shingle, which rules pairs out before their texts are read.
CELLS = 4
#: Star pairs with so many entries in common are taken for one cluster.
STRONG = 8
#: Classes of a group that one task compares with as many others, and how many of them at once.
BLOCK, STRIP = 2048, 16
#: Shingles of such classes that one task verifies against as many others: 8 MB.
SHINGLES = 1 << 20

_DOC, _LOCAL_PAIR, _LOCAL_GROUP = 0, 1, 2
_TYPES = {_DOC: (np.uint32, np.int64), _LOCAL_PAIR: (np.int64, np.int64, np.int64), _LOCAL_GROUP: (np.int64, np.int64)}


def most_apart(a: int, b: int) -> int:
    """Largest symmetric difference of sets of these sizes that are similar enough."""
    shared = -(-NUM * (a + b) // (NUM + DEN))
    return a + b - 2 * shared


def _largest(a: int) -> int:
    return a * DEN // NUM


def _smallest(a: int) -> int:
    return -(-a * NUM // DEN)


@lru_cache(None)
def _band(i: int) -> tuple[int, int]:
    """Sizes of band ``i``: each is about as wide as the sizes one set can be similar to."""
    low = 1 if i == 0 else _band(i - 1)[1] + 1
    return low, max(low, _largest(low) - (1 if _largest(low) > low + 1 else 0))


def _band_of(n: int) -> int:
    i = 0
    while _band(i)[1] < n:
        i += 1
    return i


@lru_cache(None)
def _segments(i: int) -> int:
    """Segments of band ``i``: the fewest that leave a set of the band enough full ones 49 times in 50."""
    n = _band(i)[1]
    needed = max(most_apart(n, m) for m in range(n, _largest(n) + 1)) + 1
    m = needed
    while m > 1:
        empty = m * (1 - 1 / m) ** n
        spread = m * (m - 1) * (1 - 2 / m) ** n + empty - empty**2 if m > 2 else 0.25
        if m - empty - 2 * math.sqrt(max(spread, 0)) >= needed:
            break
        m += max(1, m // 50)
    return m


@lru_cache(1 << 16)
def _roles(n: int) -> tuple[tuple[int, int, int], ...]:
    """``(band, segments, entries)`` of a set of ``n``: in its own band, and as the larger set in lower ones."""
    own = _band_of(n)
    found = [(own, _segments(own), max(most_apart(n, m) for m in range(n, _largest(n) + 1)) + 1)]
    for i in range(own - 1, -1, -1):
        low, high = _band(i)
        if high < _smallest(n):
            break
        found.append((i, _segments(i), max(most_apart(m, n) for m in range(max(low, _smallest(n)), high + 1)) + 1))
    return tuple(found)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle, without words none."""
    for a, b, buf, offsets in ws.chunks(column):
        found = ws.split(buf, offsets, lower=True)
        grams = ws.grams(found.hash, SHINGLE, 5)
        for i in range(b - a):
            first, last = found.bounds[i], found.bounds[i + 1]
            n = last - first
            if n >= SHINGLE:
                h = np.sort(grams[first : last - SHINGLE + 1])
                yield h[ws.firsts(h)]
            else:
                yield ws.grams(found.hash[first:last], n, 50 + n) if n else np.zeros(0, np.uint64)


def _class(s: np.ndarray) -> int:
    """Number of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = ws.mix(np.array([ws.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(total.view(np.int64)[0])


def entries(s: np.ndarray) -> np.ndarray:
    """Index entries of a set of shingle hashes."""
    out = []
    scrambled = ws.mix(s ^ np.uint64(0x5BD1E995))
    high = s >> np.uint64(32)
    for band, m, wanted in _roles(len(s)):
        segment = (high * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(ws.firsts(segment))
        salt = ws.mix(segment[starts] + np.uint64((band + 1) << 40))
        if len(starts) >= wanted:
            end = starts[wanted] if len(starts) > wanted else len(s)
            out.append(ws.mix(np.add.reduceat(scrambled[:end], starts[:wanted]) + salt[:wanted]))
            continue
        sums = np.add.reduceat(scrambled, starts)
        out.append(ws.mix(sums + salt))
        sizes = np.diff(np.r_[starts, len(s)])
        of = np.repeat(np.arange(len(starts)), sizes)
        many = sizes[of] >= 2
        out.append(ws.mix(sums[of[many]] - scrambled[many] + salt[of[many]]))
        if 2 * (sizes >= 2).sum() + (sizes == 1).sum() < wanted:
            out.append(ws.mix(scrambled + np.uint64((band + 1) << 20)))
    return np.unique(np.concatenate(out))


def _groups(key: np.ndarray, ids: np.ndarray):
    """Sorted distinct ``(key, id)`` with the start and size of each key's group."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = ws.firsts(key, ids)
    key, ids = key[new], ids[new]
    starts = np.flatnonzero(ws.firsts(key))
    return key, ids, starts, np.diff(np.r_[starts, len(key)])


def _stars(key, ids, starts, sizes):
    """Distinct pairs of a group's smallest id with its others, counted; and the members of larger groups."""
    of = np.repeat(np.arange(len(starts)), sizes)
    center = ids[starts][of]
    other = np.arange(len(ids)) != starts[of]
    a, b = center[other], ids[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(ws.firsts(a, b))
    count = np.diff(np.r_[first, len(a)])
    return a[first], b[first], count


def _index(buckets: int):
    """Map side: entries by bucket, under the class of their set. Classes of one task that share an entry are joined here already."""

    def flush(sigs, ids):
        if not sigs:
            return
        sig = np.concatenate(sigs)
        at = np.repeat(np.array(ids, np.int64), [len(s) for s in sigs])
        bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        key = (bucket << 32) | (sig & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key, at, starts, sizes = _groups(key, at)
        lead = starts
        lead = lead[np.argsort(at[lead], kind="stable")]
        yield from blobs.pack(_DOC, key[lead] >> 32, [(key[lead] & 0xFFFFFFFF).astype(np.uint32), at[lead]], 3)
        many = sizes >= 2
        if many.any():
            rows = np.repeat(many, sizes)
            size = sizes[many]
            k, i = key[rows], at[rows]
            s = np.cumsum(size) - size
            a, b, n = _stars(k, i, s, size)
            yield from blobs.pack(_LOCAL_PAIR, b % buckets, [a, b, n], 3)
            yield from blobs.pack(_LOCAL_GROUP, k >> 32, [k, i], 3)

    def run(batches):
        sigs, ids, total, seen = [], [], 0, set()
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                kind = _class(s)
                if not len(s) or kind in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(kind)
                sigs.append(entries(s))
                ids.append(kind)
                total += len(sigs[-1])
                if total >= FLUSH:
                    yield from flush(sigs, ids)
                    sigs, ids, total = [], [], 0
        yield from flush(sigs, ids)

    return run


def _candidates(batches):
    """Reduce side: ``(kind, a, b, n)``: pairs with their count, and members of entries (a: entry, b: class)."""
    found = blobs.gather(batches, _TYPES)
    bucket, sig, ids = found[_DOC]
    key, at, starts, sizes = _groups((bucket << 32) | sig.astype(np.int64), ids)
    many = sizes >= 2
    rows = np.repeat(many, sizes)
    size = sizes[many]
    k, i = key[rows], at[rows]
    s = np.cumsum(size) - size
    a, b, n = _stars(k, i, s, size) if len(k) else (k, i, k)
    _, la, lb, ln = found[_LOCAL_PAIR]
    _, lk, li = found[_LOCAL_GROUP]
    if len(k):
        # a lone pair is complete as a pair unless a task had more members of its entry
        local = np.unique(lk)
        wide = (size >= 3) | np.isin(k[s], local)
        mark = np.add.reduceat(ws.mix(i.astype(np.uint64)), s)
        # entries with members inside tasks keep their own name, as those come under it
        mark = np.where(np.isin(k[s], local), ws.mix(k[s].astype(np.uint64)), mark)
        _, one = np.unique(mark, return_index=True)
        chosen = np.repeat(wide & np.isin(np.arange(len(s)), one), size)
        k, i = k[chosen], i[chosen]
    out = [(0, a, b, n), (0, la, lb, ln), (1, k, i, np.zeros(len(k), np.int64)), (1, lk, li, np.zeros(len(lk), np.int64))]
    for kind, x, y, z in out:
        for at_row in range(0, len(x), 100_000):
            cut = slice(at_row, at_row + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x[cut]), kind, np.int32)), pa.array(x[cut]), pa.array(y[cut]), pa.array(np.asarray(z[cut], np.int64))],
                ["kind", "a", "b", "n"],
            )


def _sizes(batches):
    for batch in batches:
        sizes, kinds = [], []
        for s in shingle_sets(batch.column(2)):
            sizes.append(len(s))
            kinds.append(_class(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(kinds, pa.int64())],
            ["doc", "body", "n_shingles", "class"],
        )


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each cell, a power of two of cells that follows the size."""
    cells = 1 << max(8, (CELLS * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer cells: parities of cells that fall together add up."""
    while m.shape[-1] > words:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def _sketches(batches):
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        out = [_sketch(s).view(np.int64) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["class", "n", "sketch"]
        )


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy().view(np.uint64)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _near_pairs(batches):
    """Pairs (a, b, na, nb, sa, sb) whose sketches differ in no more cells than similar sets can."""
    for batch in batches:
        na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = []
        for x, y, i, j in zip(_lists(batch.column(4)), _lists(batch.column(5)), na, nb, strict=True):
            words = min(len(x), len(y))
            keep.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= most_apart(i, j))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches):
    """Pairs of texts that are similar enough."""
    left, cached = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2)
        keep = []
        for i, s in enumerate(shingle_sets(batch.column(3))):
            if a[i] != left:
                left, cached = a[i], next(shingle_sets(texts.slice(i, 1)))
            shared = len(np.intersect1d(cached, s, assume_unique=True))
            union = len(cached) + len(s) - shared
            if shared and DEN * shared >= NUM * union:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _close(a: str, b: str):
    """Sizes near enough for the wanted similarity."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _same_class(batches):
    """Rows whose text has the wanted class; a repeated id may stand for several texts."""
    for batch in batches:
        own = pa.array([_class(s) for s in shingle_sets(batch.column(1))], pa.int64())
        yield batch.filter(pc.equal(own, batch.column(0)))


def _texts(docs: DataFrame, classes: DataFrame, repeated: bool) -> DataFrame:
    """``class``, ``text`` of ``classes`` (``class``, ``doc``, ``body``); only their documents are shuffled.

    Ids may be null or stand for many texts, so documents are found by id and
    text hash. Only where those repeat can a class be found twice.
    """
    likely = bloom.build(classes.select(F.xxhash64("doc", "body")))
    named = docs.withColumn("body", rows.body())
    found = named.where(likely.might_contain(F.xxhash64("doc", "body"))).join(classes, ["doc", "body"]).select("class", "text")
    found = found.mapInArrow(_same_class, "class bigint, text string")
    return materialize(found.dropDuplicates(["class"]) if repeated else found, "texts")


def _not_ruled_out(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct class pairs ``a``, ``b`` that their sketches do not rule out."""
    x = sketches.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_near_pairs, "a bigint, b bigint")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct class pairs ``a``, ``b`` that link."""
    wanted = bloom.build(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().select(F.xxhash64("class")))
    texts = texts.where(wanted.might_contain(F.xxhash64("class")))
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify, "a bigint, b bigint"), "links")


def _clusters(stars: DataFrame) -> DataFrame:
    """``node``, ``label``: clusters of classes joined by strong star pairs (``a``, ``b``, ``n``).

    A class without a strong pair goes to the cluster of the class it shares the
    most entries with, if that is in one: a few such classes in a cluster's
    entries would leave each entry to be compared alone.
    """
    strong = components(stars.where(F.col("n") >= STRONG))
    ends = stars.select("a", "b", "n").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = ends.groupBy("a").agg(F.max("n").alias("most"), F.max(F.struct("n", "b"))["b"].alias("b"))
    weak = best.where(F.col("most") < STRONG).select(F.col("a").alias("weak"), "b")
    return strong.unionByName(weak.join(strong, weak["b"] == strong["node"]).select(F.col("weak").alias("node"), "label"))


def _open_groups(member: DataFrame, named: DataFrame) -> DataFrame:
    """``level``, ``group``, ``class``, ``n``, ``label``: groups that hold every candidate pair with two labels.

    A group is a cluster of classes that share many entries (``whole``), when
    comparing all of it costs less than going through the entries inside it, or
    else one entry. Entries of the same classes are one.
    """
    wholes = named.groupBy("whole").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    entry = member.groupBy("entry").agg(
        F.min("whole").alias("whole"),
        F.max("whole").alias("other"),
        F.count(F.lit(1)).alias("m"),
        F.min("label").alias("x"),
        F.max("label").alias("y"),
        F.min("class").alias("low"),
        F.max("class").alias("high"),
        F.bit_xor(F.xxhash64("class")).alias("mark"),
    )
    entry = entry.where("x <> y").groupBy("mark", "m", "low", "high").agg(
        F.min("entry").alias("entry"), F.first("whole").alias("whole"), F.first("other").alias("other")
    )
    entry = materialize(entry.select("entry", "whole", "other", "m"), "entries")
    cost = entry.where("whole = other").groupBy("whole").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    dense = wholes.join(cost, "whole").where(F.col("size") * F.col("size") <= F.col("cost")).select("whole")
    dense = materialize(dense, "dense").withColumn("dense", F.lit(True))
    inside = named.join(dense, "whole").select(F.lit(1).alias("level"), F.col("whole").alias("group"), "class", "n", "label")
    left = entry.join(dense, "whole", "left").where((F.col("whole") != F.col("other")) | F.col("dense").isNull()).select("entry")
    alone = member.join(left, "entry").select(F.lit(0).alias("level"), F.col("entry").alias("group"), "class", "n", "label")
    return inside.unionByName(alone)


def _block_pairs(key, block, kind, words, within):
    """Members of a task's groups to be compared: ``(x, y, words of the shorter sketches)``."""
    order = np.lexsort((kind, words, block, key))
    starts = np.flatnonzero(ws.firsts(key[order]))
    for first, last in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        rows = order[first:last]
        low = rows if within[rows[0]] else rows[block[rows] == block[rows[0]]]
        high = rows if within[rows[0]] else rows[block[rows] != block[rows[0]]]
        for w in np.unique(words[low]):
            # sizes of similar sets are near, so their sketches are of one length or the next
            for v in np.unique(words[high]):
                if max(w, v) > 2 * min(w, v) or (within[rows[0]] and v < w):
                    continue
                yield low[words[low] == w], high[words[high] == v], min(w, v)


def _near(x, y, words, cells, n, label):
    """Pairs of members, strip by strip, whose labels differ and that neither sizes nor sketches rule out."""
    ys = _folded(np.stack([cells[i] for i in y]), words)
    for at in range(0, len(x), STRIP):
        part = x[at : at + STRIP]
        total = n[part][:, None] + n[y][None, :]
        most = total - 2 * -(-NUM * total // (NUM + DEN))
        small, large = np.minimum(n[part][:, None], n[y]), np.maximum(n[part][:, None], n[y])
        i, j = np.nonzero((label[part][:, None] != label[y][None, :]) & (small * DEN >= large * NUM))
        if not len(i):
            continue
        xs = _folded(np.stack([cells[c] for c in part]), words)
        near = np.zeros(len(i), bool)
        for cut in range(0, len(i), 4096):
            c = slice(cut, cut + 4096)
            near[c] = np.bitwise_count(xs[i[c]] ^ ys[j[c]]).sum(axis=1, dtype=np.int64) <= most[i[c], j[c]]
        if near.any():
            yield part[i[near]], y[j[near]]


def _read_blocks(batches):
    """Columns of ``_in_blocks`` as whole arrays, and the lists of the last column."""
    parts, lists = [], []
    for batch in batches:
        parts.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)])
        lists += _lists(batch.column(batch.num_columns - 1))
    return [np.concatenate(c) for c in zip(*parts, strict=True)], lists


def _near_members(batches):
    """Members of a task's groups that sizes and sketches leave near a member of another label, once per group."""
    columns, cells = _read_blocks(batches)
    if not cells:
        return
    key, block, within, level, group, kind, n, label = columns
    words = np.array([len(c) for c in cells])
    hit = np.zeros(len(cells), bool)
    for x, y, shorter in _block_pairs(key, block, kind, words, within):
        for i, j in _near(x, y, shorter, cells, n, label):
            hit[i] = hit[j] = True
    columns = [pa.array(c[hit]) for c in (level, group, kind, n, label)]
    yield pa.RecordBatch.from_arrays(columns, ["level", "group", "class", "n", "label"])


def _sets(batches):
    for batch in batches:
        out = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["class", "shingles"])


def _similar(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets ``others`` are similar enough to ``s``."""
    sizes = np.array([len(o) for o in others])
    values = np.concatenate(others)
    found = s[np.minimum(np.searchsorted(s, values), len(s) - 1)] == values
    shared = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return (shared > 0) & (DEN * shared >= NUM * (len(s) + sizes - shared))


def _link_blocks(batches):
    """Links of a task's groups, as many as join what they link: one that stays inside what others have joined is left out."""
    columns, sets = _read_blocks(batches)
    if not sets:
        return
    key, block, within, _, _, kind, n, label = columns
    label = label.copy()
    cells = [_sketch(s) for s in sets]
    words = np.array([len(c) for c in cells])
    links = []
    for x, y, shorter in _block_pairs(key, block, kind, words, within):
        for i, j in _near(x, y, shorter, cells, n, label):
            starts = np.flatnonzero(ws.firsts(i))
            for first, last in zip(starts, np.r_[starts[1:], len(i)], strict=True):
                a, others = i[first], j[first:last]
                others = others[label[others] != label[a]]
                if not len(others):
                    continue
                for b in others[_similar(sets[a], [sets[o] for o in others])]:
                    if label[a] != label[b]:
                        label[label == label[b]] = label[a]
                        links.append((kind[a], kind[b]))
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _in_blocks(groups: DataFrame, blocks: Column, lists: DataFrame) -> DataFrame:
    """``groups`` (``level``, ``group``, ``class``, ``n``, ``label``) split into pairs of so many blocks, with the list of each class; a pair of blocks (``key``) is in one task."""
    many = groups.groupBy("level", "group").agg(blocks.alias("blocks"))
    rows = groups.join(materialize(many, "blocks"), ["level", "group"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    key = F.xxhash64("level", "group", F.least("own", "other"), F.greatest("own", "other"))
    inner = (F.col("own") == F.col("other")).alias("inner")
    rows = rows.select(key.alias("key"), "own", inner, "level", "group", "class", "n", "label").join(lists, "class")
    rows = rows.select("key", "own", "inner", "level", "group", "class", "n", "label", lists.columns[1])
    return rows.repartition(blobs.partitions(groups), "key")


def _group_links(groups: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all classes of two labels that ``groups`` link.

    Pairs never become rows. Sketches leave the members that may have a link; those meet
    again with their sets, and a task gives fewer links than it has members.
    """
    blocked = _in_blocks(groups, F.ceil(F.count(F.lit(1)) / BLOCK), sketches.select("class", "sketch"))
    near = blocked.mapInArrow(_near_members, "level int, group bigint, class bigint, n bigint, label bigint")
    near = materialize(near.distinct(), "near")
    wanted = bloom.build(near.select("class").distinct().select(F.xxhash64("class")))
    sets = texts.where(wanted.might_contain(F.xxhash64("class"))).mapInArrow(_sets, "class bigint, shingles array<bigint>")
    blocked = _in_blocks(near, F.ceil(F.sum("n") / SHINGLES), sets)
    return materialize(blocked.mapInArrow(_link_blocks, "a bigint, b bigint"), "more")


def similar_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` (hash of the text), ``n_shingles``, ``class``, ``label`` (class of the component's classes) of every row of ``docs``.

    Null and empty texts have no shingles and no label. Rows with equal shingle
    sets share a class; ids may be null or repeated. Other columns are not read.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    read = keyed.select("doc", rows.body().alias("body"), "text")
    sizes = materialize(read.mapInArrow(_sizes, "doc bigint, body bigint, n_shingles bigint, class bigint"), "sizes")
    n = blobs.partitions(docs)
    index = docs.select("text").mapInArrow(_index(n), blobs.schema(3)).repartition(n, "bucket")
    found = materialize(index.mapInArrow(_candidates, "kind int, a bigint, b bigint, n bigint"), "candidates")

    least = F.min(F.struct("doc", "body")).alias("least")
    of = sizes.where("n_shingles > 0").groupBy("class").agg(least, F.first("n_shingles").alias("n"))
    of = materialize(of.select("class", "least.doc", "least.body", "n"), "classes")
    first = of.select(F.col("class").alias("a"), F.col("n").alias("na"))
    second = of.select(F.col("class").alias("b"), F.col("n").alias("nb"))
    summed = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    stars = materialize(summed.join(first, "a").join(second, "b"), "stars")
    inside = stars.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    repeated = sizes.groupBy("doc", "body").count().where("count > 1").limit(1).count() > 0
    texts = _texts(keyed, of.select("class", "doc", "body").join(inside, "class"), repeated)
    sketches = texts.mapInArrow(_sketches, "class bigint, n bigint, sketch array<bigint>")
    sketches = materialize(sketches, "sketches")

    likely = materialize(_not_ruled_out(stars.where(_close("na", "nb")).select("a", "b"), sketches), "likely")
    links = _linked(likely, texts)
    labels = components(links)

    strong = _clusters(stars).withColumnsRenamed({"node": "_node", "label": "whole"})
    named = of.join(labels, of["class"] == labels["node"], "left").drop("node").join(strong, F.col("class") == F.col("_node"), "left")
    named = named.select("class", "n", F.coalesce("label", "class").alias("label"), F.coalesce("whole", "class").alias("whole"))
    named = materialize(named, "named")
    member = found.where("kind = 1").select(F.col("a").alias("entry"), F.col("b").alias("class")).join(named, "class")
    member = materialize(member.select("entry", "class", "n", "label", "whole").distinct(), "member")
    groups = materialize(_open_groups(member, named), "open")
    labels = components(links.unionByName(_group_links(groups, sketches, texts)))
    return sizes.join(labels, sizes["class"] == labels["node"], "left").select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"),
        "body",
        "n_shingles",
        "class",
        F.when(F.col("n_shingles") > 0, F.coalesce("label", "class")).alias("label"),
    )


def _components(classed: DataFrame) -> DataFrame:
    """``label`` with its smallest id and, of that id, the smallest text hash."""
    first = F.min(F.struct("doc_id", "body"))
    whole = classed.where("label IS NOT NULL").groupBy("label")
    named = whole.agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "body"))), first).alias("first"))
    return materialize(named.select("label", "first.doc_id", "first.body"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links, its own included) of every row.

    Null ids are never the smallest unless a component has no other. Documents
    without words are their own component.
    """
    classed = materialize(similar_classes(docs), "classed")
    smallest = _components(classed).select("label", F.col("doc_id").alias("component"))
    joined = classed.join(smallest, "label", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; documents without words all stay."""
    classed = materialize(similar_classes(docs), "classed").where("label IS NOT NULL")
    first = _components(classed).select("label", F.col("doc_id").alias("first_id"), F.col("body").alias("first_body"))
    chosen = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("body") == F.col("first_body"))
    marked = materialize(classed.join(first, "label").select("doc_id", "body", chosen.alias("chosen")), "marked")
    copies = marked.where("chosen").groupBy("doc_id", "body").count().where("count > 1")
    return rows.once(rows.without(docs, marked.where("NOT chosen")), copies)
