"""Token counts by a map-side two-tier lookup.

Texts are cut into pre-tokens by the tokenizer's own pattern. A broadcast table
holds the lengths (in tokens) of the most frequent ones; what it lacks is encoded
once per worker and kept in a bounded cache. No pre-token occurrence is shuffled.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space (fixed values of that property).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Pre-tokens: a run without white space and the space ahead of it, or white space.
#: Byte-level BPE never merges across these borders, so each has a length of its own.
CUT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts with these characters, whose class libraries see differently, are encoded whole.
ODD = re.compile("[\\x1c-\\x1f\\x85\\u180e]")

#: Entries of the broadcast table, and of one task's summary it is made from.
FREQUENT = 1 << 17
SUMMARY = 1 << 15
#: Entries a worker's cache may hold before it is emptied.
CACHE = 1 << 19
#: Pre-tokens longer than this are never cached.
LONGEST = 64
#: Texts longer than this are cut into pre-tokens piece by piece.
LONG_TEXT = 1 << 20

MARKS = frozenset(".,;:!?")
LATIN = "\u0250"

_state: dict = {}

#: The pattern byte-level BPE applies before its merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(model: dict):
    """A faster encoder of the same merges, when ids follow the order of the merges; else none."""
    import tiktoken

    vocab, merges = model["vocab"], model["merges"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
    if any(vocab.get("".join(p)) != 256 + i for i, p in enumerate(pairs)):
        return None
    byte = _byte_alphabet()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tools(path: str):
    """The tokenizer, its special strings and the patterns, once per worker."""
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and split.get("type") == "ByteLevel"
        if not (plain and split.get("use_regex", True) and not split.get("add_prefix_space")):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        _state.clear()
        _state.update(
            path=path,
            tokenizer=Tokenizer.from_file(path),
            special=re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None,
            ranked=_ranked(spec["model"]),
            cache={},
        )
    return _state


def _pieces(text: str) -> Iterator[list[str]]:
    """Pre-tokens of a text without special strings, in pieces when it is long."""
    if len(text) <= LONG_TEXT:
        yield CUT.findall(text)
        return
    found = (m.group() for m in CUT.finditer(text))
    while chunk := list(itertools.islice(found, LONG_TEXT // 4)):
        yield chunk


def _sizes(pieces: list[str], tools) -> list[int]:
    """Tokens of pieces; the faster encoder takes those whose characters all libraries class alike."""
    ranked = tools["ranked"]
    if ranked is not None:
        alike = [p.isascii() or max(p) < LATIN for p in pieces]
        if all(alike):
            return [len(ranked.encode_ordinary(p)) for p in pieces]
    encoded = tools["tokenizer"].encode_batch_fast(pieces, add_special_tokens=False)
    return [len(e.ids) for e in encoded]


def _length(text: str, frequent: dict, tools) -> int:
    """Tokens of one text."""
    if ODD.search(text):
        return len(tools["tokenizer"].encode(text, add_special_tokens=False).ids)
    total, parts = 0, [text]
    if tools["special"] is not None and tools["special"].search(text):
        parts = tools["special"].split(text)
        total = len(parts) - 1
    cache = tools["cache"]
    for pieces in itertools.chain.from_iterable(map(_pieces, parts)):
        missing = []
        for piece in pieces:
            size = frequent.get(piece) or cache.get(piece)
            if size is None and piece[-1] in MARKS and len(piece) > 1 and piece[-2] < LATIN and piece[-2].isalpha():
                # a mark behind a letter is a pre-token of its own
                word, mark = frequent.get(piece[:-1]) or cache.get(piece[:-1]), frequent.get(piece[-1])
                size = word + mark if word and mark else None
            if size is None:
                missing.append(piece)
            else:
                total += size
        if missing:
            counts = Counter(missing)
            if len(cache) + len(counts) > CACHE:
                cache.clear()
            for (piece, n), size in zip(counts.items(), _sizes(list(counts), tools), strict=True):
                total += n * size
                if len(piece) <= LONGEST and len(cache) < CACHE:
                    cache[piece] = size
    return total


def _summary():
    """Each task's most frequent pre-tokens: counters are cut back to the larger half whenever they grow too long."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for pieces in _pieces(text or ""):
                    counts.update(pieces)
                if len(counts) > 8 * SUMMARY:
                    counts = Counter(dict(counts.most_common(2 * SUMMARY)))
        top = [(p, n) for p, n in counts.most_common(SUMMARY) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    return run


def frequent_lengths(texts: DataFrame, path: str) -> dict[str, int]:
    """Token lengths of the ``FREQUENT`` most frequent pre-tokens, from bounded summaries of all texts.

    The summaries are approximate, which only moves work between the table and
    the workers' caches, never a count.
    """
    summed = texts.mapInArrow(_summary(), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [*MARKS, *(r["piece"] for r in summed.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect())]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encoded = tokenizer.encode_batch(top, add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(top, encoded, strict=True)}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``) to every row of ``docs``.

    Null and empty texts count 0. ``path`` is a tokenizer file that every worker
    can read; without ``keep_text`` the text itself is left out. Columns of ``docs`` named like a result are replaced.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs.select(F.col(f"`{text}`")), path))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    if text not in kept:
        raise ValueError(f"the text column must not be named {text}")
    at = kept.index(text)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept if c != text or keep_text)

    def run(batches):
        tools = _tools(path)
        table = frequent.value
        for batch in batches:
            values = pc.fill_null(batch.column(at), "")
            tokens = pa.array([_length(v, table, tools) if v else 0 for v in values.to_pylist()], pa.int64())
            sizes = pc.binary_length(values).cast(pa.int64())
            own = [c for c in range(batch.num_columns) if c != at or keep_text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], sizes, tokens, pc.greater(tokens, limit)],
                [*[batch.schema.names[c] for c in own], "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(
        run, f"{fields}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
