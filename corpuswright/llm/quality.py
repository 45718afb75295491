"""Quality rules as weak supervision.

Rules vote keep, reject or abstain. How often each rule votes what on good and
on bad documents is estimated by expectation-maximisation without labels; the
posterior probability of being good then decides, instead of all rules having
to pass. Votes depend on a document alone, so the model only needs the counts of
vote patterns: at most ``3 ** len(RULES)`` rows, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as ws

#: Limits of the base rules, which come ahead of the votes.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Words whose absence is odd in prose of one of these languages.
COMMON = (
    "a an and are as at be by for from have in is it of on or that the this to was with you "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al como con del el ella en es los las más no o para por se su una y "
    "auf das dem den der die ein eine er es für ich im in ist mit nicht sich sie und von zu"
).split()

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CALL = np.zeros(256, bool)
_CALL[list(b"!?")] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80

#: Measures of a document, all counts.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_alpha", "n_digits", "n_calls", "n_common",
)

#: Rule: (name, share measured, reject when above, keep when at most). Documents without the base of the share abstain.
RULES = (
    ("symbols", "n_symbols", "n_words", 0.10, 0.03),
    ("same_lines", "n_dup_lines", "n_lines", 0.34, 0.10),
    ("repeats", "n_repeat_words", "n_words", 0.35, 0.15),
    ("capitals", "n_upper", "n_alpha", 0.50, 0.20),
    ("calls", "n_calls", "n_words", 0.20, 0.05),
    ("digits", "n_digits", "word_chars", 0.30, 0.10),
)
#: Two-sided rule: word length in code points; and rules on a share that must not be low.
LENGTH_KEEP, LENGTH_REJECT = (3.0, 9.0), (2.0, 14.0)
COMMON_KEEP, COMMON_REJECT = 0.04, 0.005
#: Common words say something only where letters are mostly Latin.
LATIN_SHARE = 0.5
N_RULES = len(RULES) + 2
#: What a rule is taken to be worth at least: it rejects no more than this share of the good documents.
FALSE_ALARMS = 0.02


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur at least twice in their document."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    grams = ws.grams(hashes, 3, 31)
    if not len(grams):
        return covered
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = ws.mix(grams[at] ^ ws.mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    found = at[twice]
    for j in range(3):
        covered[found + j] = True
    return covered


_common: np.ndarray | None = None


def _common_hashes() -> np.ndarray:
    global _common
    if _common is None:
        text = pa.array([" ".join(sorted({*COMMON, *map(str.capitalize, COMMON)}))])
        _, _, buf, offsets = next(ws.chunks(text))
        _common = np.sort(ws.split(buf, offsets).hash)
    return _common


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` per text."""
    out = np.zeros((len(column), len(MEASURES)), np.int64)
    common = _common_hashes()
    for a, b, buf, offsets in ws.chunks(column):
        found = ws.split(buf, offsets)
        heads = np.concatenate([[0], np.cumsum(_HEAD[buf])])
        in_words = np.concatenate([[0], np.cumsum(heads[found.end] - heads[found.start])])
        lines = np.zeros((b - a, 2), np.int64)
        for i in range(b - a):
            full = [x for x in buf[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
            lines[i] = len(full), len(full) - len(set(full))
        place = np.minimum(np.searchsorted(common, found.hash), len(common) - 1)
        values = {
            "n_words": np.diff(found.bounds),
            "word_chars": in_words[found.bounds[1:]] - in_words[found.bounds[:-1]],
            "n_symbols": _per_doc(_SYMBOL[buf], offsets),
            "n_dup_lines": lines[:, 1],
            "n_repeat_words": _per_doc(_repeated(found.hash, found.bounds), found.bounds),
            "n_lines": lines[:, 0],
            "n_upper": _per_doc(_UPPER[buf], offsets),
            "n_alpha": _per_doc(_ALPHA[buf], offsets),
            "n_digits": _per_doc(_DIGIT[buf], offsets),
            "n_calls": _per_doc(_CALL[buf], offsets),
            "n_common": _per_doc(common[place] == found.hash, found.bounds),
        }
        for j, name in enumerate(MEASURES):
            out[a:b, j] = values[name]
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of all rules: 1 keep, -1 reject, 0 abstain."""
    of = {name: m[:, j].astype(float) for j, name in enumerate(MEASURES)}
    out = np.zeros((len(m), N_RULES), np.int8)

    def share(part: str, whole: str) -> np.ndarray:
        return np.divide(of[part], of[whole], out=np.full(len(m), np.nan), where=of[whole] > 0)

    for j, (_, part, whole, reject, keep) in enumerate(RULES):
        s = share(part, whole)
        out[:, j] = np.where(s > reject, -1, np.where(s <= keep, 1, 0))
    length = share("word_chars", "n_words")
    keep = (length >= LENGTH_KEEP[0]) & (length <= LENGTH_KEEP[1])
    reject = (length < LENGTH_REJECT[0]) | (length > LENGTH_REJECT[1])
    out[:, -2] = np.where(reject, -1, np.where(keep, 1, 0))
    s = np.where(share("n_alpha", "word_chars") >= LATIN_SHARE, share("n_common", "n_words"), np.nan)
    out[:, -1] = np.where(s < COMMON_REJECT, -1, np.where(s >= COMMON_KEEP, 1, 0))
    return out


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``_q`` (all measures) and ``_votes`` (the vote pattern as a number in base 3) to every row."""
    kept = [c for c in docs.columns if c not in ("_q", "_votes")]
    at = kept.index(text)
    own = [i for i, c in enumerate(kept) if c != text or keep_text]
    fields = ", ".join(f"`{kept[i]}` {docs.schema[kept[i]].dataType.simpleString()}" for i in own)
    struct = "struct<" + ",".join(f"{n}:bigint" for n in MEASURES) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column(at))
            q = pa.StructArray.from_arrays([pa.array(m[:, j]) for j in range(len(MEASURES))], names=list(MEASURES))
            code = ((votes(m).astype(np.int64) + 1) * 3 ** np.arange(N_RULES)).sum(axis=1)
            names = [batch.schema.names[i] for i in own]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], q, pa.array(code)], [*names, "_q", "_votes"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, _q {struct}, _votes bigint")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    words = F.col("_q.n_words")
    return (words < LEAST_WORDS) | (100 * F.col("_q.n_repeat_words") > MOST_REPEATED_PERCENT * words)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of being good for each vote pattern.

    ``patterns`` holds votes (-1, 0, 1), ``counts`` how many documents have them.
    A document is good or has one kind of fault, and there is a kind for each
    rule, which that rule should see and the others may. An abstention says
    nothing. The vote probabilities of every rule in every class and the classes' shares are estimated together.
    A few made-up votes of the expected kind stay in the counts, so an unused
    rule is harmless, and no rule rejects more than ``FALSE_ALARMS`` of the good
    documents, so the classes cannot change places.
    """
    n = patterns.shape[1]
    seen = np.stack([patterns == v for v in (-1, 1)], axis=-1).astype(float)
    prior = np.tile([0.05, 0.95], (n + 1, n, 1))
    prior[0] = [0.005, 0.995]
    for rule in range(n):
        prior[rule + 1, rule] = [0.95, 0.05]
    chance = prior.copy()
    share = np.r_[0.8, np.full(n, 0.2 / n)]
    start = 10 * share
    good = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log(share)[None, :] + np.einsum("prv,yrv->py", seen, np.log(chance))
        logs -= logs.max(axis=1, keepdims=True)
        weight = np.exp(logs)
        weight /= weight.sum(axis=1, keepdims=True)
        moved = np.abs(weight[:, 0] - good).max(initial=0.0)
        good = weight[:, 0]
        if moved < 1e-9:
            break
        mass = np.einsum("py,prv->yrv", weight * counts[:, None], seen) + 10 * prior
        chance = mass / mass.sum(axis=2, keepdims=True)
        over = np.maximum(chance[0, :, 0] - FALSE_ALARMS, 0)
        chance[0] += np.stack([-over, over], axis=1)
        total = (weight * counts[:, None]).sum(axis=0) + start
        share = total / total.sum()
    return good


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept`` to rows of ``measure``; they should be a written table.

    Base rules reject at once (too few words is also what null and empty texts
    are). All other documents, repeats counted, give the model its vote patterns;
    those with a posterior of at least ``threshold`` are kept. An empty table
    gives no rows.
    """
    spark = measured.sparkSession
    rows = measured.withColumn("base_failed", base_failed())
    found = rows.where("NOT base_failed").groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).orderBy("_votes").collect()
    codes = np.array([r["_votes"] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(N_RULES)) % 3 - 1
    good = estimate(patterns, np.array([r["n"] for r in found], float))
    model = spark.createDataFrame(list(zip(codes.tolist(), good.tolist(), strict=True)), "_votes bigint, p_good double")
    judged = rows.join(F.broadcast(model), "_votes", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_good") >= threshold, F.lit(False)))
