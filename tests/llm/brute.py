"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(docs):
    """{doc_id: (shingles, component)} of unique ids."""
    sets = {k: shingles(t) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, s in sets.items():
        shared = collections.Counter(j for t in s for j in where[t])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for t in s:
            where[t].append(k)
    least = {}
    for k in sets:
        least[find(k)] = min(least.get(find(k), k), k)
    return {k: (len(s), least[find(k)]) for k, s in sets.items()}


def kept_words(docs):
    """{doc_id: (words, kept words)} after removing repeated 20-word windows; ids are unique."""
    seen, out = set(), {}
    for k, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out[k] = w, [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def quality(text):
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, benchmark):
    """[(id, words, hit words, items)] in the order of ``docs``."""
    windows = collections.defaultdict(set)
    for item, text in benchmark:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for k, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((k, len(w), len(hit), sorted(items)))
    return out
