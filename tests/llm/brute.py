"""Plain versions of the operators, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return PLAIN.findall(text or "")


def folded(text):
    return FOLDED.findall((text or "").translate(LOWER))


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def without_repeats(docs, n=13):
    """docs: (id, text); null ids come last.  Returns (id, n_words, n_removed, kept)."""
    rank = lambda i: float("inf") if i is None else i
    least = {}
    for i, text in docs:
        for w in windows(plain(text), n):
            least[w] = min(least.get(w, float("inf")), rank(i))
    out = []
    for i, text in docs:
        words = plain(text)
        gone = set()
        for at, w in enumerate(windows(words, n)):
            if least[w] < rank(i):
                gone.update(range(at, at + n))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def contaminated(docs, items, n=10):
    """(id, n_words, n_hit, items)."""
    grams = defaultdict(set)
    for item, text in items:
        words = folded(text)
        for w in windows(words, min(n, len(words))) if words else []:
            grams[w].add(item)
    sizes = {len(w) for w in grams}
    out = []
    for i, text in docs:
        words, hit, found = folded(text), set(), set()
        for size in sizes:
            for at, w in enumerate(windows(words, size)):
                if w in grams:
                    hit.update(range(at, at + size))
                    found |= grams[w]
        out.append((i, len(words), len(hit), sorted(x for x in found if x is not None)))
    return out


def shingles(text, n=5):
    words = folded(text)
    return frozenset(windows(words, min(n, len(words)))) if words else frozenset()


def linked(docs, threshold=0.8):
    """(id, class, links) of rows with ids."""
    sets = [(i, shingles(t)) for i, t in docs]
    n = len(sets)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                by[g].append(k)
    links = [0] * n
    for a in range(n):
        if sets[a][0] is None:
            continue
        shared = defaultdict(int)
        for g in sets[a][1]:
            for b in by[g]:
                shared[b] += 1
        for b, c in shared.items():
            if b != a and c >= threshold * (len(sets[a][1]) + len(sets[b][1]) - c):
                links[a] += 1
                parent[find(max(a, b))] = find(min(a, b))
    least = {}
    for k in range(n):
        if sets[k][0] is not None:
            r = find(k)
            least[r] = min(least.get(r, sets[k][0]), sets[k][0])
    return [(i, None if i is None else least[find(k)], links[k]) for k, (i, _) in enumerate(sets)]


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def mixed(docs, weights=(5, 2, 1), share=1.5, most=2, seed=17):
    """docs: (id, text, source).  {source: (size, target)} and [(id, size, copies)]."""
    sized = [(i, len(plain(t)), s) for i, t, s in docs]
    names = sorted({s for _, _, s in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(n for _, n, x in sized if x == s) for s in names}
    target, open_, left = {}, set(names), share * sum(size.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(most * size[s])
            left -= most * size[s]
        open_ -= over
    rows = []
    for s in names:
        mine = [r for r in sized if r[2] == s]
        expected = expected_copies([r[1] for r in mine], target[s], most)
        rest, so_far = target[s] - sum(int(e) * r[1] for e, r in zip(expected, mine)), 0

        def rank(pair):
            (i, _, _), e = pair
            u, part = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2**32, e - int(e)
            return (u / (1 - u) / (part / (1 - part)) if part > 0 else float("inf"), i)

        for r, e in sorted(zip(mine, expected), key=rank):
            more = rest > 0 and so_far + r[1] / 2 <= rest
            so_far += r[1]
            rows.append((r[0], r[1], (int(e) + more) if size[s] else 0))
    return {s: (size[s], target[s]) for s in names}, rows


def expected_copies(sizes, target, most=2):
    """min(most, level x class) for each size; the level is found by filling classes from the top."""
    classes = [min(63, 64 * n // (n + 100)) + 1 for n in sizes]
    full = set()
    while True:
        left = target - most * sum(n for n, k in zip(sizes, classes) if k in full)
        weight = sum(n * k for n, k in zip(sizes, classes) if k not in full)
        level = left / weight if weight else 0.0
        top = max((k for k in classes if k not in full), default=None)
        if top is None:
            return [float(most)] * len(sizes)
        if level * top <= most:
            return [min(float(most), level * k) for k in classes]
        full.add(top)


def nearest(vectors, queries, top=20):
    """vectors: {id: list}.  {query: [(score, id)]} nearest first."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        s = x @ np.array(vectors[q], np.float64)
        out[q] = sorted(((-v, i) for v, i in zip(s.tolist(), ids) if i != q))[:top]
    return out


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), character by character."""
    words, seen, dup = plain(text), set(), 0
    for line in (text or "").split("\n"):
        if plain(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k, w in enumerate(windows(words, 3)):
        at[w].append(k)
    again = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, dup, len(again), n < 50 or 100 * len(again) > 50 * n


def outside_bands(text, whole, chunks, size=1024, share=0.25, level=3):
    """Does compression reject the text?  One compressor per call, nothing shared."""
    import zstandard

    def out(part, bands):
        low, high = [b[1:] for b in bands if b[0] <= len(part)][-1]
        packed = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress(part)
        return not low <= len(packed) / len(part) <= high

    body = (text or "").encode()
    if not body:
        return False
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    bad = sum(len(p) for p in parts if len(parts) > 1 and out(p, chunks))
    return out(body, whole) or bad > share * len(body)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(nodes, fanout=3):
    """Root of a list of digests, and per node the siblings of each level as (left, right) texts."""
    at, level, paths = list(range(len(nodes))), list(nodes), [[] for _ in nodes]
    while len(level) > 1:
        for k, path in enumerate(paths):
            i = at[k]
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        level = [_sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def manifest(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, path), sorted as texts."""
    groups = defaultdict(list)
    for row in rows:
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        groups[row[1]].append(((row[0] is not None, row[0] or 0, _sha("".join(parts))), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[0])
        trees[s] = merkle([leaf for (_, _, leaf), _ in groups[s]], fanout)
    root, tops = merkle([trees[s][0] for s in names], fanout) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for ((_, _, leaf), i), path in zip(groups[s], trees[s][1]):
            out.append((str(i), leaf, trees[s][0], root, str(path + top)))
    return sorted(out)


def phrase_counts(rows, longest=4):
    """rows: (text, lang) -> {(lang, words): occurrences}; the empty phrase once per word."""
    f = defaultdict(int)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(longest + 1):
                for i in range(len(words) - max(k, 1) + 1):
                    f["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    return f


def collocations(rows, least=30, drop=80, top=2000):
    f = phrase_counts(rows)
    often = [(lang, w, a) for (lang, w), a in f.items() if len(w) >= 2 and a >= least]
    around = defaultdict(int)
    for lang, w, a in often:
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    around[lang, w[i:j]] = max(around[lang, w[i:j]], a)
    kept = defaultdict(list)
    for lang, w, a in often:
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * around[lang, w] < drop * a:
            kept[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, f[lang, ()], -score)
        for lang, found in kept.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )
