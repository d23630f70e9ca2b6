"""Brute-force versions of the operators."""

import base64
import hashlib
import math

import public_tokenizers as P
import tiktoken


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bpe(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        yield i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            yield i, keep, len(ids), sha(text)


def brute_passages(rows, size=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        yield i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))


def brute_groups(rows, n=5, percent=80, unnamed=False):
    """``unnamed``: rows without an id take part."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and (unnamed or None not in (rows[a][0], rows[b][0])) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    for k, (i, _) in enumerate(rows):
        yield i, len(sets[k]), None if i is None and not unnamed else least.get(find(k))


def brute_top_k(rows, every=100, k=10):
    use = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in rows
           if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    for q, v in use:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q)
            for rank, (s, i) in enumerate(scores[:k], 1):
                yield q, rank, i, -s
