"""MinHash near-duplicates against all pairs, and the parts of the sketch."""

import random

import numpy as np
import pytest

from assay.llm import near_dups
from assay.llm.words import word_hashes
from llm_brute import brute_groups
from llm_fixtures import documents, edge, nothing  # noqa: F401

COLS = ("doc_id", "n_shingles", "component_id", "kept")


def listed(df):
    return sorted([tuple(r) for r in df.select(*COLS).collect()], key=repr)


def expected(rows):
    return sorted([(i, n, c, i == c) for i, n, c in brute_groups(rows, n=2, unnamed=True)], key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_edge_cases(spark, edge, nothing):  # noqa: F811
    assert listed(near_dups.near_duplicates(edge)) == expected(pairs(edge))
    assert listed(near_dups.near_duplicates(nothing)) == []


def test_documents(spark, documents):  # noqa: F811
    assert listed(near_dups.near_duplicates(frame(spark, documents))) == expected(documents)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    """Chains, of which the least document links with few, sets near the threshold, and groups
    of which many share most words without a link."""
    rng = random.Random(seed)
    rows = []
    for _ in range(8):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 400)) for _ in range(rng.choice([5, 6, 12, 60, 200]))]
        for _ in range(12):
            rows.append((rng.randint(0, 10_000), " ".join(words)))
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 10**6))
    shared = [f"s{k}" for k in range(70)]
    rows += [(20_000 + k, " ".join(shared + [f"own{k}x{j}" for j in range(15)])) for k in range(40)]
    rows += [(None, rows[0][1] + " more")]
    assert listed(near_dups.near_duplicates(frame(spark, rows))) == expected(rows)


def test_unlike_words_stay_apart(spark):
    """Words that have equal polynomial hashes modulo 2^64 for every odd base."""
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, a + " x"), (2, b + " x")]
    assert listed(near_dups.near_duplicates(frame(spark, rows))) == expected(rows)
    assert len(set(word_hashes([a.encode(), b.encode()])[0].tolist())) == 2


def test_sketch_agrees_as_often_as_the_sets(spark):
    """Bins agree in a share near the similarity, for small sets as for large ones; both ways
    to fill empty bins give the same rows."""
    bands = near_dups.Bands()
    rng = np.random.default_rng(3)
    for size in (5, 15, 40, 2000):
        both = rng.integers(0, 1 << 63, size=(60, size), dtype=np.uint64) * np.uint64(2)
        cut = size // 5
        share = []
        for s in both:
            x, y = np.sort(s), np.sort(s[cut:])
            out = bands.sketch(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            share.append((out[0] == out[1]).mean())
        assert abs(np.mean(share) - (size - cut) / size) < 0.06
    x = np.sort(rng.integers(0, 1 << 63, size=12, dtype=np.uint64) * np.uint64(2))
    few = bands.sketch(x, np.array([0, len(x)]))[0]
    place = (((x >> np.uint64(32)) * np.uint64(bands.bins)) >> np.uint64(32)).astype(int)
    full = {}
    for p, v in zip(place.tolist(), x.tolist()):
        full.setdefault(p, v)
    slow = [full[i] if i in full else next(full[j] for j in bands.turn[:, i].tolist() if j in full) for i in range(bands.bins)]
    assert few.tolist() == slow


def test_words_of_all_sizes_are_told_apart():
    words = [b"x" * k for k in range(1, 40)] + [b"\0" * k for k in range(1, 20)] + [b"abcdefgh" + b"\0" * k for k in range(12)]
    words += [b"w%d" % k for k in range(200_000)] + [bytes([c]) for c in range(256) if c not in (9, 10, 11, 12, 13, 32)]
    words = [*dict.fromkeys(words)]
    found, bounds = word_hashes([b" \t".join(words), b"", b" w7 "])
    assert bounds.tolist() == [0, len(words), len(words), len(words) + 1]
    assert len(set(found.tolist())) == len(words) and found[words.index(b"w7")] == found[-1]
    assert word_hashes([])[1].tolist() == [0] and word_hashes([b""])[0].tolist() == []
