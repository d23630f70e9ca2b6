"""Collocations against plain counting, and the quotient filter against what went in."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import collocations as co
from assay.llm import quotient_filter as qf
from llm_fixtures import edge, nothing  # noqa: F401

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, top):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = tuple(re.findall("[^ \t]+", piece))
            for m in range(1, 5):
                own.update(w[k:k + m] for k in range(len(w) - m + 1))
    for lang, f in sorted(counts.items()):
        n = sum(c for g, c in f.items() if len(g) == 1)
        long = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in long.items():
            for m in range(2, len(g)):
                for k in range(len(g) - m + 1):
                    longer[g[k:k + m]] = max(longer[g[k:k + m]], a)
        found = []
        for g, a in long.items():
            if 100 * longer[g] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, g.decode(), -a, l, r, n, -s


def listed(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).select(*COLS).collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    words = [*"abcdefghij", "Été", "über", "ÉTÉ", "x\x01y", "漢字", "A"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", ";", "!?", " \x1c "]
    common = "the usual words of it"
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choices(ends, weights=[12, 1, 1, *[0.4] * 8])[0] for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([t, t + common, f"{common} {t}", None, ""])))
    return out


@pytest.mark.parametrize("least,top,sizes", [(5, 2000, {}), (2, 50, {"block_bytes": 300, "shard": 16}), (1, 2000, {"block_bytes": 2000, "shard": 64})])
def test_phrases(spark, least, top, sizes):
    """Whatever the blocks and shards; ties at the last rank fall by the phrase's bytes."""
    rows = texts(least)
    df = spark.createDataFrame([(i, t, lang, 1, "b") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, block int, gram string")
    assert listed(df.repartition(4), least=least, top=top, **sizes) == sorted(brute(rows, least, top))


def test_edge_cases(spark, edge, nothing):  # noqa: F811
    rows = [(r["lang"], r["text"]) for r in edge.select("lang", "text").collect()]
    assert listed(edge, least=2) == sorted(brute(rows, 2, 2000))
    assert listed(nothing) == []
    assert listed(edge.withColumn("text", F.lit(None).cast("string"))) == []


def test_long_text_is_cut_at_no_phrase():
    text = ("one two three four. " * 40_000).encode()
    pieces = [*co._tokens(text)]
    assert len(pieces) > 1 and b" ".join(w for p in pieces for w in p) == b" ".join(text.replace(b".", b" \xff ").split())


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("bits", [1, 2, 7, 13, 17, 31, 32])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    p = qf.Packing(n, bits)
    words = [rng.integers(0, min(1 << bits, 50) if bits > 6 else 1 << bits, size=3000, dtype=np.uint64) for _ in range(n)]
    words[0][:100] = (1 << bits) - 1
    packed = p.pack(words)
    assert all((x == y).all() for x, y in zip(p.unpack(*packed), words))
    left, right = p.permute(*packed)
    assert all((x == y).all() for x, y in zip(p.invert(left, right), packed))
    x, y, counts, which = p.counted(left, right)
    expected = Counter(zip(*(w.tolist() for w in words)))
    grams = list(zip(*(w.tolist() for w in p.unpack(*p.invert(x, y)))))
    assert dict(zip(grams, counts.tolist())) == expected and (x[which] == left).all() and (y[which] == right).all()
    counts = counts + rng.choice([0, 254, 255, 256, 1 << 40], size=len(counts))
    for shard_bits in (0, min(3, p.half)):
        for s, a, z in co._shard_cuts(x, p.half - shard_bits):
            back = qf.read(qf.write(p, x[a:z], y[a:z], counts[a:z], shard_bits), s)
            assert all((u == v).all() for u, v in zip(back, (x[a:z], y[a:z], counts[a:z])))
    # merging two filters gives the filter of both
    both = p.counted(np.concatenate([x, x]), np.concatenate([y, y]), np.concatenate([counts, counts]))
    assert (both[0] == x).all() and (both[2] == 2 * counts).all()
