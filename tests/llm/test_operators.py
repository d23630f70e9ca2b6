"""Each operator against a brute-force version, and on its edge cases."""

import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from assay.llm import (bpe, components, exact_dedup, jaccard_join, language_id, main_text, packing, pretokens,
                       repeated_passages, token_output, topk, urls)
from assay.llm.catalog import ORACLE_SQL
from llm_fixtures import documents, edge, nothing  # noqa: F401
from llm_brute import (brute_bpe, brute_dedup, brute_groups, brute_passages, brute_top_k)

SF = "/root/testdata/sf0.001"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def listed(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


# ---- byte-level BPE

def test_pieces_and_ids_equal_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own, lib = bpe.bpe(RANKS), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = [*"ab'strevlmd  \n\t1 2!?.é漢字🙂'S᳏0", "'s", "'re", "'ll", "  ", "\r\n", "\x1c", "\x85", chr(0x10D4A)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, "!" * 999 + "'s", " " * 999 + "x", "ab" * 5000, "<|endoftext|>"]
    got = own.encode_batch(texts)
    assert got == [lib.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in got] == texts
    assert "".join(pretokens.cut([texts[0]]).words[k] for k in pretokens.cut([texts[0]]).which) == texts[0]
    assert own.offsets(got[5])[-1] == len(texts[5].encode())


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(pretokens, "_powers", lambda base, n: np.zeros(n, np.uint64))
    cps = np.array([97, 98, 97, 99], np.uint32)
    first, which = pretokens.distinct(cps, np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4]))
    assert which.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_bpe_query(spark, edge, nothing):
    cols = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert listed(bpe.bpe_digest(edge, RANKS), *cols) == sorted(brute_bpe(pairs(edge)), key=repr)
    assert bpe.bpe_digest(nothing, RANKS).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(edge, RANKS), RANKS)
    assert listed(back, "doc_id", "text") == sorted([(i, bytearray((t or "").encode())) for i, t in pairs(edge)], key=repr)


# ---- exact dedup

@pytest.mark.parametrize("size", [3, 64, exact_dedup.BLOCK_BYTES])
def test_exact_dedup(edge, nothing, size):
    got = exact_dedup.exact_duplicates(edge, size)
    assert listed(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute_dedup(pairs(edge)), key=repr)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({x[3] for x in brute_dedup(pairs(edge))})
    assert exact_dedup.exact_duplicates(nothing, size).count() == 0


def test_exact_dedup_takes_another_seed_when_keys_clash(edge, monkeypatch):
    real = exact_dedup._block_key
    monkeypatch.setattr(exact_dedup, "_block_key", lambda b, seed: [k % 2 if seed == 0 else k for k in real(b, seed)])
    got = exact_dedup.exact_duplicates(edge, 64)
    assert listed(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(brute_dedup(pairs(edge)), key=repr)


# ---- language ID

def test_language_id(spark, edge, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs)
    got = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    own = {(r.doc_id): r for r in language_id.identify(edge, net).collect()}
    assert [own[k].lang_pred for k in (1, 2, 3, 14)] == ["und"] * 4 and own[1].score == 0.0
    assert all(0 <= r.score <= 1 for r in own.values()) and own[8].lang_pred != "und"
    assert language_id.identify(nothing, net).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge, language_id.fit(nothing)).collect()} == {"und"}


# ---- substring dedup

def test_rows_of_one_id_spread_over_blocks(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(i, f"{' '.join(rng.choice('abcdefgh') * 3 for _ in range(30))} {passage if k % 5 == 0 else k}")
            for k in range(200) for i in (None, 7, 100 + k)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeated_passages.remove_repeats(df, block_bytes=4000).withColumn("at", F.spark_partition_id()).persist()
    assert listed(out, "doc_id", "n_words", "n_removed") == sorted([x[:3] for x in brute_passages(rows)], key=repr)
    assert max(r["count"] for r in out.groupBy("at").count().collect()) < 150  # of 600 rows, 200 of each id


def test_repeated_passages(spark, edge, nothing, documents):
    for rows, df in ((pairs(edge), edge), (documents, spark.read.parquet(f"{SF}/documents.parquet"))):
        got = listed(repeated_passages.repeat_digest(df), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(brute_passages(rows), key=repr)
    assert repeated_passages.repeat_digest(nothing).count() == 0
    small = repeated_passages.remove_repeats(edge, block_bytes=500)
    assert listed(small, "doc_id", "n_words", "n_removed") == sorted([x[:3] for x in brute_passages(pairs(edge))], key=repr)
    clean = {r.doc_id: r.text for r in repeated_passages.remove_repeats(edge, leave_clean=True).collect()}
    assert clean[3] == "   \n\t " and clean[1] is None and clean[12] != dict(pairs(edge))[12]


def test_automata_in_shards(monkeypatch):
    words = np.arange(100, dtype=np.uint64) % np.uint64(40)
    places = np.arange(30)
    whole = repeated_passages.occurrences(words, 95, places)
    monkeypatch.setattr(repeated_passages, "SHARD", 4)
    assert (repeated_passages.occurrences(words, 95, places) == whole).all() and whole.sum() > 60


# ---- n-gram Jaccard join

def random_documents(seed, n=160):
    rng = random.Random(seed)
    out = []
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 70))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
        out.append((i, " ".join(w)))
    return out


def test_frequent_hashes_stand_last():
    rng = np.random.default_rng(1)
    data = rng.zipf(1.3, 20_000).astype(np.uint64)
    held, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in np.array_split(data, 10):
        held, count = jaccard_join.summary(np.concatenate([held, part]), np.concatenate([count, np.ones(len(part), np.int64)]), 50)
        assert len(held) <= 50 and (held[1:] > held[:-1]).all()
    values, true = np.unique(data, return_counts=True)
    true = dict(zip(values.tolist(), true.tolist()))
    assert all(v in held for v, n in true.items() if n > len(data) / 50)
    assert all(n <= true[v] for v, n in zip(held.tolist(), count.tolist()))
    s = np.array([1, 3, 5, 7], np.uint64)
    assert jaccard_join.ordered(s, np.array([3, 4, 7], np.uint64)).tolist() == [1, 5, 3, 7]
    assert jaccard_join.ordered(s, s[:0]).tolist() == s.tolist()
    assert len(jaccard_join.summary(data[:0], count[:0])[0]) == 0


def test_jaccard_groups(spark, edge, nothing, documents, monkeypatch):
    cols = ("doc_id", "n_shingles", "component_id")
    assert listed(jaccard_join.jaccard_groups(spark.read.parquet(f"{SF}/documents.parquet")), *cols) == sorted(brute_groups(documents), key=repr)
    assert listed(jaccard_join.jaccard_groups(edge), *cols) == sorted(brute_groups(pairs(edge)), key=repr)
    assert jaccard_join.jaccard_groups(nothing).count() == 0
    rows = random_documents(5)
    for small, square in ((64, 8192), (2, 3)):  # the second sends all tiles through bands and squares
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "SQUARE", square)
        got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert listed(got, *cols) == sorted(brute_groups(rows), key=repr)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        a, b = (np.frombuffer(jaccard_join.bitmap(s), np.uint64) for s in (x, y))
        w = min(len(a), len(b))
        differing = int(np.bitwise_count(jaccard_join.fold(a[None], w) ^ jaccard_join.fold(b[None], w)).sum())
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differing) / 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, 300 + i) for i in range(1, 60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == find(x) for x in parent)


# ---- URL filter

def test_url_filter(spark):
    rows = ["http://example.org/es/1", "https://a.example.org/en/12", "http://x.org", "http://x.org/", "http://b.com/fr/x?q=/de/",
            "http://b.com/de/x", "http://B.COM/de/#a", "http://www.cheap-pills.example.com/en/1", "http://b.com/en/1", None, "",
            "b.com/de/", "http://badexample.org/es/1", "ftp://example.org/en/1", "http://b.com/DE/", "http://b.com:80/de/", "http://b.com/de/" + "x" * 70_000]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(rows)], "page_id long, url string, host int")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    for i, u in enumerate(rows):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
            host, _, tail = rest.partition("/")
            host, path = host.lower(), "/" + tail if "/" in rest else ""
        fit = [r for r in urls.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name)
        if best:
            assert got[i].verdict == best.verdict
    assert got[7].verdict == "block" and got[8].verdict == got[9].verdict == "allow"
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_rules_are_filed_under_a_token_that_each_match_holds():
    assert urls._literals(urls.HostRule("example.org", "/en/1", "block")) == {"example", "org", "en"}
    index = urls.RuleIndex(urls.HOST_RULES, {"org": 9, "example": 5, "en": 1, "es": 0, "com": 9, "fr": 3, "de": 2})
    assert {t: len(r) for t, r in index.under.items()} == {"org": 1, "es": 1, "en": 1, "fr": 1, "de": 1}


# ---- packing and token output

def tokens_of(rows):
    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    return [lib.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]


def test_packing(spark, edge, nothing, documents):
    for rows, df in ((pairs(edge), edge), (documents, spark.read.parquet(f"{SF}/documents.parquet"))):
        got = packing.pack_documents(df, JSON).collect()
        want = {}
        for (i, _), ids in zip(rows, tokens_of(rows), strict=True):
            want.setdefault(i, []).append(ids)
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
            assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                       for x in want[r.doc_id])
        assert max(ends.values()) <= 2048 and sum(ends.values()) == sum(len(x) for xs in want.values() for x in xs)
    assert packing.pack_documents(nothing, JSON).count() == 0


def test_added_tokens_of_texts(spark, tmp_path):
    lib, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}  x\n", f"one two  {end}", "", "<|endoftext|", f"{end} word's {end}\n\n{end}", "plain text"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    flat, bounds = packing.tokenizer(JSON).encode_flat(texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack_documents(df, JSON).collect():
        ids = want[r.doc_id] + [1]
        assert r.doc_tokens == r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r.doc_id: list(r.ids) for r in token_output.unpack_windows(token_output.packed_windows(df, JSON)).collect()} == \
        {k: x + [1] for k, x in enumerate(want)}


def test_tree_finds_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 700, 300)
    rooms, want = [], {}
    number = 0
    for d in sorted(range(300), key=lambda d: (-(lengths[d] % 100), d)):
        for k in range(int(lengths[d]) // 100):
            want[d, k * 100] = 100
        if n := int(lengths[d]) % 100:
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is not None:
                rooms.remove(fit)
            else:
                number += 1
            rooms.append((100 if fit is None else fit) - n)
            want[d, int(lengths[d]) // 100 * 100] = n
    got = packing.pack(lengths, 100)
    assert {(d, s): n for d, s, n, _, _ in got} == want
    full = sum(int(x) // 100 for x in lengths)
    assert len({w for *_, w, _ in got}) == full + number
    assert packing.CapacityTree(16).least(1) == -1


def test_token_output_round_trip(spark, edge, nothing):
    windows = token_output.packed_windows(edge, JSON)
    got = {}
    for r in sorted(token_output.unpack_windows(windows).collect(), key=lambda r: r.start):
        got.setdefault((r.doc_id), []).append((r.start, list(r.ids)))
    for (i, t), ids in zip(pairs(edge), tokens_of(pairs(edge)), strict=True):
        if [x for x, _ in pairs(edge)].count(i) == 1:
            assert [x for _, part in got[i] for x in part] == ids
    for r in windows.collect():
        cu, pos = np.frombuffer(r.cu_seqlens, "<i4"), np.frombuffer(r.position_ids, "<u2")
        assert cu[0] == 0 and cu[-1] == r.n_tokens <= 2048 and len(cu) == r.n_segments + 1 and len(r.ids) == 4096
        assert all((pos[a:b] == np.arange(b - a)).all() for a, b in zip(cu, cu[1:]))
    assert token_output.packed_windows(nothing, JSON).count() == 0


# ---- exact top-k

def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(float).tolist(), 0) for i in range(900)]
    rows += [(1000 + i, [1.0, 0.5, 0.25, 0.0, 0.0, 1.0], 0) for i in range(300)]             # ties
    rows += [(2000, None, 0), (2100, [1.0, None], 0), (2200, [math.nan] * 6, 0), (2300, [math.inf] * 6, 0), (2400, [3.0], 0),
             (None, [1.0], 0), (2500, [], 0), (2600, [3e5] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = listed(topk.top_k(df.repartition(3)), "query_id", "rank", "vec_id", "score")
    assert got == sorted(brute_top_k(rows), key=repr)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 1, 2)"), k=10).count() == 2


def test_top_k_of_large_components_and_repeated_ids(spark):
    rows = [(i, [float(i % 7 - 3), 0.5, -2.0]) for i in range(40)]
    rows += [(100, [1e307, 1.0, 0.0]), (101, [1e307, 0.0, 0.0]), (102, [-1e307, 1.0, 0.0]), (103, [1e12, 1e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def whole(x):
        return [int(Fraction(v) * 1024 // 1) for v in x]

    def brute(queries):
        for i, q in queries:
            scored = sorted((-min(max(sum(a * b for a, b in zip(whole(q), whole(v))), -2 ** 63), 2 ** 63 - 1), j) for j, v in rows if j != i)
            yield from ((i, r, j, -s) for r, (s, j) in enumerate(scored[:3], 1))

    asked = [(i, v) for i, v in rows if i % 50 == 0]
    got = listed(topk.top_k(df.repartition(4), every=50, k=3), "query_id", "rank", "vec_id", "score")
    assert got == sorted(brute(asked), key=repr)
    # a query's id in two rows: k ranks for each row
    rows += [(0, [5.0, 5.0, 5.0]), (0, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = listed(topk.top_k(df.repartition(4), every=50, k=3), "query_id", "rank", "vec_id", "score")
    assert got == sorted(brute([(i, v) for i, v in rows if i % 50 == 0]), key=repr)


def test_top_k_sends_no_vectors_through_the_driver(spark, monkeypatch):
    """Every step's plan: nothing is broadcast and no query is copied for the lanes, small as the files look."""
    plans, put = [], topk.written

    def seen(df, what):
        plans.append(df._jdf.queryExecution().toString())
        return put(df, what)

    monkeypatch.setattr(topk, "written", seen)
    rows = [(i, [float(i % 7 - 3), 0.5, -2.0], 0) for i in range(400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3))
    plans.append(got._jdf.queryExecution().toString())
    assert len(plans) >= 3 and any("mapInArrow" in p or "MapInArrow" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p or "Generate" in p]
    assert listed(got, "query_id", "rank", "vec_id", "score") == sorted(brute_top_k(rows), key=repr)


def test_top_k_of_floats_and_many_parts_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).astype(np.float32).astype(float).tolist(), 0) for i in range(300)]
    rows += [(300, [], 0), (301, [3.0e38] * 5, 0), (302, [math.inf], 0), (400, [], 0), (None, [1.0], 0), (500, None, 0), (600, [1.5], 0)]

    def held(s):
        return min(max(s, topk.LEAST), topk.GREATEST)

    brute = list(brute_top_k(rows, every=20))
    scored = {(q, v): s for q, _, v, s in brute_top_k(rows, every=20, k=len(rows))}
    want = []
    for q in {q for q, *_ in brute}:
        best = sorted((-held(s), v) for (o, v), s in scored.items() if o == q)[:10]
        want += [(q, r, v, -s) for r, (s, v) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    for limit in (1 << 20, 64):
        monkeypatch.setattr(topk, "QUERY_BYTES", limit)
        assert listed(topk.top_k(df, every=20), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    empty = spark.createDataFrame([(i, [], 0) for i in range(5)], "vec_id long, embedding array<float>, rank int")
    assert listed(topk.top_k(empty, every=4, k=2), "query_id", "rank", "vec_id", "score") == sorted([(0, 1, 1, 0), (0, 2, 2, 0), (4, 1, 0, 0), (4, 2, 1, 0)], key=repr)


# ---- main text

PAGES = {
    "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class=ad>Buy "
    "now, a very long advert that says a lot of things to all of you, for ever and ever.</div><article><h1>Head &amp; line</h1><p><b>One "
    "two.<br><p>Short.<p>A longer\n  paragraph&nbsp;here</p><aside>Side</aside><div class='comments'><p>Nice!</p></div></article>"
    "<footer>&copy; me</footer>": "Head & line One two. Short. A longer paragraph here",
    "": "", None: "", "<p>only": "only", "<nav>x</nav>": "", "plain &lt;b&gt; text": "plain <b> text",
    "<body><header><h1>Site</h1></header><div id=main><p>" + "word " * 50 + "</p><p>End.</p></div><form><p>Sign in</p></form>": "word " * 50 + "End.",
}


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text.extract_main_text(df).collect()}
    for i, want in enumerate(PAGES.values()):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), f"u{i}")
    assert main_text.extract_main_text(df.limit(0)).count() == 0


STORY = "<h1>Head</h1><p>" + "word " * 30 + "</p><p>Short.</p><p>" + "other " * 30 + "end.</p>"
TOLD = " ".join(("Head " + "word " * 30 + "Short. " + "other " * 30 + "end.").split())


@pytest.mark.parametrize("names", ["layout has-sidebar", "no-sidebar", "menu-closed", "ad-free", "nav-open", "page-with-banner", "page sidebar"])
def test_marks_of_wrappers_drop_no_article(names):
    menu, ad = '<div class="menu"><a href=x>Home</a> <a href=y>About us</a></div>', '<div class="ad">Buy now, all of it.</div>'
    for page in (f'<div class="{names}">{menu}<article>{STORY}</article>{ad}</div>', f'<div class="{names}">{menu}<main>{STORY}</main>{ad}</div>',
                 f'<div id="{names}">{menu}<div>{STORY}</div>{ad}</div>'):
        assert main_text.main_text(f"<html><body>{page}</body></html>") == TOLD


def test_marks_of_articles():
    posts = "".join(f'<article class="post comments-open" id="post-{k}">{STORY}</article>' for k in range(3))
    assert main_text.main_text(f"<body>{posts}</body>") == " ".join([TOLD] * 3)
    comments = "".join(f'<article class="comment-body">Nice {k}, says a reader at some length here.</article>' for k in range(30))
    for around in ('<div class="comments">%s</div>', "%s", '<section class="comments-open">%s</section>'):
        assert main_text.main_text(f"<body><article>{STORY}</article>{around % comments}</body>") == TOLD
    assert main_text.main_text(f'<body><article>{STORY}<div class="related"><article>A card of another story.</article></div></article></body>') == TOLD
    links = '<a href=x>One thing and another</a> ' * 20
    assert main_text.main_text(f'<body><div class="menu-open">{links}</div><div class="related"><article>{links}</article></div><article>{STORY}</article></body>') == TOLD
    assert main_text.main_text('<body><div class="ad">Buy now, all of it, today.</div></body>') == ""


def test_region_keeps_all_content():
    def told(page):
        return main_text.main_text(f"<html><body>{page}</body></html>")

    card = "<article><p>A card that tells of another story, in a line of some length.</p></article>"
    assert told(f"<div>{STORY}</div>{card}") == TOLD + " A card that tells of another story, in a line of some length."
    small = "<p>" + "small " * 20 + "end.</p><p>Bye.</p>"
    for tag in ("article", "section"):  # under a fifth and under a tenth of the content
        for times in (1, 8):
            got = told(f"<{tag}>{STORY * times}</{tag}><{tag}>{small}</{tag}>")
            assert got == " ".join([TOLD] * times + ["small " * 20 + "end. Bye."])
    intro = "An introduction before the article, one line of some length."
    assert told(f"<div><p>{intro}</p><p>By X.</p></div><article>{STORY * 5}</article>") == " ".join([intro, "By X."] + [TOLD] * 5)
    assert told(f"<p>{intro}</p><article>{STORY * 5}</article>") == " ".join([intro] + [TOLD] * 5)


# ---- registration

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.project(", ".join(cols)).fetchall()))


def test_one_query_of_each_operator():
    names = list(E.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def told(page):
    return main_text.main_text(f"<html><body>{page}</body></html>")


def test_forms_are_judged_by_what_they_hold():
    menu = "<nav><a href=x>Home</a></nav>"
    for page in (f"<form id=f>{menu}<div>{STORY}</div><label>Name</label><input></form>", f"<form>{menu}<article>{STORY}</article></form>",
                 f"<article>{STORY}</article><form><p>Your mail</p><p>Sign up for our letter</p></form>",
                 f"<article>{STORY}<form><p>Your mail</p><p>Sign up</p></form></article>"):
        assert told(page) == TOLD
    assert told("<form><label>Name</label><label>Password</label></form>") == ""


def test_compound_names_of_comments_and_adverts():
    said = "A remark of some length, as long as a line of a story tends to be. " * 3
    for mark in ('ul id="commentlist"', 'section class="reader-responses"', 'div class="userComments"', 'div id="replies"', 'div class="adsbygoogle"',
                 'ins class="adsbygoogle"', 'div class="googleAdSlot"', 'div id="leftSideBar"', 'div class="sitefooter"'):
        tag = mark.split()[0]
        assert told(f"<article>{STORY}</article><{mark}><p>{said}</p></{tag}>") == TOLD
        assert told(f"<article>{STORY}<{mark}>{said}</{tag}></article>") == TOLD
    for kept in ("commentary", "subscript", "downloads", "threads", "survey-responses"):
        assert told(f'<article>{STORY}<div class="{kept}">{said}</div></article>') == f"{TOLD} {said.strip()}"


def test_menus_and_notices_at_the_ends():
    links = "<a href=x>Home</a> | <a href=y>About us and all of our work</a>"
    for before, after in ((f'<div id="bar">{links}</div>', ""), ("", f"<ul><li>{links}<li>{links}</ul>"), ("", "<p>Copyright 2020 by me</p>"),
                          ("", '<div id="bottom">All rights reserved.</div>'), (f"<p>{links}</p>", f"<p>{links}</p><p>© 2020 A. N. Author</p>")):
        assert told(f"{before}<article>{STORY}</article>{after}") == told(f"{before}<div>{STORY}</div>{after}") == TOLD
    one = "<p><a href=x>A long line that is one link, with a text as long as that of a line of the story</a></p>"
    assert told(f"<div>{STORY}{one}</div>").startswith(TOLD) and "one link" in told(f"<div>{STORY}{one}</div>")
    assert told(f"<article>{STORY}<p>{links}</p></article>") == TOLD + " Home | About us and all of our work"
    law = "Copyright law of 1998 changed all of that, and it has been so ever since, says the author of it."
    assert told(f"<div>{STORY}<p>{law}</p></div>") == f"{TOLD} {law}"
    assert told("<p>© 2020 me</p>") == "© 2020 me"


def test_headings_of_an_article_header():
    for head in ("<h1>Head</h1>", "<div><h1>Head</h1><p>By me</p></div>", "<nav><h2>Menu</h2></nav><h1>Head</h1>"):
        assert told(f"<article><header>{head}</header>{STORY}</article>") == f"Head {TOLD}"
        assert told(f"<header>{head}</header><article>{STORY}</article>") == TOLD


def test_deep_and_broken_pages_take_memory_in_proportion():
    import time
    import tracemalloc
    for page, n in (("<div>word " * 60_000, 300_000 - 1), ("<div>" * 5_000 + "</p>" * 20_000 + "x", 1), ("a <!-- b " * 20_000, 180_000 - 1),
                    ("<ul>" + "<div>" * 5_000 + "<li>x</li>" * 20_000, 40_000 - 1)):
        start = time.monotonic()
        tracemalloc.start()
        assert len(main_text.main_text(page)) == n
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 * len(page) and time.monotonic() - start < 30


def test_repeated_pages_give_repeated_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{STORY}</article>")] * 3 + [(None, None, None)], "page_id long, url string, html string")
    got = sorted(main_text.extract_main_text(df.repartition(2)).collect(), key=lambda r: r.n_chars)
    assert [(r.page_id, r.text) for r in got] == [(None, "")] + [(1, TOLD)] * 3


def test_store_of_pretokens_is_emptied_without_loss(monkeypatch):
    own = packing.tokenizer(P.path("byte_bpe_50k.json")).own
    texts = [" ".join(f"word{i}x{i * k} {'y' * 40}{i}" for i in range(60)) for k in range(1, 6)]
    whole = [own.encode(t) for t in texts]
    own._forget()
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 100)
    monkeypatch.setattr(bpe, "STORED_IDS", 50)
    assert [own.encode(t) for t in texts] == whole and len(own.known) <= 200
    assert [own.decode(x).decode() for x in whole] == texts
