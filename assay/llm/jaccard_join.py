"""Exact n-gram Jaccard join and its connected groups.

A document is the set of its distinct runs of ``N`` words, kept as sorted 64-bit hashes.
Documents that could reach the threshold share one of the first hashes of their sets
(prefix filter), so documents meet in tiles: one hash and one band of sizes. Hashes are
ordered by value, but the most frequent of the corpus stand last: a passage that many
documents share seldom makes a tile, and a group of copies makes few. Which hashes these
are changes the cost, never the links. Each document
also has a hashed bitmap, a power of two of bits wide. The bits in which two bitmaps
differ bound the size of the symmetric difference from below, and so the overlap from
above; pairs that pass are decided by intersecting their sorted arrays.

A tile is never expanded into all its pairs. First each document is compared with the
hub of each of its tiles (the document in most tiles: of a text and its many near copies
the text itself), and links found so far are merged into components. Then only
tiles that still hold several components are compared, between components, with bitmaps in
the task, in squares of bounded size; only pairs that pass the bound leave it. So a group
of thousands of near copies costs a star, not a square.

Defined cases: texts without words (null, empty, white space) have no shingles and link with
nothing; texts of fewer than N words have one shingle, the whole sequence; identical sets
are linked through one representative; rows that repeat a doc_id are rows of their own; a
row without doc_id gets a null component and takes no part; an empty table gives an empty
result. Hashes are 64 bits wide, made of BLAKE2b hashes of the words: two different shingles
of one pair of documents agree by chance with odds of about (shingles of one * shingles of
the other) / 2**64.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import chunks, map_chunks, written
from assay.llm.components import components
from assay.llm.words import U, mix, run_hashes, word_hashes
from assay.session import ship_package

N = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rows of a tile up to which its rows are compared in place, without bitmaps beside them.
SMALL = 64
#: Most hashes that a task counts, and that stand last in the order (8 bytes each).
FREQUENT = 1 << 18
#: Rows of a size band of a tile up to which it is one square; more are cut by hash.
SQUARE = 8192


def shingle_sets(raw: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words, bounds = word_hashes([r.lower() for r in raw])
    runs = run_hashes(words, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(runs[a:b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set with the frequent hashes (sorted) behind the others."""
    if not len(frequent) or not len(s):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    late = frequent[at] == s
    return np.concatenate([s[~late], s[late]])


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """First hashes of a set, one of which every set that links with it holds among its own."""
    return size - -(-percent * size // 100) + 1


def bitmap(hashes: np.ndarray, each: int = 2) -> bytes:
    """Bits of the hashes' low ends: at least ``each`` a hash, 64 to 131072."""
    width = min(1 << 17, max(64, 1 << (each * len(hashes) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(hashes & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``words`` words."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def may_link(size_a, size_b, differing, percent: int = PERCENT):
    """Whether an overlap of at most (a + b - differing) / 2 can reach the threshold."""
    return (100 + percent) * (size_a + size_b - differing) >= 2 * percent * (size_a + size_b)


def summary(hashes: np.ndarray, counts: np.ndarray, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Counts added by hash; beyond ``limit`` hashes all counts are lowered until they fit
    (Misra and Gries, 1982): a hash of more than sum / limit rows is never lost."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    hashes, counts = hashes[start], np.add.reduceat(counts, start) if len(start) else counts
    if len(hashes) > limit:
        counts = counts - np.partition(counts, len(counts) - limit - 1)[len(counts) - limit - 1]
        hashes, counts = hashes[counts > 0], counts[counts > 0]
    return hashes, counts


def _counts(it):
    held, count = np.zeros(0, U), np.zeros(0, np.int64)
    for batch in it:
        for piece in chunks(batch, "text"):
            sets = shingle_sets([b"" if t is None else t for t in piece.column("text").to_pylist()])
            found = np.concatenate([held, *sets])
            held, count = summary(found, np.concatenate([count, np.ones(len(found) - len(held), np.int64)]))
    held, count = held[count > 1], count[count > 1]
    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(count)], ["token", "m"])


def frequent_hashes(docs: DataFrame, limit: int = FREQUENT) -> np.ndarray:
    """At most ``limit`` of the corpus's most frequent hashes, sorted: those in more rows
    than a small tile holds, by levels of their counts. They only order the hashes."""
    found = written(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counts, "token bigint, m bigint")
                    .groupBy("token").agg(F.sum("m").alias("m")).filter(F.col("m") > SMALL)
                    .withColumn("level", F.floor(F.log2("m") * 4).cast("int")), "frequent")
    least, total = None, 0
    for level, m in sorted(found.groupBy("level").count().collect(), reverse=True):
        total += m
        if total > limit:
            break
        least = level
    if least is None:
        return np.zeros(0, U)
    rows = found.filter(F.col("level") >= least).select("token").toPandas()["token"]
    return np.sort(rows.to_numpy(np.int64).view(U))


def _sketches(docs: DataFrame, frequent: np.ndarray, keyed: bool = False) -> DataFrame:
    """doc_id, n, digest, bits, wide (twice as many, for squares), prefix (8 bytes a hash) of every
    row; with ``keyed`` also ``key``, the SHA-256 of its text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, bits, wide, prefix = [], [], [], [], []
        for s in shingle_sets([b"" if t is None else t for t in batch.column("text").to_pylist()]):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bits.append(bitmap(s) if len(s) else b"")
            wide.append(bitmap(s, 4) if len(s) else b"")
            prefix.append(ordered(s, frequent)[:prefix_length(len(s))].tobytes() if len(s) else b"")
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()),
             pa.array(wide, pa.binary()), pa.array(prefix, pa.binary()), *[batch.column("key") for _ in key]],
            ["doc_id", "n", "digest", "bits", "wide", "prefix", *key])

    key = ["key"] if keyed else []
    only = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *[text_key(docs).alias(k) for k in key])
    return map_chunks(only, run, "doc_id bigint, n bigint, digest binary, bits binary, wide binary, prefix binary"
                      + "".join(f", {k} binary" for k in key), "text")


def text_key(docs: DataFrame):
    """SHA-256 of a row's text (a null one counts as empty)."""
    return F.unhex(F.sha2(F.coalesce(docs["text"].cast("binary"), F.lit(b"")), 256))


#: Rows of the first exchange: ``at`` is the set's size and the hash's place in one number.
PLACED = "token bigint, row bigint, at bigint"
_PLACED = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])
TOKENS = "token bigint, row bigint, n int, place int"
_TOKENS = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def _tokens(it):
    """Prefix hashes of each set, once for the equal sets of a task."""
    seen: set[bytes] = set()
    for batch in it:
        row, n, digest, prefix = (batch.column(k).to_pylist() for k in range(4))
        new = []
        for k, d in enumerate(digest):
            if n[k] and d not in seen:
                seen.add(d)
                new.append(k)
        if new:
            size = np.array([len(prefix[k]) // 8 for k in new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join([prefix[k] for k in new]), np.int64)),
                 pa.array(np.repeat(np.array([row[k] for k in new], np.int64), size)),
                 pa.array(np.repeat(np.array([n[k] for k in new], np.int64) << 32, size)
                          + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)))], schema=_PLACED)


def may_meet(n_a, place_a, n_b, place_b, percent: int = PERCENT):
    """Whether two sets that share the hashes at these places of their ordered arrays, and
    none before, can overlap enough; true at the first shared hash of every pair that links."""
    return np.minimum(n_a - place_a, n_b - place_b) * (100 + percent) >= percent * (n_a + n_b)


def _near(token, n, place, percent: int, differ=None):
    """Index pairs (i, i + o), o < SMALL, of rows sorted by token that may meet."""
    n, place = n.astype(np.int64), place.astype(np.int64)
    for o in range(1, SMALL):
        i = np.flatnonzero(token[o:] == token[:-o])
        if not len(i):
            return
        i = i[may_meet(n[i], place[i], n[i + o], place[i + o], percent)]
        if differ is not None:
            i = i[differ[i] != differ[i + o]]
        if len(i):
            yield i, i + o


def _sizes(token: np.ndarray) -> np.ndarray:
    """Rows of each row's tile."""
    new = np.concatenate([[True], token[1:] != token[:-1]])
    start = np.flatnonzero(new)
    return np.diff(np.append(start, len(token)))[np.cumsum(new) - 1]


def _by_tile(it, fn):
    """``fn(columns, large)`` over rows sorted by token, whole tiles at a time; of a tile of
    more than SQUARE rows in parts, with ``large`` set."""
    held, large = None, None
    for batch in it:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        token = cols[0]
        if large is not None:  # the rest of a tile that has begun
            z = int(np.searchsorted(token != large, True))
            yield fn([c[:z] for c in cols], True)
            cols, token = [c[z:] for c in cols], token[z:]
            held = None
            if not len(token):
                continue
            large = None
        z = len(token) - int((token[::-1] != token[-1]).argmax()) if (token != token[-1]).any() else 0
        if z:
            yield fn([c[:z] for c in cols], False)
            cols = [c[z:] for c in cols]
        if len(cols[0]) > SQUARE:
            yield fn(cols, True)
            large, held = cols[0][0], None
        else:
            held = cols
    if held is not None and len(held[0]):
        yield fn(held, False)


def _shared(percent: int):
    """Rows that may meet another row of their tile (all rows of large tiles)."""
    def tell(cols, large):
        token, row, at = cols
        n, place = (at >> 32).astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32)
        use = np.full(len(token), large) | (_sizes(token) > SMALL)
        for i, j in _near(token, n, place, percent):
            use[i] = use[j] = True
        return pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (token, row, n, place)], schema=_TOKENS)

    return lambda it: _by_tile(it, tell)


CROSS = "token bigint, a bigint, b bigint, place int, comp bigint, n int"
_CROSS = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("place", pa.int32()), ("comp", pa.int64()),
                    ("n", pa.int32())])


def _cross(percent: int):
    """Of small tiles the pairs between components that may meet (b >= 0); of others the
    rows (b = -1)."""
    def tell(cols, large):
        token, row, n, place, comp = cols
        much = np.full(len(token), large) | (_sizes(token) > SMALL)
        found = [np.stack([row[i], row[j]])[:, ~much[i]] for i, j in _near(token, n, place, percent, comp)]
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)
        zero, k = np.zeros(pairs.shape[1], np.int64), np.flatnonzero(much)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([zero, token[k]])), pa.array(np.concatenate([pairs[1], row[k]])),
             pa.array(np.concatenate([pairs[0], np.full(len(k), -1)])),
             pa.array(np.concatenate([zero, place[k]]).astype(np.int32)), pa.array(np.concatenate([zero, comp[k]])),
             pa.array(np.concatenate([zero, n[k]]).astype(np.int32))], schema=_CROSS)

    return lambda it: _by_tile(it, tell)


def _words(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint64) for r in raw]


def _bounded(percent: int):
    """Pairs (a, b) whose bitmaps leave a link possible."""
    def run(it):
        for batch in it:
            c = {f: batch.column(f).to_pylist() for f in batch.schema.names}
            keep = []
            for k, (x, y) in enumerate(zip(_words(c["bits_a"]), _words(c["bits_b"]), strict=True)):
                w = min(len(x), len(y))
                differing = int(np.bitwise_count(fold(x[None], w) ^ fold(y[None], w)).sum())
                if may_link(c["n_a"][k], c["n_b"][k], differing, percent):
                    keep.append(k)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _square(row, n, place, comp, part, above, bits, percent: int):
    """Pairs between components whose bitmaps leave a link possible: of one part or of two
    (then between them), and not both above the band."""
    order = np.argsort(n, kind="stable")
    row, n, place, comp, part, above = (x[order] for x in (row, n, place, comp, part, above))
    bits = [bits[k] for k in order.tolist()]
    width = np.array([len(b) for b in bits])
    packed = {w: (np.flatnonzero(width == w), np.stack([b for b in bits if len(b) == w])) for w in np.unique(width).tolist()}
    reach = np.searchsorted(n, 100 * n // percent, side="right")
    two = len(np.unique(part)) > 1
    found = []
    for i in range(len(row)):
        for w, (at, rows) in packed.items():
            lo, hi = np.searchsorted(at, [i + 1, reach[i]])
            if lo >= hi:
                continue
            j = at[lo:hi]
            ok = (comp[j] != comp[i]) & may_meet(n[i], place[i], n[j], place[j], percent) & (above[j] + above[i] < 2)
            if two:
                ok &= part[j] != part[i]
            if not ok.any():
                continue
            j, other = j[ok], rows[lo:hi][ok]
            common = min(w, len(bits[i]))
            differing = np.bitwise_count(fold(other, common) ^ fold(bits[i][None], common)).sum(1)
            found += [(int(row[i]), int(x)) for x in row[j[may_link(n[i], n[j], differing, percent)]]]
    return found


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _squares(percent: int):
    """Over rows sorted by (token, band, lo, hi): one square at a time."""
    def run(it):
        key, rows = None, []

        def flush():
            if len(rows) < 2:
                return None
            row, n, place, comp, part, above = (np.array([r[k] for r in rows], np.int64) for k in range(6))
            found = _square(row, n, place, comp, part, above, _words([r[6] for r in rows]), percent)
            if not found:
                return None
            a, b = np.array(found, np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=_PAIRS)

        for batch in it:
            for r in zip(*[batch.column(k).to_pylist() for k in range(11)], strict=True):
                if r[:4] != key:
                    out = flush()
                    if out is not None:
                        yield out
                    key, rows = r[:4], []
                rows.append(r[4:])
        out = flush()
        if out is not None:
            yield out
    return run


def _exact(percent: int):
    def run(it):
        for batch in it:
            c = {f: batch.column(f).to_pylist() for f in batch.schema.names}
            keep = []
            for k, (x, y) in enumerate(zip(_words(c["set_a"]), _words(c["set_b"]), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))
    return run


def _with(pairs: DataFrame, side: str, table: DataFrame, cols: list[str]) -> DataFrame:
    return pairs.join(table.select(F.col("row").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)


def _links(pairs: DataFrame, docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by intersecting the sorted arrays of the documents they name."""
    needed = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
                     .join(rows.select("row", "doc_id", "digest"), "row"), "needed")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [s.tobytes() for s in shingle_sets([b"" if t is None else t for t in batch.column("text").to_pylist()])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
             pa.array(raw, pa.binary())], ["doc_id", "digest", "set"])

    texts = (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
             .join(needed.select("doc_id").distinct(), "doc_id", "left_semi"))
    sets = map_chunks(texts, run, "doc_id bigint, digest binary, `set` binary", "text")
    sets = written(needed.join(sets, ["doc_id", "digest"]).dropDuplicates(["row"]).select("row", "set"), "sets")
    return _with(_with(pairs, "a", sets, ["set"]), "b", sets, ["set"]).mapInArrow(_exact(percent), "a bigint, b bigint")


def similar_rows(docs: DataFrame, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """row, doc_id, n (set size) and comp of every row; rows that links connect share comp.
    With ``keyed`` also ``key``, the SHA-256 of the row's text."""
    ship_package(docs.sparkSession)
    sketches = written(_sketches(docs, frequent_hashes(docs), keyed).select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")
    rows = sketches.select("row", "doc_id", "n", "digest", "bits", "wide")
    part = rows.filter("n > 0 and doc_id is not null")
    same = part.groupBy("digest").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    same = written(part.select(F.col("row").alias("a"), "digest").join(same, "digest").filter("a <> b").select("a", "b"), "same")

    tokens = sketches.filter("n > 0 and doc_id is not null").select("row", "n", "digest", "prefix").mapInArrow(_tokens, PLACED)
    tiles = written(tokens.repartition("token").sortWithinPartitions("token", "at").mapInArrow(_shared(percent), TOKENS), "tiles")

    # each document with the hub of its tiles: the one that is in most tiles
    often = tiles.groupBy("row").agg(F.count(F.lit(1)).alias("often"))
    ranked = tiles.join(often, "row").select("token", "row", "n", (F.col("often") * 1000003 + F.pmod("row", F.lit(1000003))).alias("rank"))
    hubs = ranked.groupBy("token").agg(F.max_by("row", "rank").alias("hub"), F.max_by("n", "rank").alias("hub_n"))
    stars = (ranked.join(hubs, "token")
             .filter(F.col("row") != F.col("hub"))
             .filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
             .select(F.greatest("row", "hub").alias("a"), F.least("row", "hub").alias("b")).distinct())
    pairs = written(_possible(stars, part, percent), "pairs")
    links = written(_links(pairs, docs, rows, percent).unionByName(same), "links")

    # tiles that hold several components: between components only
    comp = components(links)
    tile = written(tiles.join(comp.withColumnRenamed("node", "row"), "row", "left")
                   .withColumn("comp", F.coalesce("component", "row")).drop("component"), "tile")
    mixed = tile.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y and m > 2")
    cross = written(tile.join(mixed.select("token"), "token", "left_semi").select("token", "row", "n", "place", "comp")
                    .repartition("token").sortWithinPartitions("token", "n").mapInArrow(_cross(percent), CROSS), "cross")
    beside = written(_possible(cross.filter("b >= 0").select("a", "b").distinct(), part, percent), "beside")
    # large tiles: a document stands in the tile of its band of sizes, and above the band below;
    # bitmaps join once the squares are known
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    large = (cross.filter("b < 0")
             .select("token", F.col("a").alias("row"), "n", "place", "comp", F.explode(F.array(
                 F.struct(band.alias("band"), F.lit(0).alias("above")), F.struct((band - 1).alias("band"), F.lit(1).alias("above")))).alias("at"))
             .select("token", "at.band", "at.above", "row", "n", "place", "comp"))
    sizes = (large.groupBy("token", "band")
             .agg(F.count(F.lit(1)).alias("m"), F.min("above").alias("own"), F.min("comp").alias("x"), F.max("comp").alias("y"))
             .filter("own = 0 and x < y").select("token", "band", F.ceil(F.col("m") / SQUARE).cast("int").alias("cuts")))
    part_of = F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int")
    squares = (large.join(sizes, ["token", "band"]).withColumn("part", part_of)
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
               .join(part.select("row", F.col("wide").alias("bits")), "row")
               .select("token", "band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                       "row", "n", "place", "comp", "part", "above", "bits"))
    crossed = written(squares.repartition("token", "band", "lo", "hi").sortWithinPartitions("token", "band", "lo", "hi")
                      .mapInArrow(_squares(percent), "a bigint, b bigint").unionByName(beside).distinct(), "crossed")
    rows = rows.join(comp.withColumnRenamed("node", "row"), "row", "left").select("row", "doc_id", "n", "digest", F.coalesce("component", "row").alias("comp"))
    if not crossed.isEmpty():
        # links between components are few; they are merged by themselves
        of = comp.select("node", "component")
        between = written(_links(crossed, docs, rows, percent), "between")
        for side in ("a", "b"):
            between = between.join(of.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        merged = components(between.select("a", "b")).withColumnRenamed("node", "comp")
        rows = rows.join(merged, "comp", "left").withColumn("comp", F.coalesce("component", "comp"))
    rows = rows.select("row", "doc_id", "n", "comp")
    return rows.join(sketches.select("row", "key"), "row") if keyed else rows


def _possible(pairs: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs of different sets whose bitmaps leave a link possible."""
    sides = _with(_with(pairs, "a", part, ["n", "digest", "bits"]), "b", part, ["n", "digest", "bits"])
    return sides.filter("digest_a <> digest_b").drop("digest_a", "digest_b").mapInArrow(_bounded(percent), "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    named = similar_rows(docs, percent)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"),
                                            F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
