"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification,
banded buckets and star-shaped candidate edges, each confirmed on the full sets.

A document is the set of its distinct runs of ``N`` words, as 64-bit hashes. Documents with
equal sets are one class, told by 128 bits of the set, and all further work is on classes.

1. One pass hashes a set once: the hash's range is cut into ``BINS`` bins, and a bin's value is
   the least hash in it. An empty bin takes the value of the first full bin in a random order
   of its own (optimal densification, Shrivastava 2017), so that two sets agree in each bin
   with a chance equal to their similarity, however small they are.
2. ``ROWS`` bins make a band; classes with equal bands share a bucket. Two sets of similarity
   0.8 share none of the ``BINS // ROWS`` buckets with odds of 3 in 100,000.
3. A bucket is a star: the class that meets most others in all its buckets (of a text and its
   many near copies the text itself) is paired with the others, never all with all. Pairs
   whose sizes allow the threshold are confirmed by intersecting the full sets; links found so
   far are merged to components.
4. The buckets of one centre are a family. In the buckets that still hold several components,
   the classes outside the centre's component (few, as a rule) are compared with the others of
   the family in tiles of bounded size; overlaps are counted by an index inside the
   task, and one link for each class and component leaves it. So every pair of a bucket that
   no path of links joins has been compared in the end, a bucket of m near copies costs m
   pairs, and pairs that don't link are never rows.

Full sets are gathered for the classes that share a bucket with another one; a bitmap of fixed
size (``FILTER_BITS``) keeps most of the others from being moved, and lets false ones pass.

Defined cases: null, empty and white-space texts have an empty set and link with nothing; a
text of fewer than N words has one shingle, the whole sequence; sets of three or fewer
shingles link with equal sets only, which are found without bands; rows that repeat a doc_id are
rows of their own; a row without doc_id takes part, and a group's id is the least doc_id that
is not null (null if there is none); extra columns are not read; an empty table gives an empty
result. A text of any length is taken whole.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import chunks, map_chunks, written
from assay.llm.components import components
from assay.llm.pretokens import ragged
from assay.llm.words import U, mix, run_hashes, word_hashes
from assay.session import ship_package

N = 2
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bins of a sketch and bins of a band.
BINS, ROWS = 448, 8
#: Sketches that a worker holds at once.
HELD = 1024
#: Bits of the filter of classes whose sets are gathered (2 MB).
FILTER_BITS = 1 << 24
#: Parts that a centre's pairs are dealt to, and parts of the rows that make a class heavy.
SPREAD, HEAVY = 64, 256
#: Items of the sets on each side of a tile.
TILE = 1 << 20


def shingle_sets(raw: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after the other, bounds of the texts);
    A-Z are lower-cased."""
    words, bounds = word_hashes([r.lower() for r in raw])
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(raw)), count)
    runs = run_hashes(words, n)
    inside = doc[:len(runs)] == doc[n - 1:] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    alone = [run_hashes(words[bounds[d]:bounds[d + 1]], int(count[d])) for d in short.tolist()]
    doc = np.concatenate([doc[:len(runs)][inside], short])
    value = np.concatenate([runs[inside], *alone])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[first], value[first]
    return value, np.searchsorted(doc, np.arange(len(raw) + 1))


class Bands:
    """Band hashes of sets."""

    def __init__(self, bins: int = BINS, rows: int = ROWS, seed: int = 1):
        self.bins, self.rows = bins, rows
        rng = np.random.default_rng(seed)
        #: turn[t, i]: the t-th bin that an empty bin i asks.
        self.turn = np.argsort(rng.random((bins, bins)), axis=0).astype(np.int32)
        self.place = np.argsort(self.turn, axis=0)  # when bin i asks a bin
        self.factor = rng.integers(1, 1 << 63, size=rows, dtype=np.uint64) | U(1)
        self.salt = rng.integers(0, 1 << 63, size=bins // rows, dtype=np.uint64)

    def sketch(self, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of bins for each (not empty) set of sorted hashes."""
        n = len(bounds) - 1
        out, full = np.zeros((n, self.bins), U), np.zeros((n, self.bins), bool)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        cell = doc * self.bins + ((value >> U(32)) * U(self.bins) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out.reshape(-1)[cell[first]] = value[first]
        full.reshape(-1)[cell[first]] = True
        held = full.sum(axis=1)
        few = held * held < self.bins
        for d in np.flatnonzero(few).tolist():  # the full bin that each empty bin asks first
            own = np.flatnonzero(full[d])
            chosen = own[np.argmin(self.place[own], axis=0)]
            out[d] = np.where(full[d], out[d], out[d, chosen])
        row, col = np.nonzero(~full & ~few[:, None])
        for t in range(self.bins):
            if not len(row):
                break
            asked = self.turn[t, col]
            found = full[row, asked]
            out[row[found], col[found]] = out[row[found], asked[found]]
            row, col = row[~found], col[~found]
        return out

    def hashes(self, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        s = self.sketch(value, bounds).reshape(len(bounds) - 1, -1, self.rows)
        return mix((mix(s) * self.factor).sum(axis=2, dtype=U) + self.salt)


def _key(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


SHINGLED = "rid bigint, doc_id bigint, n bigint, key binary, bands array<bigint>"


def _shingled(bands: Bands):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        raw = [b"" if t is None else t for t in piece.column("text").to_pylist()]
        value, bounds = shingle_sets(raw)
        size = np.diff(bounds)
        keys = [_key(value[a:z]) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        banded = size > 3  # fewer shingles reach 80 % with an equal set only
        own = np.flatnonzero(banded)
        hashes = [np.zeros((0, bands.bins // bands.rows), U)]
        for a in range(0, len(own), HELD):
            some = own[a:a + HELD]
            hashes.append(bands.hashes(np.concatenate([value[bounds[d]:bounds[d + 1]] for d in some.tolist()]),
                                       np.concatenate([[0], np.cumsum(size[some])])))
        flat = np.concatenate(hashes).view(np.int64).reshape(-1)
        ends = np.concatenate([[0], np.cumsum(banded) * (bands.bins // bands.rows)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [piece.column("rid"), piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["rid", "doc_id", "n", "key", "bands"])
    return run


def _place(key: str):
    """A key's bit in the filter: its first three bytes."""
    return F.conv(F.hex(F.substring(key, 1, 3)), 16, 10).cast("int")


def _filter(nodes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the nodes' keys set; the cluster joins them by word, so
    that at most FILTER_BITS / 32 rows reach the driver."""
    at = _place("key")
    rows = (nodes.select((at / 32).cast("int").alias("word"), F.lit(1).cast("long").alias("one"), (at % 32).alias("bit"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow())
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return words


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items): the full sets of the written table ``nodes`` (node, key), gathered from
    the texts. The filter has a fixed size: where the nodes outgrow it, it lets more sets
    through to the join, which decides."""
    spark = docs.sparkSession
    ship_package(spark)
    wanted = spark.sparkContext.broadcast(_filter(nodes))

    def run(it):
        words = wanted.value
        sent: set[bytes] = set()  # copies of a set leave a task once in a while only
        for batch in it:
            for piece in chunks(batch, "text"):
                value, bounds = shingle_sets([b"" if t is None else t for t in piece.column("text").to_pylist()])
                keys, items = [], []
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    key = _key(value[a:z]) if z - a > 3 else None
                    if key is None or key in sent:
                        continue
                    at = int.from_bytes(key[:3], "big")
                    if int(words[at // 32]) >> at % 32 & 1:
                        if len(sent) >= 1 << 16:
                            sent.clear()
                        sent.add(key)
                        keys.append(key)
                        items.append(value[a:z].view(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["key", "items"])

    sets = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, items array<bigint>")
    return sets.join(nodes, "key").groupBy("node").agg(F.first("items").alias("items"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets link. A class in very many pairs (a centre) is joined in
    SPREAD parts, one copy of its set for each part that has pairs."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    centres = pairs.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").join(centres, ["a", "part"])
            .withColumn("common", F.size(F.array_intersect("x", "y")).cast("bigint")))
    return both.filter(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * percent).select("a", "b")


def _labelled(entries: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Entries with their class's component (itself, if it has no link yet)."""
    if comps is None:
        return entries.withColumn("comp", F.col("node"))
    return (entries.join(comps.select("node", F.col("component").alias("found")), "node", "left")
            .withColumn("comp", F.coalesce("found", "node")).drop("found"))


LINKS = "a bigint, b bigint"


def _tile(table: pa.Table) -> pa.Table:
    """Links of a tile's strays with its members of other components, one for each stray and
    component: overlaps are counted with an index of the members' sets."""
    node, comp, stray = (table.column(c).to_numpy() for c in ("node", "comp", "stray"))
    items = table.column("items").combine_chunks()
    ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
    size = np.diff(ends)
    members = np.flatnonzero(~stray)
    owner = np.repeat(np.arange(len(members)), size[members])
    value = flat[ragged(ends[:-1][members], size[members])]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    links = []
    for x in np.flatnonzero(stray).tolist():
        own = flat[ends[x]:ends[x + 1]]
        first = np.searchsorted(value, own)
        met = owner[ragged(first, np.searchsorted(value, own, side="right") - first)]
        common = np.bincount(met, minlength=len(members))
        linked = members[100 * common >= PERCENT * (size[x] + size[members] - common)]
        linked = linked[comp[linked] != comp[x]]
        for k in linked[np.unique(comp[linked], return_index=True)[1]].tolist():
            links.append((min(node[x], node[k]), max(node[x], node[k])))
    return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("ab")})


def stray_links(families: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components inside families (hub, node, n, comp, hub_comp). The strays of a
    family are its classes outside the hub's component; they are compared with all its classes
    in tiles of about TILE items a side, and only links leave a tile."""
    stray = F.col("comp") != F.col("hub_comp")
    sizes = (families.groupBy("hub").agg(F.sum("n").alias("items"), F.sum(F.when(stray, F.col("n")).otherwise(0)).alias("strays"))
             .filter("strays > 0").select("hub", F.ceil(F.col("items") / TILE).alias("cells"), F.ceil(F.col("strays") / TILE).alias("rows")))
    dealt = families.join(sizes, "hub").join(sets, "node").withColumn("hash", F.xxhash64("node", "hub"))
    each = ("hub", "node", "comp", "items")
    members = dealt.select(*each, F.lit(False).alias("stray"), F.expr("pmod(hash, cells)").alias("cell"), F.expr("explode(sequence(0L, rows - 1))").alias("row"))
    strays = dealt.filter(stray).select(*each, F.lit(True).alias("stray"), F.expr("explode(sequence(0L, cells - 1))").alias("cell"),
                                        F.expr("pmod(hash, rows)").alias("row"))
    return members.unionByName(strays).groupBy("hub", "cell", "row").applyInArrow(_tile, LINKS).distinct()


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows: rid, doc_id, n, key; classes: key, node, low, rows, n; components of linked nodes)."""
    bands = Bands()
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.col("text").cast("binary").alias("text"))
    rows = written(map_chunks(numbered, _shingled(bands), SHINGLED, "text"), "shingled")
    classes = written(rows.filter("n > 0").groupBy("key").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"),
        F.max("bands").alias("bands")), "classes")
    every = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = written(every.join(shared, "bucket"), "buckets")
    if met.isEmpty():
        return rows, classes, None
    weight = met.groupBy("node").agg(F.sum("m").alias("weight"))
    nodes = written(weight.join(classes.select("node", "key"), "node"), "nodes")
    sets = written(full_sets(docs, nodes.select("node", "key")), "sets")
    entries = met.select("bucket", "node", "n").join(nodes.select("node", "weight"), "node")
    hubs = entries.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("h")).select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    starred = written(met.select("bucket", "node", "n").join(hubs, "bucket"), "stars")
    pairs = starred.filter("node <> hub").filter(100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n"))
    links = written(confirmed(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets), "links")
    comps = None if links.isEmpty() else components(links)
    labelled = written(_labelled(starred, comps), "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y and m > 2").select("bucket")
    again = labelled.join(open_, "bucket")
    centre = labelled.filter("node = hub").select("hub", F.col("comp").alias("hub_comp")).distinct()
    families = written(again.select("hub", "node", "n", "comp").distinct().join(centre, "hub"), "families")
    late = written(stray_links(families, sets), "late")
    if not late.isEmpty():
        comps = components(links.unionByName(late))
    return rows, classes, comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, classes, comps = near_classes(docs)
    ids = classes.select("key", "node", "low", "rows")
    if comps is None:
        ids = ids.withColumn("component_id", F.col("low"))
    else:
        ids = _labelled(ids, comps)
        least = ids.groupBy("comp").agg(F.min("low").alias("component_id"))
        ids = ids.join(least, "comp")
    ids = written(ids.select("key", "component_id", "rows"), "groups")
    # at most HEAVY classes hold one part in HEAVY of the rows: they are sent to the rows
    total = rows.count()
    heavy = ids.filter(F.col("rows") * HEAVY >= total).select("key", F.col("component_id").alias("heavy_id"), F.lit(True).alias("is_heavy"))
    marked = rows.select("doc_id", "n", "key").join(F.broadcast(heavy), "key", "left")
    done = marked.filter("is_heavy").select("doc_id", "n", F.col("heavy_id").alias("component_id"))
    rest = marked.filter("is_heavy is null and n > 0").join(ids, "key").select("doc_id", "n", "component_id")
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (done.unionByName(rest).unionByName(empty)
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
