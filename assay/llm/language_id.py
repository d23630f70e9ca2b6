"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows, each
filter's maximum over the window feeds a softmax. The network is trained with Adam on
windows of a bounded sample of labelled rows; a document's probabilities are the mean
over all windows of its whole text, weighted by the letters they hold.

Defined cases: a null text, an empty one and one without a letter are ``und`` with score
0; rows whose lang is null are judged but not learned from; repeated rows give repeated
results; with no labelled row at all every text is ``und``; a text of any length is read
whole; lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from assay.llm.batches import chunks, map_chunks, release, unused
from assay.session import ship_package

UND = "und"
#: Bytes of a window.
WINDOW = 256
#: Bound of the training sample: rows of each language, windows of a row.
SAMPLE_ROWS, ROW_WINDOWS = 1000, 4
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 6
EPOCHS, BATCH, RATE, SEED = 4, 64, 4e-3, 7


@dataclasses.dataclass
class Network:
    labels: list[str]
    embed: np.ndarray     # 256 x EMBED; byte 0 pads and stays zero
    kernel: np.ndarray    # max width * EMBED x filters of all widths; narrow ones are zero below
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray, need_at: bool = False):
        """Maximum of each filter over each window (and the place it was reached)."""
        m, size = windows.shape
        wide = max(WIDTHS)
        e = self.embed[windows].reshape(m, size * EMBED)
        e = np.pad(e, ((0, 0), (0, (wide - 1) * EMBED)))
        view = np.lib.stride_tricks.as_strided(
            e, (m, size, wide * EMBED), (e.strides[0], EMBED * e.strides[1], e.strides[1]), writeable=False)
        r = view.reshape(m * size, wide * EMBED) @ self.kernel
        r = r.reshape(m, size, -1)
        if need_at:
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + self.bias
            return np.maximum(top, 0), at, view
        return np.maximum(r.max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _mask() -> np.ndarray:
    """Which kernel entries each filter may use."""
    wide = max(WIDTHS)
    mask = np.zeros((wide * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask


def train(windows: np.ndarray, target: np.ndarray, labels: list[str]) -> Network:
    """Adam on the cross entropy; the gradient of a maximum goes to the place it was reached."""
    rng = np.random.default_rng(SEED)
    mask, n_f = _mask(), FILTERS * len(WIDTHS)
    net = Network(labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(n_f, np.float32),
                  rng.normal(0, 0.2, (n_f, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    net.embed[0] = 0
    names = ["embed", "kernel", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    wide, step = max(WIDTHS), 0
    weight = (len(target) / (len(labels) * np.maximum(1, np.bincount(target, minlength=len(labels)))))[target].astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for a in range(0, len(order), BATCH):
            some = order[a:a + BATCH]
            x, y = windows[some], target[some]
            f, at, view = net.features(x, need_at=True)
            z = f @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[some, None] / len(y)
            df = (p @ net.out.T) * (f > 0)
            rows = view[np.arange(len(y))[:, None], at]                     # batch x filters x inputs
            g = {"out": f.T @ p, "out_bias": p.sum(0), "bias": df.sum(0),
                 "kernel": np.einsum("bfi,bf->if", rows, df) * mask}
            back = (df[:, :, None] * net.kernel.T[None]).reshape(len(y), n_f, wide, EMBED)
            places = np.minimum(at[:, :, None] + np.arange(wide), x.shape[1] - 1)
            inside = (at[:, :, None] + np.arange(wide)) < x.shape[1]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, x[np.arange(len(y))[:, None, None], places][inside], back[inside])
            ge[0] = 0
            g["embed"] = ge
            step += 1
            for k in names:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                getattr(net, k)[...] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_windows(df: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, targets and labels of a sample of at most SAMPLE_ROWS rows of each label,
    ROW_WINDOWS windows each, chosen by hash; labels without a window are left out."""
    rows = df.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = df.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * SAMPLE_ROWS / r["n"] + 50 / r["n"])) for r in counts],
                                             "lang string, share double")
    text = F.col("text").cast("binary")
    size = F.octet_length("text")
    # a text's last windows start before its end; the first always counts
    starts = [F.lit(0)] + [F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(size - WINDOW, F.lit(1))) for i in range(1, ROW_WINDOWS)]
    some = (rows.select("lang", "doc_id", "text").join(F.broadcast(shares), "lang").filter(draw < F.col("share"))
            .select("lang", draw.alias("draw"), "doc_id",
                    F.array(*[F.substring(text, s.cast("int") + 1, F.lit(WINDOW)) for s in starts]).alias("windows"))
            .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id")))
            .filter(F.col("r") <= SAMPLE_ROWS).orderBy("lang", "r").select("lang", "windows").collect())
    rng = np.random.default_rng(SEED)
    x, y = [], []
    for r in some:
        for i, w in enumerate(dict.fromkeys(bytes(w) for w in r["windows"])):
            w = _lower(w)
            if i % 2 and len(w) > 8:  # short texts are judged too
                a = int(rng.integers(0, len(w) - 4))
                w = w[a:a + int(rng.integers(4, 80))]
            if w.strip():
                x.append(np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8))
                y.append(r["lang"])
    labels, target = np.unique(np.array(y, object), return_inverse=True)
    return (np.array(x) if x else np.zeros((0, WINDOW), np.uint8)), target.astype(np.int64), labels.tolist()


def _lower(raw: bytes) -> bytes:
    return raw.decode("utf-8", "ignore").lower().encode()


#: Bytes of letters, as a window's weight: A-Z, a-z and all of multi-byte characters.
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in range(256)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def judge(net: Network, raw: list[bytes | None]) -> tuple[list[str], list[float]]:
    """(label, score) of each text."""
    keep, rows = [], []
    for k, b in enumerate(raw):
        t = "" if b is None else b.decode("utf-8", "replace").lower()
        if net.labels and has_letter(t):
            u = t.encode()
            n = -(-len(u) // WINDOW)
            rows.append(np.frombuffer(u.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW))
            keep.append(k)
    label, score = [UND] * len(raw), [0.0] * len(raw)
    if keep:
        windows = np.concatenate(rows)
        p = np.concatenate([net.probabilities(windows[a:a + 256]) for a in range(0, len(windows), 256)]).astype(np.float64)
        weight = _LETTER[windows].sum(1) + 1e-3
        bounds = np.cumsum([0] + [len(r) for r in rows])[:-1]
        total = np.add.reduceat(p * weight[:, None], bounds)
        total /= total.sum(1, keepdims=True)
        for k, row in zip(keep, total, strict=True):
            best = int(row.argmax())
            label[k], score[k] = net.labels[best], float(min(1.0, row[best]))
    return label, score


def fit(df: DataFrame) -> Network:
    """The network trained on the sample of ``df`` (doc_id, text, lang)."""
    return train(*training_windows(df))


def identify(df: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label, score = judge(net, batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(label), pa.array(score, pa.float64())],
                                          ["doc_id", "held_out", "lang_pred", "score"])

    only = df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return map_chunks(only, run, "doc_id bigint, held_out boolean, lang_pred string, score double", "text")


def with_language(df: DataFrame, net: Network, names: tuple[str, str] = ("lang_pred", "score"), letters: str | None = None) -> DataFrame:
    """``df`` with two more columns, the label and the score of its ``text``; with ``letters``
    a third of that name, whether the text has a letter."""
    kinds = [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.BooleanType())]
    ship_package(df.sparkSession)

    @F.arrow_udf(T.StructType(kinds))
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [[], [], []]
            for piece in chunks(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                raw = piece.column("text").to_pylist()
                label, score = judge(net, raw)
                for column, values in zip(found, (label, score, [b is not None and has_letter(b.decode("utf-8", "replace")) for b in raw]), strict=True):
                    column += values
            yield pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())],
                                             ["label", "score", "letters"])
        release()

    # the other columns stay in the JVM; a network is judged once a row, so the call isn't moved or copied
    own = unused(df, "judged")
    added = [F.col(f"{own}.label").alias(names[0]), F.col(f"{own}.score").alias(names[1])]
    if letters:
        added.append(F.col(f"{own}.letters").alias(letters))
    judged = judged.asNondeterministic()
    return df.withColumn(own, judged(F.col("text").cast("binary"))).select(*[F.col(f"`{c}`") for c in df.columns], *added)
