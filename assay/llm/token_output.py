"""Packed token ids as binary windows.

Each row is one window: its ids (little-endian, padded), the cumulative lengths of its
segments, and positions that restart at zero in each segment. Windows come from the
best-fit-decreasing packing with its segment tree; a document longer than a window is
split into full windows and a rest, and no id is lost.

Defined cases: as in ``packing``. ``unpack_windows`` gives the documents' ids back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import texts_of
from assay.llm.packing import END_ID, WINDOW, _first_number, groups, pack
from assay.session import ship_package

SCHEMA = ("sequence_id bigint, n_tokens bigint, n_segments bigint, doc_ids array<bigint>, starts array<bigint>, "
          "ids binary, cu_seqlens binary, position_ids binary")
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("n_segments", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ids", pa.binary()),
                    ("cu_seqlens", pa.binary()), ("position_ids", pa.binary())])
#: Windows of one Arrow batch handed to Spark.
ROWS = 512


def packed_windows(df: DataFrame, tokenizer_path: str, *, window: int = WINDOW, end_id: int = END_ID,
                   pad_id: int = 0, dtype: str = "<u2") -> DataFrame:
    """One row per window: ids and position_ids hold ``window`` numbers of ``dtype`` each,
    cu_seqlens ``n_segments + 1`` of '<i4'. Ids must fit ``dtype`` (checked)."""
    ship_package(df.sparkSession)
    most = np.iinfo(np.dtype(dtype)).max

    def run(it):
        number = _first_number()
        for docs, flat, sizes in groups(it, tokenizer_path, end_id):
            if int(flat.max()) > most or pad_id > most or window - 1 > most:
                raise ValueError(f"an id or position is beyond {dtype}")
            begin = np.cumsum(sizes) - sizes
            pieces = np.array(pack(sizes, window), np.int64)
            d, start, n, w, offset = pieces[np.lexsort((pieces[:, 4], pieces[:, 3]))].T
            used = int(w[-1]) + 1
            first = np.searchsorted(w, np.arange(used + 1))
            at = begin[d] + start
            for a in range(0, used, ROWS):
                some = range(a, min(used, a + ROWS))
                ids = np.full((len(some), window), pad_id, dtype)
                positions = np.zeros((len(some), window), dtype)
                rows = []
                for r, s in enumerate(some):
                    lo, hi = int(first[s]), int(first[s + 1])
                    lengths = n[lo:hi]
                    ends = np.cumsum(lengths)
                    for k in range(lo, hi):
                        o, m = int(offset[k]), int(n[k])
                        ids[r, o:o + m] = flat[at[k]:at[k] + m]
                        positions[r, o:o + m] = np.arange(m)
                    rows.append({"sequence_id": number + s, "n_tokens": int(ends[-1]), "n_segments": hi - lo,
                                 "doc_ids": [docs[x] for x in d[lo:hi].tolist()], "starts": start[lo:hi].tolist(),
                                 "ids": ids[r].tobytes(), "position_ids": positions[r].tobytes(),
                                 "cu_seqlens": np.concatenate([[0], ends]).astype("<i4").tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
            number += used

    return texts_of(df, "doc_id").mapInArrow(run, SCHEMA)


def write_windows(df: DataFrame, path: str, tokenizer_path: str, **how) -> None:
    """The windows as Parquet files at ``path``, by Spark's own committed writer."""
    packed_windows(df, tokenizer_path, **how).write.mode("overwrite").parquet(path)


def unpack_windows(windows: DataFrame, dtype: str = "<u2") -> DataFrame:
    """Segments of written windows: doc_id, start, ids array<int>."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(it):
        for batch in it:
            out = []
            for r in batch.to_pylist():
                ids, cu = np.frombuffer(r["ids"], dtype), np.frombuffer(r["cu_seqlens"], "<i4")
                out += [{"doc_id": d, "start": s, "ids": ids[a:b].astype(np.int32)}
                        for d, s, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:])]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return windows.select("doc_ids", "starts", "ids", "cu_seqlens").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def window_digest(windows: DataFrame) -> DataFrame:
    """``windows`` with the SHA-256 of each binary column beside it."""
    return windows.select("*", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "cu_seqlens", "position_ids")])
