"""Media columns: payloads stored losslessly as progressive JPEG, read back to tensors and features.

``encode`` adds a binary column; ``decode`` reads nothing but that column: it accumulates the scans, recovers the payload from the
coefficients, and makes the full-resolution RGB tensor.

Cases: null and empty texts are 64 zero bytes; a text that fills its last 64 bytes is not padded further; equal texts give equal files;
repeated rows and ties need nothing special; an empty table gives no rows; other columns are ignored. One document is in memory at a time,
beside a slice of a few megabytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import parts, with_text
from placemill.llm.progressive import Decoder, stored, write

ROWS, BYTES = 500, 2_000_000
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64) if raw else bytes(64)


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text's file; its comment says how many bytes the text and the payload have."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, ROWS, BYTES):
                media = []
                for t in part.column(1).cast(pa.binary()):
                    raw = t.as_py()
                    payload = padded(raw)
                    media.append(write(payload, b"%d %d" % (len(raw), len(payload))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(fn, "doc_id long, media binary")


def feature_of(rgb: np.ndarray) -> str:
    """Size, and mean and deviation of each channel."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64)
    square = np.array([int(np.bincount(flat[:, c], minlength=256) @ (np.arange(256) ** 2)) for c in range(3)])
    mean = total / n
    return f"{rgb.shape[1]}x{rgb.shape[0]}x3 mean " + " ".join(f"{m:.2f}" for m in mean) + " sd " + " ".join(f"{s:.2f}" for s in np.sqrt(np.maximum(square / n - mean**2, 0)))


def decode(media: DataFrame, tensors: bool = False) -> DataFrame:
    """Of ``media(doc_id, media)``: sizes, digests and features of what was stored; with ``tensors`` also ``height, width, rgb``."""
    more = ", height int, width int, rgb binary" if tensors else ""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, ROWS, BYTES):
                cols: list[list] = [[] for _ in range(11)]
                for item in part.column(1):
                    data = item.as_py()
                    decoder = Decoder(data)
                    n, size = map(int, decoder.comment.split())
                    payload = stored(decoder, size)
                    rgb = decoder.rgb()
                    row = (n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(rgb), decoder.height, decoder.width, rgb.tobytes() if tensors else None)
                    for c, x in zip(cols[1:], row, strict=True):
                        c.append(x)
                kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
                arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True))]
                names = [x.split()[0] for x in (FEATURE_SCHEMA + ", height int, width int, rgb binary").split(", ")]
                keep = len(names) if tensors else 8
                yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    return media.select("doc_id", "media").mapInArrow(fn, FEATURE_SCHEMA + more)
