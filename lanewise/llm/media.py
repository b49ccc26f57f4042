"""Media columns: bytes stored as lossless WebP, and WebP columns decoded to pixel arrays.

``stored`` writes each text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, as RGBA
samples of a 16 pixels wide image; texts over 1 MB take several images, one after another, in one value.
``decoded`` reads any column of lossless WebP (see webp.py) and gives width, height, the RGBA samples and
features of them. A value that is no lossless WebP has null for all of these and the reason in ``error``.

Null text: empty, i.e. one row of zero samples. Null media: all null. Repeated rows: one result row each, with
equal values. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm import webp
from lanewise.llm.common import text_or_empty

UNIT = 4 * webp.WIDTH


def _added(df: DataFrame, fields: list[T.StructField], column: str, work) -> DataFrame:
    """Appends what ``work`` makes of each batch's column."""
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            # a column at a time and values one by one: no second copy of a whole batch
            made = work(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds ``media`` (binary) to a frame with a string column."""

    def work(column):
        out = []
        for value in column:
            payload = value.as_py().encode()
            out.append(webp.store(payload + bytes(-len(payload) % UNIT) or bytes(UNIT)))
        return [pa.array(out, pa.binary())]

    return _added(df, [T.StructField(media, T.BinaryType())], text, work)


def features(samples: np.ndarray, width: int) -> str:
    """Whole numbers, colon between: the sums of the four channels, of their squares' tops, of steps to the right and of steps down."""
    image = samples.reshape(-1, width, 4).astype(np.int32)
    sums = image.sum((0, 1)).tolist()
    tops = (image * image >> 8).sum((0, 1)).tolist()
    right, down = abs(np.diff(image, axis=1)).sum(), abs(np.diff(image, axis=0)).sum()
    return ":".join(map(str, [*sums, *tops, int(right), int(down)]))


def decoded(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds width, height, pixels (RGBA samples row by row, binary), feature and error."""

    def work(column):
        rows = []
        for value in column:
            data = value.as_py()
            if data is None:
                rows.append((None, None, None, None, None))
                continue
            try:
                width, height, samples = webp.decode_all(data)
                rows.append((width, height, samples, features(np.frombuffer(samples, np.uint8), width), None))
            except (webp.Bad, ValueError, IndexError) as e:
                rows.append((None, None, None, None, str(e) or type(e).__name__))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]

    fields = [T.StructField(n, k) for n, k in (("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType()))]
    return _added(df, fields, media, work)


def digests(docs: DataFrame) -> DataFrame:
    """What op2 returns: digests of each text's stored form and of the samples read back from it."""
    texts = docs.select("doc_id", text_or_empty(docs).alias("text"))
    kept = stored(texts).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "media")
    return decoded(kept).select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, octet_length(pixels) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
