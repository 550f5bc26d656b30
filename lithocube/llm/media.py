"""Media columns: texts stored as TIFF files and read back page by page."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrow import map_batches
from .tiff import DEFLATE, LZW, NAMES, PACKBITS, Page, read_each, write_tiff

#: Samples in a row of the stored images.
ROW = 64


def payload_file(payload: bytes) -> bytes:
    """The payload as rows of 64 samples on one to three pages. Its checksum picks byte order, number of pages, and each page's
    compression, predictor and strips or tiles, so that equal payloads are stored alike and all ways of storing occur."""
    pick = zlib.crc32(payload)
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    pages = min(len(samples), 1 + pick % 3)
    edges = [len(samples) * k // pages for k in range(pages + 1)]
    made = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        way = pick >> 2 + 5 * k
        compression = (PACKBITS, LZW, DEFLATE)[way % 3]
        predictor = 2 if compression != PACKBITS and way >> 3 & 1 else 1
        made.append(Page(samples[a:b], compression, predictor, (64, 32) if way >> 4 & 1 else None, 128))
    return write_tiff(made, ">" if pick >> 20 & 1 else "<")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, tiff): each text's UTF-8 bytes, followed by bytes 0 up to a positive multiple of 64, as a TIFF file.

    Null and empty texts are 64 bytes 0. Repeated rows and null keys are rows like others; an empty table gives no rows and further
    columns are ignored. A text may be as long as a value of Spark; a batch's files are held together.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("data").to_pylist()
        files = [payload_file(x + b"\0" * (ROW - len(x) % ROW if len(x) % ROW or not x else 0)) for x in data]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "tiff"])

    return map_batches(rows, kernel, f"doc_id {key_type}, n_bytes long, tiff binary", "data")


def page_feature(samples: np.ndarray) -> str:
    """Whole numbers of a page's samples: height, sum, sum of squares, steps along the rows, and counts in eight bands of values."""
    wide = samples.astype(np.int64)
    bands = np.bincount(samples.ravel() >> 5, minlength=8)
    steps = int(np.abs(np.diff(wide, axis=1)).sum())
    return f"h={samples.shape[0]};sum={int(wide.sum())};sq={int((wide * wide).sum())};step={steps};bands={','.join(map(str, bands.tolist()))}"


def read_pages(files: DataFrame, media: str = "tiff") -> DataFrame:
    """One row for each page of each file: the other columns, the file, and page, width, height, compression, predictor,
    tiled, samples, feature, error.

    A null file has no page and no row, an empty table no rows; repeated rows are rows like others. A page that can't be read (not
    one 8-bit sample a pixel, or damaged: sizes of 0, sizes that its bytes can't fill, data that end early) gives a row whose error
    says why; a file whose directories can't be followed gives one whose page is null. Columns of the files that have such a name are
    replaced.
    """
    made = ["page int", "width int", "height int", "compression string", "predictor int", "tiled boolean", "samples binary", "feature string", "error string"]
    files = files.drop(*[m.split()[0] for m in made])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), *made])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, rows = [], []
        for k, data in enumerate(batch.column(batch.schema.get_field_index(media)).to_pylist()):
            if data is None:
                continue
            try:
                found = [
                    (n, *[None] * 7, str(p)) if isinstance(p, ValueError) else (n, p.samples.shape[1], p.samples.shape[0], NAMES[p.compression], p.predictor, p.tile is not None, p.samples.tobytes(), page_feature(p.samples), None)
                    for n, p in enumerate(read_each(data))
                ]
            except ValueError as error:
                found = [(None, None, None, None, None, None, None, None, str(error))]
            index += [k] * len(found)
            rows += found
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.string()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        kept = batch.take(pa.array(index, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *columns], [*batch.schema.names, *(m.split()[0] for m in made)])

    return map_batches(files, kernel, schema, media)


def joined_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, samples, feature, layout): the samples of all pages of a file end to end. keys name a file by what is in it; of rows that
    agree in all of them, each page comes as often as there are such rows, and so do the results."""
    one = F.struct("page", "samples", "feature", F.concat_ws("/", "compression", "predictor", "tiled").alias("layout"))
    files = pages.groupBy(*keys).agg(F.array_sort(F.collect_set(one)).alias("pages"), F.sum((F.col("page") == 0).cast("int")).alias("times"))
    each = files.withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    whole = F.aggregate("pages", F.lit(b""), lambda a, p: F.concat(a, p["samples"]))
    said = lambda name: F.array_join(F.transform("pages", lambda p: p[name]), "|")
    return each.select(*keys, whole.alias("samples"), said("feature").alias("feature"), said("layout").alias("layout"))


def op8_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store_texts(table(spark, sf_dir, "documents"))
    named = files.select("doc_id", "n_bytes", F.octet_length("tiff").cast("long").alias("media_bytes"), F.sha2("tiff", 256).alias("media_sha256"), "tiff")
    keys = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    out = joined_pages(read_pages(named), keys)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "layout",
    )
