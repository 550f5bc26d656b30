"""Resampling documents towards a target distribution: hashed features, Gumbel scores, exact top k by radix selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .arrow import give_back, slices
from .hashing import crc32_of
from .shingles import text_bytes

#: Bytes of text that are hashed at once, and bits of a digit of the radix selection.
SLICE, DIGIT = 2 << 20, 12
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def feature_buckets(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every run of 1 to `width` words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, A-Z as a-z, and each text's words."""
    many = len(offsets) - 1
    data = _LOWER[data]
    inside = np.r_[False, _WORD[data], False]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(text, minlength=many)
    state = crc32_of(data, starts, ends - starts)
    found, owner = [state], [text]
    blank = np.full(1, 32, np.uint8)
    for k in range(1, width):
        at = np.flatnonzero(text[: len(text) - k] == text[k:]) if len(text) > k else np.zeros(0, np.int64)
        longer = crc32_of(blank, np.zeros(len(at), np.int64), np.ones(len(at), np.int64), state[at])
        longer = crc32_of(data, starts[at + k], (ends - starts)[at + k], longer)
        found.append(longer)
        owner.append(text[at])
        state = np.zeros(len(text), np.uint32)  # runs keep the number of their first word
        state[at] = longer
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owner), words


def bucket_counts(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts (column text without nulls); a task sends `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                total += np.bincount(feature_buckets(*text_bytes(part.column("text")), width, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])
        give_back()

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket: one array of `buckets` numbers, whatever the tables' size."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = both.toPandas()  # `buckets` rows
    s, t = rows["s"].to_numpy(np.float64), rows["t"].to_numpy(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = [math.floor(1000 * math.log(x)) for x in ratio.tolist()]
    return out


def weigh(docs: DataFrame, gains: np.ndarray, width: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs (doc_id, text without nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                bucket, owner, words = feature_buckets(*text_bytes(part.column("text")), width, len(gains))
                n = np.bincount(owner, minlength=part.num_rows)
                order = np.argsort(owner, kind="stable")
                sums = np.r_[0, np.cumsum(gains[bucket[order]])]
                ends = np.cumsum(n)
                total = sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the sha256 of `seed:key`. A null key counts as the word null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def radix_select(rows: DataFrame, keys: Sequence[str], k: int, bits: int = DIGIT) -> tuple[int, ...] | None:
    """The k-th smallest value (from 1) of the columns `keys` (longs without nulls), compared one after the other; None if there are fewer.

    One digit of `bits` bits a round, from the highest in which rows differ: the rows that agree with the digits found so far are counted by
    their next digit. A round sends 2 ** bits counts to the driver at most, and no row moves.
    """
    flip = -(1 << 63)
    raw = {c: F.col(c).bitwiseXOR(F.lit(flip)) for c in keys}
    span = rows.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in keys for f in (F.min, F.max))).first()
    if k < 1 or span["n"] < k:
        return None
    found, left = [], rows
    for c in keys:
        low, high = ((span[f"{c}_{f}"] ^ flip) & (2**64 - 1) for f in ("min", "max"))
        top = (low ^ high).bit_length()
        prefix, shift = high >> top, top
        while shift:
            step = min(bits, shift)
            shift -= step
            digit = F.shiftrightunsigned(raw[c], shift).bitwiseAND(F.lit((1 << step) - 1))
            counts = sorted((r["digit"], r["n"]) for r in left.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
            for value, n in counts:
                if k <= n:
                    break
                k -= n
            prefix = prefix << step | value
            whole = F.shiftrightunsigned(raw[c], shift)
            left = left.where(whole == F.lit(prefix - (1 << 64) if prefix >> 63 else prefix))
        # back to a signed number
        found.append((prefix ^ (1 << 63)) - (1 << 64) if not prefix >> 63 else prefix ^ (1 << 63))
    return tuple(found)


def number_rows(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds 1, 2, ... in the order of the keys, which no two rows share: rows are dealt to ranges, sorted there and checkpointed, so that
    their places are fixed; ranges are counted, and a row's number is its place after those of the ranges before."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)).withColumn("_place", F.monotonically_increasing_id())
    split = placed.withColumn("_range", F.shiftright("_place", 33).cast("int")).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["_range"], r["n"]) for r in split.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    starts, total = {}, 0
    for k, n in counts:
        starts[k] = total
        total += n
    if not starts:
        return split.withColumn(name, F.col("_place")).drop("_place", "_range")
    offsets = F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(max(starts) + 1)])
    return split.withColumn(name, F.col("_place") + 1 + F.get(offsets, F.col("_range"))).drop("_place", "_range")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, width: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs.

    Features: runs of 1 to `width` words, hashed to buckets; a bucket's gain is the log ratio of its smoothed shares in target and docs,
    in thousandths. weight: the floored mean of a text's gains, 0 without features; score: weight plus a Gumbel number hashed from seed and
    key, so that the highest scores are a draw without replacement by exp(weight / 1000). Of the N rows with at least `least_words` words,
    floor(percent * N / 100) of the highest scores are drawn and ranked 1, 2, ...; ties go to the smaller key, null keys last. Rows with equal keys and
    scores are ranked in any order. rank is null where a row isn't drawn. Null and empty texts have no words; an empty target has no features; an
    empty table gives no rows. Texts may be as long as a value of Spark; further columns are ignored. Keys are whole numbers.
    """
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text"))
    gains = bucket_gains(bucket_counts(plain, width, buckets), bucket_counts(wanted, width, buckets), buckets)
    scored = weigh(plain, gains, width).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    # rows of a checkpoint keep their places, so the last key is the same whenever it is made
    rows = cut(scored).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumns({"_down": -F.col("score"), "_null": F.col("doc_id").isNull().cast("long"), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    keys = ["_down", "_null", "_id", "_row"]
    able = rows.where(F.col("n_words") >= least_words)
    last = radix_select(able, keys, percent * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (F.struct(*keys) <= F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(keys, last, strict=True)]))
    ranked = number_rows(rows.where(drawn), keys, "rank")
    return ranked.select(*columns, "rank").unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
