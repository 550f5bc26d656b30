"""A quality classifier that combines each document's own evidence with what its site is like, by hierarchical empirical Bayes.

A logistic model over hashed features of the whole text gives a document's log odds. Sites
form a hierarchy: all documents, hosts, paths of a host. Each level's rate of good documents is a beta posterior
whose prior is its parent's rate, and the priors' strengths are fitted by moments from how rates of siblings spread; so
a site of few documents stays near its parent. Counts of sites are grouped aggregations over all documents: labelled ones count
as they are, others by the evidence, at a documented share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .arrow import map_batches
from .shingles import mixed, text_bytes, word_hashes

#: Labelled rows the document model is fitted on, at most: those with the smallest hash of their id. Bits of a feature's hash.
LABELLED_ROWS, BITS = 20_000, 14
#: Bytes of the labelled rows' features that the driver fits on, at most: of the rows above, in order of that hash, as many as fit.
LABELLED_BYTES = 64 << 20
#: How much of a document an unlabelled one counts as in its site's rate.
SOFT = 0.25
_KIND = np.zeros(256, np.int64)  # classes of bytes: other, letters, capitals, digits, blanks, line feeds, points, other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9]], _KIND[10], _KIND[[44, 46, 39, 45]] = 1, 2, 3, 4, 5, 6
_KIND[[b for b in range(33, 127) if not (chr(b).isalnum() or chr(b) in ",.'-")]] = 7
_KIND[128:] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the distinct features of texts laid end to end: trigrams of classes of bytes, words of signs, and
    bands of rates (repeats, capitals, signs, length of words, length of the text). Of the whole text, each feature once."""
    many, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(many), sizes)
    kind = _KIND[data]
    found = []
    if len(kind) > 2:
        inside = owner[2:] == owner[:-2]
        found.append(((kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:])[inside].astype(np.uint64), owner[2:][inside]))
    count = np.zeros((8, many))
    for k in range(8):
        count[k] = np.bincount(owner[kind == k], minlength=many)
    words, of = word_hashes(data, offsets)
    n_words = np.bincount(of, minlength=many)
    key = np.unique(of.astype(np.uint64) << np.uint64(44) | words >> np.uint64(20)) if len(words) else np.zeros(0, np.uint64)
    distinct = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=many)
    safe = np.maximum(n_words, 1)
    rates = [distinct / safe * 16, count[2] / np.maximum(count[1] + count[2], 1) * 32, count[7] / safe * 16, count[3] / np.maximum(sizes, 1) * 64, (sizes - count[4] - count[5]) / safe, np.log2(1 + n_words), count[5] / safe * 64, count[6] / safe * 16]
    for k, rate in enumerate(rates):
        found.append((np.uint64(1000 + 100 * k) + np.minimum(rate, 63).astype(np.uint64), np.arange(many)))
    feature, text = np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found])
    feature = np.concatenate([mixed(feature + np.uint64(7)), words])
    text = np.concatenate([text, of])
    key = np.unique(text.astype(np.int64) << BITS | (feature >> np.uint64(64 - BITS)).astype(np.int64)) if len(text) else np.zeros(0, np.int64)
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass(frozen=True)
class DocumentModel:
    """Log odds of good: bias, and the weight of each hashed feature."""

    bias: float
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        feature, text = features(*text_bytes(texts))
        scale = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))
        return self.bias + np.bincount(text, self.weights[feature] * scale[text], minlength=len(texts))


def fit_document_model(rows: list[np.ndarray], good: np.ndarray, rounds: int = 80, rate: float = 0.5, shrink: float = 1e-4, part: int = 2000) -> DocumentModel:
    """Logistic regression on the features of labelled texts, each text's weights scaled by its number of features, by full
    gradient steps over parts of the texts. Without texts, or with one class only, the model knows nothing: weights are 0."""
    many = len(good)
    if not many or good.all() or not good.any():
        return DocumentModel(0.0, np.zeros(1 << BITS))
    weights, bias, memory = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8)
    balance = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    for _ in range(rounds):
        slope, bias_slope = -shrink * weights * many, 0.0
        for k in range(0, many, part):
            count = np.array([len(r) for r in rows[k : k + part]])
            feature, text = np.concatenate(rows[k : k + part]).astype(np.int64), np.repeat(np.arange(len(count)), count)
            value = (1 / np.sqrt(np.maximum(count, 1)))[text]
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(text, weights[feature] * value, minlength=len(count)), -30, 30)))
            error = (good[k : k + part] - p) * balance[k : k + part]
            slope += np.bincount(feature, error[text] * value, minlength=1 << BITS)
            bias_slope += error.sum()
        slope /= many
        memory += slope * slope
        weights += rate * slope / np.sqrt(memory)
        bias += rate * bias_slope / many
    return DocumentModel(float(bias), weights)


def text_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) -> the columns without text, and features (two bytes each)."""
    others = [f for f in docs.schema if f.name != "text"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        feature, text = features(*text_bytes(batch.column("text")))
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        packed = [feature[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        names = [f.name for f in others]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "features"])

    return map_batches(docs, kernel, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "features binary"]), "text", 2 << 20)


def score_documents(docs: DataFrame, model: DocumentModel) -> DataFrame:
    """docs (doc_id, text, more) -> the columns without text, and evidence (double): the log odds of the whole text."""
    others = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "evidence double"])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        evidence = model.score(batch.column("text"))
        names = [f.name for f in others]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(evidence)], [*names, "evidence"])

    return map_batches(docs, kernel, schema, "text", 2 << 20)


def _strength(rates: DataFrame, parent: str) -> DataFrame:
    """One row: the strength of the beta prior around column `parent`, by moments: how much the rates of siblings vary
    beyond what counts of their size would by chance."""
    mean, p = F.col("good") / F.col("n"), _inside(F.col(parent))
    moments = rates.agg(
        F.sum(F.col("n") * (mean - p) * (mean - p)).alias("spread"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum(F.col("n") * p * (1 - p)).alias("size"),
    )
    between = F.greatest(F.col("spread") - F.col("chance"), F.lit(0.0)) / F.greatest(F.col("size") - F.col("chance"), F.lit(1e-9))
    return moments.select(F.least(F.greatest(1 / F.greatest(between, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e5)).alias("strength"))


def _inside(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))


def posterior_rate(good: Column, n: Column, parent: Column, strength: Column) -> Column:
    """Mean of the beta posterior: the parent's rate, moved by what has been counted."""
    return (good + strength * _inside(parent)) / (n + strength)


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading `www.`; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def url_path(url: Column, levels: int = 1) -> Column:
    """The first `levels` directories of a URL's path; empty for a page at the top."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.split(path, "/", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(levels), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def site_rates(judged: DataFrame) -> DataFrame:
    """(host, path, n, good, host_rate, all_rate, strength) of each site, from rows (host, path, weight, value): grouped aggregations of
    counts; paths shrink to their host's rate, hosts to the rate of all."""
    paths = cut(judged.groupBy("host", "path").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("value")).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # tables of one row
    hosts = hosts.crossJoin(F.broadcast(hosts.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("all_rate"))))
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "all_rate")))
    rated = hosts.select(F.col("host").alias("of"), "all_rate", posterior_rate(F.col("good"), F.col("n"), F.col("all_rate"), F.col("strength")).alias("host_rate"))
    both = paths.join(rated, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return both.crossJoin(F.broadcast(_strength(both, "host_rate")))


def classify(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", rows: int = LABELLED_ROWS, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, posterior, keep) for every row.

    Labels: (doc_id, quality 1 or 0); rows with a null don't count, and of repeated ids the labels all count. host and path: columns
    or expressions, as url_host and url_path of a table with URLs. Null hosts and paths are sites of their own; null texts are empty and
    judged by the features of an empty text and the site. path_rate: what the rest of its site says of a document, its own label or
    evidence left out of the path's counts (host_rate and all rates count it). posterior: the document's odds times its
    path's odds over the global odds; keep: posterior >= threshold. Without labels all evidence is 0 and all documents have
    posterior 0.5. An empty table gives no rows; texts may be as long as a value of Spark; repeated rows are rows like others;
    further columns are ignored, whatever their names.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    plain = docs.select(F.col(key).alias("doc_id"), as_column(host).alias("host"), as_column(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("of"), F.col("quality").cast("double").alias("good"))
    some = known.orderBy(F.xxhash64("of"), "of").limit(rows)
    # at most `rows` rows of two numbers
    sample = plain.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of")).select("doc_id", "text", "good")
    # what comes to the driver: at most `rows` rows of 16-bit features, a text's distinct words and rates
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "features")  # of `rows` rows at most
    sized = text_features(sample).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("sum", F.sum(F.octet_length("features")).over(order))
    taken = sized.where(F.col("sum") <= LABELLED_BYTES).drop("sum").collect()
    model = fit_document_model([np.frombuffer(r["features"], "<u2") for r in taken], np.array([r["good"] > 0.5 for r in taken], bool))
    scored = cut(score_documents(plain, model))
    odds = lambda p: F.log(p / (1 - p))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    truth = known.groupBy("of").agg(F.avg("good").alias("truth"))
    judged = scored.join(truth, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "host", "path", "evidence", F.when(F.col("truth").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT)).alias("weight"), F.coalesce("truth", logistic(F.col("evidence"))).alias("value")
    )
    sites = site_rates(judged).withColumnsRenamed({"host": "of_host", "path": "of_path"})
    out = judged.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    rest = posterior_rate(F.greatest(F.col("good") - F.col("weight") * F.col("value"), F.lit(0.0)), F.greatest(F.col("n") - F.col("weight"), F.lit(0.0)), F.col("host_rate"), F.col("strength"))
    rated = out.withColumn("path_rate", rest)
    total = F.col("evidence") + odds(F.col("path_rate")) - odds(F.col("all_rate"))
    return rated.select("doc_id", "evidence", "host_rate", "path_rate", logistic(total).alias("posterior")).withColumn("keep", F.col("posterior") >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: their source is taken as host and their language as path."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
