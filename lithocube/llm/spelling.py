"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word that becomes a word of m code points by replacing or deleting its code point at place p shares with it what stands before p and what stands
after it. The words that begin in that way are an interval of the alphabetical order, those that end in that way one of the order of the
reversed words; a wavelet tree over the words of length m, in alphabetical order with their places in the reversed order as
values, reports the points in both.

Words meet in groups: the places 0 .. m - 1 are split in cells, and a word goes to the group of each cell that has its
length m (or m + 1) and what it has before and after the cell. Two words one edit apart meet in the cell of that edit, and nowhere else if an
edit that could stand at several places counts as the first. A group too large for a task is dealt again by halves of its cell, down
to a single place, where the alphabet bounds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .arrow import give_back, slices
from .hashing import crc32_of
from .shingles import text_bytes

#: Bytes of text whose words are counted at once, entries of a group that isn't split any more, of a bucket of groups, and queries asked at once.
SLICE, GROUP, BUCKET, ASKED = 2 << 20, 20_000, 20_000, 200_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length in bytes, text number) of the maximal runs of [A-Za-z\\u00C0-\\u00FF]; the latter are C3 and one more byte."""
    lead = data == 0xC3
    inside = np.r_[False, _LETTER[data] | lead | np.r_[False, lead[:-1]], False]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def slice_words(data: np.ndarray, offsets: np.ndarray, keys: list[str], every: int, least: int) -> tuple[pa.Array, pa.Array]:
    """(word, how often) in some texts: runs, A-Z as a-z; where the CRC-32 of `key:run` is divisible by `every`, without the run's code point at
    that CRC modulo its length. Words of less than `least` code points are left out."""
    data = _LOWER[data]
    start, size, text = runs(data, offsets)
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    crc = crc32_of(data, start, size, before[text])
    leads = np.r_[0, np.cumsum(data == 0xC3)]
    length = size - (leads[start + size] - leads[start])
    hit = crc % np.uint32(every) == 0
    changed = []
    for k in np.flatnonzero(hit & (length > least)).tolist():
        word = data[start[k] : start[k] + size[k]].tobytes().decode()
        at = int(crc[k]) % len(word)
        changed.append(word[:at] + word[at + 1 :])
    keep = ~hit & (length >= least)
    start, size = start[keep], size[keep]
    ends = np.cumsum(size)
    raw = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    counted = pc.value_counts(pa.concat_arrays([words, pa.array(changed, pa.string())]))
    return counted.field("values"), counted.field("counts")


def word_counts(docs: DataFrame, every: int, least: int) -> DataFrame:
    """(word, n) of docs (doc_id, text without nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                keys = ["null" if k is None else str(k) for k in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([*slice_words(*text_bytes(part.column("text")), keys, every, least)], ["word", "n"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """Values 0 .. n - 1, each once, in some order; one level for each bit, from the highest on."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.zeros.append(np.r_[0, np.cumsum(bit == 0)])
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in least .. most - 1 at the places low .. high - 1."""
        query, base = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            shift = self.bits - 1 - level
            z_low, z_high = zeros[low], zeros[high]
            low = np.r_[z_low, zeros[-1] + low - z_low]
            high = np.r_[z_high, zeros[-1] + high - z_high]
            query, base = np.r_[query, query], np.r_[base * 2, base * 2 + 1]
            on = (low < high) & (base << shift < most[query]) & ((base + 1) << shift > least[query])
            query, base, low, high = query[on], base[on], low[on], high[on]
        return query, base


class Order:
    """Words of groups in alphabetical order within their group, with what each has in common with the word before."""

    def __init__(self, group: np.ndarray, words: list[bytes], target: np.ndarray):
        self.order = np.array(sorted(range(len(words)), key=lambda k: (group[k], words[k])), np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))[self.order]
        data = np.frombuffer(b"".join(words[k] for k in self.order.tolist()), np.uint8)
        start = np.cumsum(size) - size
        self.common = np.zeros(len(words) + 1, np.int64)
        self.common[[0, -1]] = -1
        at = np.arange(1, len(words))
        sorted_group = group[self.order]
        apart = sorted_group[1:] != sorted_group[:-1]
        self.common[1:-1][apart] = -1
        at, k = at[~apart], 0
        while len(at):
            at = at[np.minimum(size[at - 1], size[at]) > k]
            at = at[data[start[at - 1] + k] == data[start[at] + k]]
            self.common[at] += 1
            k += 1
        self.before = np.r_[0, np.cumsum(target[self.order])]  # targets before each place
        self.shared = np.maximum(self.common[:-1], self.common[1:])[self.rank]  # with any other word of the group

    def interval(self, entry: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Targets before and up to the end of those that agree with each entry in `length` code points."""
        borders = np.flatnonzero(self.common < length)
        at = np.searchsorted(borders, self.rank[entry], side="right")
        return self.before[borders[at - 1]], self.before[borders[at]]


def near_words(group: np.ndarray, words: list[bytes], m: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, entry near it) for words of groups, both ways. m, low, high: the group's length and cell; words have m or m + 1 bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    target = size == m
    forward, backward = Order(group, words, target), Order(group, [w[::-1] for w in words], target)
    in_forward = forward.order[target[forward.order]]
    in_backward = backward.order[target[backward.order]]
    place = np.empty(len(words), np.int64)
    place[in_backward] = np.arange(len(in_backward))
    tree = Wavelet(place[in_forward])
    # an edit at p leaves p code points before and size - 1 - p after it, and others must agree in them
    first = np.maximum(low, size - 1 - backward.shared)
    last = np.minimum(np.where(~target & (high == m), m, high - 1), forward.shared)
    where = np.flatnonzero(first <= last)
    held: list[tuple[np.ndarray, ...]] = []
    asked = 0

    def ask() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        entry, f_low, f_high, b_low, b_high = (np.concatenate(x) for x in zip(*held, strict=True))
        query, value = tree.report(f_low, f_high, b_low, b_high)
        one, other = entry[query], in_backward[value]
        different = one != other
        one, other = one[different], other[different]
        longer = ~target[one]
        yield np.r_[one, other[longer]], np.r_[other, one[longer]]

    for p in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in {(int(first[k]), int(last[k])) for k in where.tolist()}] or [where])).tolist():
        entry = where[(first[where] <= p) & (last[where] >= p)]
        # of a run of equal code points the first is deleted
        if p:
            entry = entry[target[entry] | (data[start[entry] + p] != data[start[entry] + p - 1])]
        for rest in np.unique(size[entry] - 1 - p).tolist():
            some = entry[size[entry] - 1 - p == rest]
            f_low, f_high = forward.interval(some, p)
            b_low, b_high = backward.interval(some, rest)
            on = (f_low < f_high) & (b_low < b_high)
            held.append((some[on], f_low[on], f_high[on], b_low[on], b_high[on]))
            asked += int(on.sum())
        if asked >= ASKED:
            yield from ask()
            held, asked = [], 0
    if held:
        yield from ask()


def cells(words: DataFrame, least: int, most: int = GROUP) -> DataFrame:
    """(word, n, m, low, high, group): each word in the groups it belongs to, none of more than `most` words but where its cell is one place."""
    size = F.length("word")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("low"), F.floor(F.col("m") / 2).cast("int").alias("high")), F.struct(F.floor(F.col("m") / 2).cast("int").alias("low"), F.col("m").alias("high"))))
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least)).alias("m")
    entries = named(words.select("word", "n", lengths).select("word", "n", "m", halves.alias("cell")).select("word", "n", "m", "cell.low", "cell.high"))
    while True:
        full = entries.where("high - low > 1").groupBy("group").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most)
        full = cut(full.select("group", F.lit(True).alias("full")))
        if full.isEmpty():
            return entries
        marked = entries.join(full, "group", "left")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        split = F.explode(F.when(F.col("full") & (F.col("high") - F.col("low") > 1), F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))).otherwise(F.array(F.struct("low", "high"))))
        entries = cut(named(marked.select("word", "n", "m", split.alias("cell")).select("word", "n", "m", "cell.low", "cell.high")))


def named(entries: DataFrame) -> DataFrame:
    """Adds group, a hash of what the words of a group have in common."""
    word: Column = F.col("word")
    tail = F.col("m") - F.col("high")
    shared = (F.substring(word, F.lit(1), F.col("low")), F.substring(word, F.length(word) - tail + 1, tail))
    return entries.withColumn("group", F.xxhash64("m", "low", "high", *shared))


def near_counts(entries: DataFrame, buckets: int) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the one of largest n (ties: smallest)."""

    def run(table_: pa.Table) -> pa.Table:
        words = [w.encode("latin-1") for w in table_.column("word").to_pylist()]
        m, low, high, n, named_ = (table_.column(c).to_numpy().astype(np.int64) for c in ("m", "low", "high", "n", "group"))
        _, group = np.unique(np.stack([named_, m, low, high]), axis=1, return_inverse=True)
        group = group.ravel()
        many = np.zeros(len(words), np.int64)
        best = np.full(len(words), -1, np.int64)
        alphabet = np.empty(len(words), np.int64)
        alphabet[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        for one, other in near_words(group, words, m, low, high):
            many += np.bincount(one, minlength=len(words))
            held = np.flatnonzero(best >= 0)
            one, other = np.r_[one, held], np.r_[other, best[held]]
            order = np.lexsort((alphabet[other], -n[other], one))
            one, other = one[order], other[order]
            lead = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else one
            best[one[lead]] = other[lead]
        on = np.flatnonzero(many)
        column = table_.column("word")
        give_back()
        return pa.table({"word": column.take(pa.array(on)), "n_near": many[on], "best_n": n[best[on]], "best": column.take(pa.array(best[on]))})

    dealt = entries.withColumn("bucket", F.pmod("group", F.lit(buckets)).cast("int"))
    found = dealt.groupBy("bucket").applyInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): where following forms ends. A form is at least twice as frequent as its word, so that they end;
    every step doubles how far a word sees."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_often: int = 3, times: int = 2, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least `least_length` code points that occurs `least_often` times.

    Words are maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z as a-z; one in `every` occurrences, by the CRC-32 of `key:run`, loses a code point. Near words
    differ by one inserted, deleted or replaced code point; n_near counts them. form: the near word of largest n (ties: the
    smallest) if that is at least `times` n, else null; root: where forms lead. Null and empty texts have no words, a null key counts as the word
    null, repeated rows count again, an empty table gives no rows, further columns are ignored. Texts and words may be as long as a value of Spark.
    """
    if least_length < 2 or times < 2:
        raise ValueError("least_length and times: 2 or more")
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = cut(word_counts(plain, every, least_length).where(F.col("n") >= least_often))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = cells(words, least_length, group)
    near = near_counts(entries, max(partitions, -(-4 * words.count() // BUCKET)))
    form = F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best.best"))
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.minus")).alias("form_n")))
    roots = last_forms(known.where("form is not null").select("word", "form"))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
