"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrow import map_batches

#: Fixed value: the split pattern of byte-level BPE files with use_regex, its white space written as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Counts of pre-tokens a worker keeps, and the longest pre-token it keeps one for.
KEPT, KEPT_CHARS = 1_000_000, 48
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level files write bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Ranks of pairs as sorted arrays. Symbols are vocabulary ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normalizer is asked for")
        vocab = model["vocab"]
        self.prefix_space = bool(pre.get("add_prefix_space"))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_alphabet().items():
            self.byte_ids[byte] = vocab[char]
        self.size = len(vocab) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks, self.made = keys, first.astype(np.int32), made[first]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token. In every round each sequence applies its own pair of lowest rank, at all its places
        from the left on; sequences without a mergeable pair leave the arrays."""
        out = np.zeros(len(tokens), np.int64)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        out[:] = sizes
        while len(sym) > 1:
            same = seq[:-1] == seq[1:]
            key = np.where(same, sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            padded = np.r_[rank, NONE]
            lowest = np.minimum.reduceat(padded, starts)  # the pair across a border has rank NONE
            lengths = np.diff(np.r_[starts, len(sym)])
            spread = np.repeat(lowest, lengths)
            hit = (padded == spread) & (padded != NONE)
            alone = np.flatnonzero(hit)
            if not len(alone):
                break
            run_start = np.r_[True, np.diff(alone) > 1]
            offset = np.arange(len(alone)) - np.maximum.accumulate(np.where(run_start, np.arange(len(alone)), 0))
            take = alone[offset % 2 == 0]  # of a a a, the first two merge
            sym[take] = self.made[at[take]]
            keep = spread != NONE
            keep[take + 1] = False
            np.subtract.at(out, seq[take], 1)
            sym, seq = sym[keep], seq[keep]
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts texts; keeps the counts of short pre-tokens, at most KEPT of them."""

    def __init__(self, path: str):
        self.merges, self.split, self.known = load(path), regex.compile(SPLIT).findall, {}
        specials = sorted(self.merges.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def __call__(self, texts: list[str]) -> list[int]:
        parts: list[list[str]] = []
        extra = []
        for text in texts:
            pieces = self.special.split(text) if self.special else [text]
            extra.append(len(pieces) - 1)
            if self.merges.prefix_space:
                pieces = [p if not p or p[0].isspace() else " " + p for p in pieces]
            parts.append(self.split(pieces[0]) if len(pieces) == 1 else [t for p in pieces for t in self.split(p)])
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*parts) - self.known.keys())
        counts = dict(zip(new, self.merges.count([t.encode() for t in new]).tolist(), strict=True))
        self.known.update(counts)
        out = [n + sum(map(self.known.__getitem__, tokens)) for n, tokens in zip(extra, parts, strict=True)]
        for token in counts:
            if len(token) > KEPT_CHARS:
                del self.known[token]
        return out


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; `path` names the tokenizer file on every machine.

    Counts are those of the file's own library without begin and end tokens: its added tokens inside texts count as one
    token each. Null and empty texts have 0 tokens; repeated rows and null keys are rows like others; further columns
    don't matter. A worker holds one slice of texts and a bounded table of counts.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = rows.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        n_tokens = pa.array(counter(path)(texts.to_pylist()), pa.int64())
        n_bytes = pc.binary_length(texts).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = map_batches(rows, kernel, f"doc_id {key_type}, n_bytes long, n_tokens long", "text")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
