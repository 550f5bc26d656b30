"""The training-data operators against brute force, the tokenizers' own libraries, and odd tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithocube.llm import chat, esais, media, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, sharding, suffix_dedup, tiff, token_counts
from lithocube.llm.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank int, size int, copies int, page int, features int, bucket int, _words string, _id int, _copy int, kept string, words int, `row` int"
LONG = "lorem ipsum dolor sit amet consectetur " * 400
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, LONG), (6, LONG), (None, "x y z"), (7, "é漢字 <|endoftext|> ▁ \x00"), (8, "a" * 3000), (9, "one two three four five six seven eight nine ten eleven")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else f"s{k % 4}", 1, 2, 3, 4, 5, 6, 7, 8, 'w', 9, 10, 'own', 11, 12) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, wanted = queries()[name](spark, DATA).toPandas(), con.sql(oracle_sql()[name]).df()
    # a column of whole numbers and nulls comes as floats from one engine
    one = lambda v: "~" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float | int) and not isinstance(v, bool) else str(v)
    line = lambda f: sorted(tuple(map(one, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(wanted.columns) and line(got) == line(wanted)


# suffix arrays and dedup


def brute_suffixes(b):
    order = sorted(range(len(b)), key=lambda i: b[i:])
    common = [0] * len(b)
    for k in range(1, len(b)):
        x, y = b[order[k - 1] :], b[order[k] :]
        common[k] = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return order, common


@pytest.mark.parametrize("memory", [1 << 28, 64, 4000])
def test_suffix_arrays(memory):
    rng = random.Random(memory)
    for _ in range(150):
        n, a = rng.randrange(1, rng.choice([5, 60, 400])), rng.choice([1, 2, 3, 256])
        b = bytes(rng.randrange(a) for _ in range(n))
        b = (b[: n // 3 + 1] * 4 + b)[:500] if rng.random() < 0.4 else b
        with esais.Scratch(memory) as scratch:
            got = esais.suffix_lcp(np.frombuffer(b, np.uint8), scratch)
            assert (got[0].tolist(), got[1].tolist()) == brute_suffixes(b)


def brute_removed(texts, length=100):
    seen, out = set(), {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_op1(spark, texts):
    wanted = brute_removed(sorted((i, t.encode()) for i, t in texts.items()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op1_suffix_array_dedup(spark, DATA).collect()}
    assert got == wanted


def test_op1_on_disk(spark):
    """All texts of sf0.01 with shards of at most 64 KiB in memory: the same rows as with all of it."""
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    little, much = (suffix_dedup.remove_repeats(docs, memory=m).select("doc_id", "n_bytes", "spans", "kept") for m in (1 << 16, suffix_dedup.MEMORY))
    line = lambda r: (r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept))
    assert sorted(map(line, little.collect())) == sorted(map(line, much.collect()))


@pytest.mark.parametrize("length", [1, 31, 32, 287, 288, 400])
def test_dedup_of_any_length(spark, length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(40)]
    base = " ".join(rng.choice(words) for _ in range(500))
    rows = []
    for i in range(60):
        a = rng.randrange(1000)
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))) + base[a : a + rng.randrange(2500)]))
    rows += [(100, rows[7][1]), (100, rows[7][1]), (3, rows[9][1])]
    wanted = brute_removed(sorted(((i, t.encode()) for i, t in rows[:60])), length)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows[:60], "doc_id long, text string").repartition(5), length).collect()
    line = lambda r: (r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
    assert {r.doc_id: line(r) for r in got} == wanted
    more = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length, payload=("text",)).collect()
    assert sorted((r.doc_id, r.text) for r in more) == sorted(rows)
    assert all(not r.kept for r in more if r.doc_id == 100)


def test_dedup_refuses_what_it_can_not_do(odd):
    for bad in ({"length": 0}, {"payload": ("kept",)}):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(odd, **bad)


SORT = """
import resource, sys
import numpy as np
from lithocube.llm import esais
data = np.memmap(sys.argv[1], np.uint8, "r")
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with esais.Scratch(int(sys.argv[2])) as s:
    order, common = esais.suffix_lcp(data, s)
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    print(peak - start, s.depth, s.spilled, s.files)
    np.asarray(order).astype("<i8").tofile(sys.argv[3])
    np.asarray(common).astype("<i8").tofile(sys.argv[4])
"""


def test_shard_of_twenty_times_the_memory(tmp_path):
    """Sorted in memory of 128 KiB, a text of 2.7 MB takes less than 24 MB more of memory (mapped pages included; arrays in memory would be
    some hundred), goes to disk, recurses to level 3 at least, and gives what a sort in memory gives."""
    import os
    import subprocess
    import sys

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    parts, size = [], 0
    while size < 2_700_000:
        parts.append(" ".join(rng.choices(words, k=100)) if rng.random() > 0.2 or not parts else rng.choice(parts))
        parts += ["-" * rng.randrange(3000)] if rng.random() < 0.02 else []
        size = sum(map(len, parts[-2:])) + size
    (tmp_path / "text").write_bytes("\n".join(parts).encode())
    env = {**os.environ, "PYTHONPATH": str(__import__("pathlib").Path(__file__).parents[2])}
    out = []
    for k, memory in enumerate((128 << 10, 1 << 30)):
        made = [str(tmp_path / f"{name}{k}") for name in ("order", "common")]
        out.append([int(x) for x in subprocess.run([sys.executable, "-c", SORT, str(tmp_path / "text"), str(memory), *made], env=env, capture_output=True, text=True, check=True, timeout=900).stdout.split()])
    assert out[0][0] < 24_000 and out[0][1] == out[1][1] >= 3 and out[0][2] > 20e6 and out[1][2:] == [0, 0]
    for name in ("order", "common"):
        assert (tmp_path / f"{name}0").read_bytes() == (tmp_path / f"{name}1").read_bytes()


def test_shard_in_little_memory(spark, texts):
    """The windows found don't depend on how much of a shard is held."""
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    runs = suffix_dedup.repeated_runs(suffix_dedup.run_blocks(rows, 100, 2), 2)
    strings = suffix_dedup.shard_strings(suffix_dedup.text_rows(rows, 2), runs, 100, 2)
    found = []
    for memory in (1 << 28, 1 << 16):
        windows = set()
        for r in suffix_dedup.removed_windows(strings, 100, 2, memory).collect():
            starts, counts = (suffix_dedup.unpack(bytes(r[c]), 5).tolist() for c in ("starts", "counts"))
            for k, (s, c) in enumerate(zip(starts, counts, strict=True)):
                windows |= {(bytes(r.digests)[16 * k : 16 * k + 16], w) for w in range(s, s + c)}
        found.append(windows)
    assert found[0] == found[1] and found[0]


def test_dedup_of_odd_tables(odd, empty):
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(odd).collect())
    assert len(got) == len(ODD)
    assert [k for i, n, k in got if i == 6] == [0, 0]  # copies of 5
    assert [(n, k) for i, n, k in got if i == 8] == [(3000, 1)]  # all windows but the first go, and with them all bytes but the first
    assert suffix_dedup.remove_repeats(empty).count() == 0
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(odd, as_text=True).collect()}
    assert kept[7] == ODD[8][1] and kept[1] == ""


# sharding and mixing


def brute_shard(key, weights):
    """The highest -w / ln(u), u from 48 bits of the md5 of key and shard."""
    import math

    scores = []
    for shard, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:12], 16) + 0.5) / 16.0**12
        scores.append((-w / math.log(u), -shard))
    return -max(scores)[1]


def test_op2(spark, texts):
    rows = sharding.op2_rendezvous_sharding(spark, DATA).collect()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, [1] * 8), brute_shard(r.doc_id, [1] * 9))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_weights_pull_rows_only_to_their_shard(spark):
    ids = spark.range(4000).select(F.col("id"), sharding.rendezvous_shard(F.col("id"), [1, 1, 1]).alias("a"), sharding.rendezvous_shard(F.col("id"), [1, 2, 1]).alias("b")).collect()
    assert all(r.a == r.b or r.b == 1 for r in ids)
    n = Counter(r.b for r in ids)
    assert abs(n[1] / 4000 - 0.5) < 0.04


def test_sharding_of_odd_tables(odd, empty):
    rows = sharding.shard_documents(odd, [1.0] * 3).collect()
    assert len(rows) == len(ODD) and sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for _, t in ODD)
    assert len({(r.shard, r.slot) for r in rows}) == len(ODD)
    assert sharding.shard_documents(empty, [1.0]).count() == 0


def test_op5(spark):
    rows = mixing.op5_systematic_mixing(spark, DATA).collect()
    assert rows == mixing.op5_systematic_mixing(spark, DATA).collect() or sorted(rows) == sorted(mixing.op5_systematic_mixing(spark, DATA).collect())
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r.size
        by[(r.source_size, r.target)].append(r)
    for (_, target), some in by.items():
        assert abs(sum(r.taken for r in some) - target) <= 2 * max(r.size for r in some)


def test_targets_fill_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 40}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight, total = {"a": 5, "b": 2, "c": 1, None: 5}, sum(sizes.values())
    target, full = {}, set()
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        share = {k: left * weight[k] / sum(weight[j] for j in sizes if j not in full) for k in sizes if k not in full}
        over = {k for k, v in share.items() if v > 3 * sizes[k]}
        if not over:
            target = {**{k: 3.0 * sizes[k] for k in full}, **share}
            break
        full |= over
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in target.items()}


def test_mixing_of_odd_tables(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.copies >= 0 for r in rows)
    assert mixing.mix(empty).count() == 0
    assert all(r.copies == 0 for r in mixing.mix(odd.where("doc_id < 4")).collect())  # no words at all


# n-gram join


def brute_links(texts, width, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root, ids = {i: i for i in sets}, sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, texts, width, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, width, num, 100).collect()}
    assert got == brute_links(texts, width, num, 100)


def near_and_far(rng, groups=4, each=40):
    """Groups of near copies, some of them on the edge of linking, and texts that share a part only."""
    texts = []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(80)]
        for _ in range(each):
            rate = rng.choice([0.0, 0.01, 0.01, 0.02, 0.04])
            texts.append(" ".join(w if rng.random() > rate else f"v{rng.randrange(50)}" for w in base))
        texts += [" ".join(base[:k] + [f"u{g}x{j}" for j in range(80 - k)]) for k in (20, 50, 70, 75)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("block", [4, 16, 2048])
@pytest.mark.parametrize("seed", [2, 3])
def test_large_components_go_in_blocks(spark, monkeypatch, block, seed):
    """Within blocks, between representatives and between the rest: small blocks need all three."""
    texts = near_and_far(random.Random(seed))
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(rows, 4, 85, 100).collect()}
    assert got == brute_links(texts, 4, 85, 100)


def test_partitions_that_look_alike(spark):
    """The same texts in two partitions; one text that fills two partitions beside one that doesn't link with it."""
    texts = list(near_and_far(random.Random(5), 3, 10).values())
    twice = {k: t for k, t in enumerate(texts + texts)}
    far = [f"w{k}" for k in range(60)]
    full = {k: " ".join(far) for k in range(20)} | {20: " ".join(far[:45] + [f"z{k}" for k in range(15)])}
    parts = lambda rows, n: spark.sparkContext.parallelize(rows, n).toDF("doc_id long, text string")
    tables = [
        (twice, parts(list(twice.items()), 2)),
        (twice, parts(list(twice.items())[: len(texts)], 1).union(parts(list(twice.items())[len(texts) :], 1))),
        (full, parts(list(full.items())[:10], 1).union(parts(list(full.items())[10:20], 1)).union(parts(list(full.items())[20:], 1))),
        (twice, parts(list(twice.items()), 2).repartition(5)),
    ]
    for wanted, rows in tables:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(rows, 4, 85, 100).collect()}
        assert got == brute_links(wanted, 4, 85, 100)
    once = ngram_join.ngram_jaccard_join(tables[1][1].union(tables[1][1]), 4, 85, 100).distinct()  # a table read twice
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in once.collect()} == brute_links(twice, 4, 85, 100)


def test_flush_of_other_sets_is_refused(spark):
    rows = spark.createDataFrame([(1, d, None, None, b"", b"") for d in (5, 6)], ngram_join.REPLIES)
    with pytest.raises(Exception, match="another order"):
        ngram_join.candidate_sets(rows, 85, 100).collect()


def test_one_shingle_of_many_sets_that_do_not_link(spark):
    """50,000 sets hold one shingle and link with nothing else; three near copies among them do."""
    own = spark.range(50_000).select("id", F.concat(F.lit("a b c d "), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % (997 + k)) for k in range(8)])).alias("text"))
    near = spark.createDataFrame([(60_000 + k, "q " * 3 + " ".join(f"z{j}" for j in range(60)) + f" end{k}") for k in range(3)], "id long, text string")
    got = ngram_join.ngram_jaccard_join(own.union(near), 4, 85, 100, key="id")
    assert [r.component_id for r in got.where("doc_id >= 60000").collect()] == [60_000] * 3
    assert got.where("doc_id < 60000 and component_id <> doc_id").count() == 0


def test_ngram_join_of_odd_tables(odd, empty):
    rows = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert [r.component_id for r in rows if r.doc_id == 6] == [5, 5]
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


# tokenizers


def fuzz(parts, n=1500, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_token_counts(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    some = [*texts.values(), *fuzz([*"ab  \n\t\x1c\x85\xa0'sdm12é漢👍½!_", "<|endoftext|>", "'ll", " the", "aaaa"]), "a" * 5000]
    assert token_counts.Counter(path)(some) == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_token_counts_of_odd_tables(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd, path).collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (1, 2)] == [(0, 0, False)] * 2
    assert len(rows) == len(ODD) and token_counts.count_tokens(empty, path).count() == 0


def test_sentencepiece(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    some = [*texts.values(), *fuzz([*"abe  \n\t▁é漢👍\x00.,!", "   ", "<s>", "<0x0A>", " the", "ing"]), "a" * 3000]
    ids, count = own.encode(some)
    split = [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    assert split == lib.encode(some)
    assert [own.model.decode(x) for x in split] == lib.decode(lib.encode(some))


def test_sentencepiece_of_odd_tables(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(odd, path), path).collect()
    assert {r.doc_id: r.decoded for r in rows}[5] == LONG and {r.doc_id: (r.ids, r.decoded) for r in rows}[1] == ([], "")
    assert len(rows) == len(ODD) and sentencepiece_codec.encode_texts(empty, path).count() == 0


# chat


def test_chat_folds_events(spark):
    rows = [(1, 1, 1, "delta", "user", "Hi <|im_end|> \\ <\\|"), (1, 2, 2, "delta", "assistant", "wro"), (1, 2, 3, "delta", None, "ng"), (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, "ri"), (1, 2, 6, "delta", None, "ght"), (1, 1, 7, "edit", None, "Hello"), (1, 3, 8, "delta", "user", "bye"), (1, 3, 9, "delete", None, None), (1, 4, 10, "odd", "user\nx", None), (None, None, 1, "delta", "assistant", "<|")]
    events = spark.createDataFrame(rows, "conv_id long, message_id long, seq long, kind string, role string, text string")
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.trained) for r in chat.parse(chat.format_chats(events)).collect()}
    assert back == {1: ([("user", "Hello"), ("assistant", "right")], ["right"]), None: ([("assistant", "<|")], ["<|"])}
    assert chat.format_chats(events.limit(0)).count() == 0


def test_log_of_a_conversation_tells_its_whole_story(spark):
    """The log has several deltas a text, drafts, edits, regenerations and deletions; in any order of rows it folds back."""
    said = [(1, t, "user" if t % 2 else "assistant", f"{t}" * (t * 150)) for t in range(12)] + [(None, 1, None, None), (2, None, "user", "a"), (2, None, "user", "a")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    log = chat.messages_to_events(rows)
    kinds = Counter(r.kind for r in log.collect())
    assert set(kinds) == {"delta", "edit", "regenerate", "delete"} and kinds["delta"] > 2 * len(said)
    shuffled = log.withColumn("kept", F.lit(1)).orderBy(F.md5(F.concat_ws(":", "conv_id", "seq")))
    back = {(r.conv_id, r.message_id): (r.role, r.text) for r in chat.fold_events(shuffled).collect()}
    assert back == {**{(1, t + 1): (r, x) for c, t, r, x in said[:12]}, (None, 1): ("", ""), (2, 1): ("user", "a"), (2, 2): ("user", "a")}


def test_escape_round_trip(spark):
    some = fuzz([*"\\<|>n\n a", "<|", "<\\|", "<\\n"], 800)
    df = spark.createDataFrame([(t,) for t in some], "t string")
    got = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u == r.r and "<|" not in r.e for r in got)


# media


def test_known_packbits_and_lzw():
    """The examples of the published descriptions of both."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, len(plain)) == plain and tiff.packbits_decode(tiff.packbits_encode(np.frombuffer(plain, np.uint8)[None]), len(plain)) == plain
    codes, plain = [256, 7, 258, 8, 8, 258, 6, 6, 257], bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed, 9) == plain and tiff.lzw_encode(plain) == packed


def by_hand(fields, blocks=b"", order=">"):
    """A file of one directory made here, not by the writer: (tag, kind, values), values that don't fit stand behind it."""
    head = struct.pack(order + "2sHI", b"MM" if order == ">" else b"II", 42, 8)
    body, extra, at = b"", b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, len(values), at + len(extra))
            extra += raw
        else:
            body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack(order + "H", len(fields)) + body + struct.pack(order + "I", 0) + extra + blocks


@pytest.mark.parametrize("order", ["<", ">"])
def test_file_made_by_hand(order):
    """Strips in LZW with horizontal differences: rows 10 11 13 and 7 7 7."""
    fields = lambda at: [(256, 3, [3]), (257, 3, [2]), (258, 3, [8]), (259, 3, [5]), (262, 3, [1]), (273, 4, at), (277, 3, [1]), (278, 3, [1]), (279, 4, [6, 6]), (317, 3, [2])]

    def lzw(values):
        bits = "".join(f"{c:09b}" for c in [256, *values, 257])
        return int(bits.ljust(48, "0"), 2).to_bytes(6, "big")

    start = len(by_hand(fields([0, 0]), order=order))
    data = by_hand(fields([start, start + 6]), lzw([10, 1, 2]) + lzw([7, 0, 0]), order)
    assert tiff.read_tiff(data)[0].samples.tolist() == [[10, 11, 13], [7, 7, 7]]


@pytest.mark.parametrize(
    "change",
    [{256: [0]}, {257: [0]}, {256: [4_000_000_000]}, {278: [0]}, {279: [4_000_000]}, {273: [9_999_999]}, {259: [77]}, {258: [16]}, {322: [0], 323: [16], 324: [8], 325: [4]}, {322: [4_000_000_000], 323: [4_000_000_000], 324: [8], 325: [4]}, {273: [8, 8]}],
)
def test_damaged_sizes_give_errors(spark, change):
    fields = {256: [4], 257: [1], 258: [8], 259: [1], 273: [8], 277: [1], 278: [1], 279: [4]} | change
    data = by_hand([(tag, 4, v) for tag, v in fields.items()])
    assert isinstance(tiff.read_each(data)[0], ValueError)


def test_inflated_data_are_bounded():
    bomb = zlib.compress(bytes(50_000_000), 9)
    assert tiff.decode_block(bomb, (2, 3), tiff.DEFLATE, 1).tolist() == [[0] * 3] * 2


def test_tiff_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, rng.choice([2, 4, 256]), (int(rng.integers(1, 300)), int(rng.integers(1, 200)))).astype(np.uint8)
        pages = [tiff.Page(a, c, p, t, int(rng.integers(1, 100))) for c in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (None, (16, 32))]
        back = tiff.read_tiff(tiff.write_tiff(pages, rng.choice(["<", ">"])))
        assert len(back) == len(pages) and all((p.samples == q.samples).all() for p, q in zip(pages, back, strict=True))


def test_op8(spark, texts):
    ways, pages = set(), set()
    for r in media.op8_media_tiff(spark, DATA).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        file = media.payload_file(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        ways |= set(r.layout.split("|"))
        said = [dict(x.split("=") for x in page.split(";")) for page in r.feature.split("|")]
        assert sum(int(x["h"]) for x in said) * 64 == len(padded) and sum(int(x["sum"]) for x in said) == sum(padded) and sum(int(x["sq"]) for x in said) == sum(b * b for b in padded)
        pages.add(len(said))
    assert pages == {1, 2, 3} and {"lzw/2/true", "lzw/2/false", "packbits/1/false", "deflate/2/true"} <= ways


def test_media_of_odd_tables(spark, odd, empty):
    pages = media.read_pages(media.store_texts(odd))
    assert pages.where("page = 0").count() == len(ODD) < pages.count() and pages.where("error is not null").count() == 0
    whole = media.joined_pages(pages.withColumn("name", F.sha2("tiff", 256)), ["doc_id", "n_bytes", "name"]).collect()
    assert sorted((r.doc_id or 0, len(r.samples)) for r in whole) == sorted((i or 0, -(-max(1, len((t or "").encode())) // 64) * 64) for i, t in ODD)
    assert media.read_pages(media.store_texts(empty)).count() == 0
    two = tiff.write_tiff([tiff.Page(np.zeros((3, 4), np.uint8)), tiff.Page(np.ones((2, 2), np.uint8))])
    files = spark.createDataFrame([(1, bytearray(two)), (2, bytearray(b"no")), (3, None), (4, bytearray(two[:-9]))], "id int, tiff binary")
    got = sorted((r.id, r.page if r.page is not None else -1, r.error is None) for r in media.read_pages(files).collect())
    assert got == [(1, 0, True), (1, 1, True), (2, -1, False), (4, -1, False)]


def test_unreadable_page_leaves_the_others(spark):
    three = bytearray(tiff.write_tiff([tiff.Page(np.full((3, 4), k, np.uint8)) for k in range(3)]))
    entry = struct.pack("<HHI", tiff.BITS, 3, 1)
    second = three.index(entry, three.index(entry) + 1)
    struct.pack_into("<H", three, second + 8, 16)
    files = spark.createDataFrame([(1, three)], "id int, tiff binary")
    got = sorted((r.page, None if r.samples is None else set(r.samples), r.error is None) for r in media.read_pages(files).collect())
    assert got == [(0, {0}, True), (1, None, False), (2, {2}, True)]


# quality


def brute_base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op10_statistics(spark, texts):
    for r in quality_rules.op10_quality_rules(spark, DATA).collect():
        n, chars, signs, dups, repeats = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, signs, dups, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)


def brute_features(text):
    n, chars, signs, dups, repeats = brute_base(text)
    w, text = WORD.findall(text or ""), text or ""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = lambda of: sum(text.count(c) for c in of)
    per = lambda a, b: a / b if b else 0.0
    return {
        "n_words": n, "mean_word": per(chars, n), "symbol_rate": per(signs, n), "dup_line_rate": per(dups, len(lines)), "repeat_rate": per(repeats, n),
        "upper_rate": per(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), "punct_rate": per(count("!?;:=/\\@_~^{}[]()\""), n), "digit_rate": per(count("0123456789"), chars),
        "distinct_rate": per(len(set(w)), n), "solo_rate": per(sum(len(x) == 1 for x in w), n),
    }


def rejected(text, rules):
    f = brute_features(text)
    n, repeats = f["n_words"], brute_base(text)[4]
    holds = lambda r: all(f[a] > t if s == ">" else f[a] <= t for a, s, t in r.conditions)
    return n < 10 or 100 * repeats > 20 * n or any(holds(r) for r in rules)


def test_op10_verdict(spark, texts):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality_rules.learn_rules(docs, labels)
    # a list of several conditions too, whatever these labels teach
    rules = [*rules, quality_rules.Rule((("mean_word", ">", 5.2), ("punct_rate", "<=", 0.05)), 0, 0.0), quality_rules.Rule((("digit_rate", ">", 0.01), ("upper_rate", "<=", 0.03)), 0, 0.0)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, rules).select("doc_id", "kept").collect()}
    assert got == {i: not rejected(t, rules) for i, t in texts.items()} and len(set(got.values())) == 2


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.learn_decision_list(x, bad)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit == bad).mean() > 0.97 and "reject if" in str(rules[0])
    assert quality_rules.learn_decision_list(x, np.zeros(600, bool)) == []


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(9, 1, 0), (5, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.apply_rules(odd, quality_rules.learn_rules(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(brute_base(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert quality_rules.apply_rules(empty, []).count() == 0
    assert quality_classifier.classify(odd, labels).count() == len(ODD)
    assert quality_classifier.classify(empty, labels).count() == 0
    assert {r.evidence for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.0}


def test_sites_shrink_to_their_parents(spark):
    """Rates of sites, sparse ones among them, against the formula in numpy; then a document's posterior without its own part."""
    rng = np.random.default_rng(7)
    sites = [(f"h{h}", f"p{p}", int(n)) for h in range(6) for p, n in enumerate(rng.choice([1, 2, 40, 300], 5))]
    rows = []
    for h, p, n in sites:
        good = rng.beta(2 + 3 * (h in ("h1", "h2")), 3)
        rows += [(h, p if p != "p4" else None, 1.0 if rng.random() < 0.5 else 0.25, float(rng.random() < good)) for _ in range(n)]
    got = {(r.host, r.path): r for r in quality_classifier.site_rates(spark.createDataFrame(rows, "host string, path string, weight double, value double")).collect()}
    n, good = defaultdict(float), defaultdict(float)
    for h, p, w, v in rows:
        n[h, p] += w
        good[h, p] += w * v
    hosts = sorted({h for h, _ in n})
    hn, hg = (np.array([sum(x[k] for k in n if k[0] == h) for h in hosts]) for x in (n, good))
    inside = lambda p: np.clip(p, 1e-4, 1 - 1e-4)

    def strength(n, good, parent):
        p = inside(parent)
        spread, chance, size = (n * (good / n - p) ** 2).sum(), (p * (1 - p)).sum(), (n * p * (1 - p)).sum()
        between = max(spread - chance, 0) / max(size - chance, 1e-9)
        return min(max(1 / max(between, 1e-6) - 1, 1.0), 1e5)

    whole = np.full(len(hosts), (hg.sum() + 1) / (hn.sum() + 2))
    k = strength(hn, hg, whole)
    rate = dict(zip(hosts, (hg + k * inside(whole)) / (hn + k), strict=True))
    keys = sorted(n, key=str)
    pn, pg, parent = np.array([n[k] for k in keys]), np.array([good[k] for k in keys]), np.array([rate[k[0]] for k in keys])
    k2 = strength(pn, pg, parent)
    for key, a, b, p in zip(keys, pn, pg, parent, strict=True):
        r = got[key]
        assert np.allclose([r.n, r.good, r.host_rate, r.strength], [a, b, p, k2])
        made = (b + k2 * p) / (a + k2)
        assert min(b / a, p) - 1e-9 <= made <= max(b / a, p) + 1e-9
    sparse = [abs((b + k2 * p) / (a + k2) - p) <= abs(b / a - p) * a / (a + k2) + 1e-9 for a, b, p in zip(pn, pg, parent, strict=True)]
    assert all(sparse)


def test_classifier_takes_hosts_and_paths_of_urls(spark):
    rows = [("http://WWW.a.org/x/y/1.html?q=/z",), ("https://u:p@b.net:8080/",), ("ftp://c.com",), ("no url",), (None,), ("http://a.org/x/",)]
    got = spark.createDataFrame(rows, "url string").select(quality_classifier.url_host(F.col("url")).alias("h"), quality_classifier.url_path(F.col("url")).alias("p"), quality_classifier.url_path(F.col("url"), 2).alias("q")).collect()
    assert [tuple(r) for r in got] == [("a.org", "x", "x/y"), ("b.net", "", ""), ("c.com", "", ""), (None, "", ""), (None, None, None), ("a.org", "x", "x")]
    # two hosts of the same words: labels of one are bad throughout
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id") % 7).alias("text"), F.concat(F.when(F.col("id") % 2 == 0, "http://good.org/a/").otherwise("http://bad.org/b/"), "id").alias("url"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).alias("quality"))
    out = quality_classifier.classify(docs, labels, quality_classifier.url_host(F.col("url")), quality_classifier.url_path(F.col("url")))
    right = out.where("doc_id >= 100").agg(F.avg((F.col("keep") == (F.col("doc_id") % 2 == 0)).cast("double"))).first()[0]
    assert right > 0.95 and out.count() == 400


def brute_posteriors(rows):
    """(host_rate, path_rate, posterior) of rows (host, path, label or None, evidence), in numpy."""
    inside = lambda p: np.clip(p, 1e-4, 1 - 1e-4)

    def strength(n, good, parent):
        p = inside(parent)
        spread, chance, size = (n * (good / n - p) ** 2).sum(), (p * (1 - p)).sum(), (n * p * (1 - p)).sum()
        return min(max(1 / max(max(spread - chance, 0) / max(size - chance, 1e-9), 1e-6) - 1, 1.0), 1e5)

    each = [(h, p, 1.0 if t is not None else 0.25, t if t is not None else 1 / (1 + np.exp(-e))) for h, p, t, e in rows]
    sites, hosts = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for h, p, w, v in each:
        sites[h, p] += (w, w * v)
        hosts[h] += (w, w * v)
    hn, hg = np.array(list(hosts.values())).T
    whole = (hg.sum() + 1) / (hn.sum() + 2)
    k = strength(hn, hg, np.full(len(hn), whole))
    host_rate = dict(zip(hosts, (hg + k * inside(whole)) / (hn + k), strict=True))
    sn, sg = np.array(list(sites.values())).T
    k = strength(sn, sg, np.array([host_rate[h] for h, _ in sites]))
    out, odds = [], lambda p: np.log(p / (1 - p))
    for (h, p, w, v), (*_, e) in zip(each, rows, strict=True):
        n, good = sites[h, p]
        rate = (max(good - w * v, 0) + k * inside(host_rate[h])) / (max(n - w, 0) + k)
        out.append((host_rate[h], rate, 1 / (1 + np.exp(-(e + odds(rate) - odds(whole))))))
    return out


def test_op9_posteriors(spark, docs):
    """Every row's rates and posterior from its evidence, its site and the labels, against numpy."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = defaultdict(list)
    for r in labels.where("quality is not null").collect():
        known[r.doc_id].append(r.quality)
    site = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    got = quality_classifier.op9_quality_classifier(spark, DATA).collect()
    rows = [(*site[r.doc_id], np.mean(known[r.doc_id]) if r.doc_id in known else None, r.evidence) for r in got]
    assert len(got) == len(site)
    for r, wanted in zip(got, brute_posteriors(rows), strict=True):
        assert np.allclose((r.host_rate, r.path_rate, r.posterior), wanted, atol=1e-9) and r.keep == (r.posterior >= 0.5)


def test_classifier_is_fitted_on_bounded_bytes(spark, docs, monkeypatch):
    seen, real = [], quality_classifier.fit_document_model
    monkeypatch.setattr(quality_classifier, "fit_document_model", lambda f, g: (seen.append(sum(x.nbytes for x in f)), real(f, g))[1])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    quality_classifier.classify(docs, labels)
    monkeypatch.setattr(quality_classifier, "LABELLED_BYTES", seen[0] // 3)
    quality_classifier.classify(docs, labels)
    assert 0 < seen[1] <= seen[0] // 3


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = got.agg(F.avg(((F.col("quality") == 1) == F.col("keep")).cast("double"))).first()[0]
    assert right > 0.93


# pipeline


def test_pipeline_stages(spark, odd, empty, docs):
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, DATA)
        if k < 4:
            assert set(now.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        now = spark.createDataFrame(now.collect(), now.schema)
    assert now.count() and now.where("not round_trip").count() == 0
    for table in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA).collect()
            assert not (table is empty and out)
    passed = corpus_pipeline.rules(spark, odd, DATA)
    assert passed.columns == odd.columns and {r.kept for r in passed.collect()} <= {"own"}
    assert corpus_pipeline.near_duplicates(spark, odd, DATA).columns == odd.columns


def test_rows_of_the_stages(spark, docs):
    """Each stage's rows against brute force on the same input."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    schema = docs.schema
    # rules: the base rules and the learned ones on statistics made here
    learned = quality_rules.learn_rules(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = [r for r in rows if not rejected(r[1], learned)]
    got = corpus_pipeline.rules(spark, docs, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(kept)
    # near duplicates: the smallest id of each component
    links = brute_links({r[0]: r[1] for r in kept}, 5, 80, 100)
    first = [r for r in kept if links[r[0]][0] == 0 or links[r[0]][1] == r[0]]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, schema), DATA).collect()
    assert sorted(map(tuple, got)) == sorted(first)
    # passages: bytes covered by earlier strings of 100, drawn in to whole characters
    spans, seen = {}, set()
    for i, text, *_ in sorted(first):
        b = text.encode()
        gone = bytearray(len(b) + 1)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        found, k = [], 0
        while k < len(b):
            if gone[k]:
                e = gone.index(0, k)
                x, y = k, e
                while x < y and b[x] & 0xC0 == 0x80:
                    x += 1
                while x < y < len(b) and b[y] & 0xC0 == 0x80:
                    y -= 1
                found += [(x, y)] if x < y else []
                k = e
            k += 1
        spans[i] = found
    left = []
    for i, text, lang, source, _ in first:
        b, at = text.encode(), [0, *(x for s in spans[i] for x in s), None]
        cut = b"".join(b[x:y] for x, y in zip(at[::2], at[1::2], strict=True)).decode()
        if not spans[i] or cut.strip(" "):
            left.append((i, cut, lang, source, len(cut)))
    got = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(first, schema), DATA).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in got) == sorted(left)
    # mixture: as often as the systematic sample takes each
    table = spark.createDataFrame(left, schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(table).collect()}
    got = Counter(tuple(r) for r in corpus_pipeline.mixture(spark, table, DATA).collect())
    assert got == Counter({r: copies[r[0]] for r in left if copies[r[0]]})
