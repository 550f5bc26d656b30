"""Resampling, packing and spelling variants against brute force, the tokenizer's own library, and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithocube.llm import hashing, importance, packing, spelling

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "Lorem ipsum dolor sit amet. Consectetur " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, LONG), (6, LONG), (None, "x y zebra"), (None, "x y zebra"), (7, "é漢字 <|endoftext|> ▁ \x00"), (8, "a" * 3000), (9, "one two three four five six seven eight nine ten eleven twelve")]
CLASHES = "doc_id long, text string, n int, word int, weight int, score int, `rank` int, _row int, bucket int, n_words int, start int, length int, root int, form int, `group` int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *range(13)) for i, t in ODD], CLASHES)


def test_crc_of_many_strings():
    rng = random.Random(1)
    for longest in (5, 200):
        parts = [rng.randbytes(rng.randrange(longest)) for _ in range(200)]
        size = np.array([len(p) for p in parts])
        before = np.array([rng.randrange(1 << 32) for _ in parts], np.uint32)
        got = hashing.crc32_of(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size, before)
        assert got.tolist() == [zlib.crc32(p, int(b)) for p, b in zip(parts, before, strict=True)]
        assert hashing.crc32_of(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size).tolist() == [zlib.crc32(p) for p in parts]


# resampling


def brute_resample(rows, target, percent=10, width=1, buckets=10_000, least=20, seed=2024):
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for i, t in rows]
    features = lambda w: [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, width + 1) for k in range(len(w) - n + 1)]
    s = Counter(b for _, w in words for b in features(w))
    t = Counter(b for x in target for b in features(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, w in words:
        f = features(w)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 55, "width": 3, "buckets": 50, "least": 1}, {"percent": 100, "least": 0}, {"percent": 1, "least": 1000}])
def test_resampling(spark, docs, rows, options):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    named = {"least_words": options["least"]} if "least" in options else {}
    got = importance.resample(docs, target, **{k: v for k, v in options.items() if k != "least"}, **named)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, [r.text for r in target.collect()], **options)


def test_resampling_of_odd_tables(spark, odd):
    target = spark.createDataFrame([("zebra eleven",), (None,), ("",)], "text string")
    for t, texts in ((target, ["zebra eleven", None, ""]), (target.limit(0), [])):
        got = importance.resample(odd, t, percent=60, least_words=1).collect()
        wanted = brute_resample(ODD, texts, percent=60, least=1)
        # rows with equal keys and scores may be ranked in any order
        assert sorted((tuple(r) for r in got), key=str) == wanted
    assert importance.resample(odd.limit(0), target).count() == 0


def test_radix_selection_finds_the_kth_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1, rng.randrange(-100, 100)]), rng.randrange(3), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    order = sorted(rows)
    for k in (1, 2, 150, 299, 300):
        assert importance.radix_select(df, ["a", "b", "c"], k, bits=5) == order[k - 1]
    assert importance.radix_select(df, ["a"], 301) is None and importance.radix_select(df, ["a"], 0) is None


# packing


def padding(n, limit):
    return 0 if n & (n - 1) == 0 else limit - n


def packed(result, ids, limit):
    """Checks that pieces cover every document's ids once and fill sequences without gaps; gives the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in result:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[doc][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    lost = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
        lost += padding(at, limit)
    return lost


def library_ids(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 0] for e in made]


def test_parts_of_texts_have_their_pre_tokens():
    """Texts of signs that stand at borders: parts alone have the pre-tokens and ids that they have in their text, special strings included."""
    signs = [*"aaZst'' \n\n\t\r.,!1|<>$\x00\x1c\x7f\x0béÀ×÷ÿɏƻ«\xa0\x85\u2003\u3000“漢。字пр٣²Ⅷ😀\u200b\u0301", "'ll", " the", "<|endoftext|>", "<|endof", "text|>", "  ", " \n"]
    rng, code = random.Random(5), packing.Encoder(PATH)
    pre = lambda t: [x for x, _ in code.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    for _ in range(300):
        texts = ["x", *("".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(20))]
        whole, bounds = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)])
        cuts = [*packing.partings(np.frombuffer(whole, np.uint8), bounds).tolist(), len(whole)]
        assert set(bounds.tolist()) <= set(cuts)
        parts = [whole[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        assert [x for p in parts for x in pre(p)] == [x for t in texts for x in pre(t)]
        ids, sizes = code(pa.array(texts).slice(1))
        ends = np.cumsum(sizes)
        assert [ids[b - n : b].tolist() for n, b in zip(sizes, ends, strict=True)] == [e.ids for e in code.tokenizer.encode_batch(texts[1:], add_special_tokens=False)]


def test_library_encodes_words_once_whatever_follows_them():
    """Five texts of the same words with other signs after these: five times the words went to the library when strings between blanks were encoded."""
    words = ["".join(random.Random(k).choices("abcdefghé", k=8)) for k in range(200)]
    texts, sent = pa.array([" ".join(w + sign for w in words) for sign in (",", ".", "!?", ";", "...")]), []
    code = packing.Encoder(PATH)
    encode = code.encode_batch
    code.encode_batch = lambda parts, **options: sent.extend(map(len, parts)) or encode(parts, **options)
    ids, _ = code(texts)
    assert sum(sent) < 1.5 * sum(len(w) + 1 for w in words)
    sent.clear()
    assert code(texts)[0].tolist() == ids.tolist() and not sum(sent)


def test_packing(spark, docs, rows):
    ids = dict(zip((i for i, _ in rows), library_ids([t for _, t in rows]), strict=True))
    lost = packed(packing.op12_packing(spark, DATA).collect(), ids, 1024)
    assert lost < 0.01 * sum(map(len, ids.values()))
    few = docs.where("doc_id < 40")
    lost = packed(packing.pack_documents(few.repartition(3), PATH, 100).collect(), {i: t for i, t in ids.items() if i < 40}, 100)
    # a cut inside a sentence costs INSIDE ids of padding, so of sequences of 100 about as much is padded at most
    assert lost < packing.INSIDE / 100 * sum(len(t) for i, t in ids.items() if i < 40)


def test_packing_keeps_documents_whole_where_it_can(spark):
    """Twelve documents of 129 ids: seven fit into 1,000 ids, and no cut inside one is worth 97 ids of padding in one sequence, but one of 8 is."""
    code = packing.Encoder(PATH)
    packer = packing.Packer(code, 258)
    pieces = [x for k in range(12) for p in packer.add(k, np.full(129, 500, np.uint32)) for x in p] + packer.pack(last=True)
    assert len(pieces) == 12 and {p[2] for p in pieces} == {129}


def test_cheapest_cuts():
    def brute(places, pay, limit):
        cost = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                if (w := places[j] - places[i]) <= limit:
                    cost[j] = min(cost[j], cost[i] + padding(w, limit) + pay[j] + 1)
        return cost[-1]

    rng = random.Random(1)
    for _ in range(200):
        limit, n = rng.choice([1, 8, 16, 20, 64]), rng.randrange(1, 200)
        base = np.array(sorted(rng.sample(range(1, n + 1), min(n, rng.randrange(40)))), np.int64)
        places = packing.candidates(n, base, limit, rng.random() < 0.5)
        assert places[0] == 0 and places[-1] == n and np.diff(places).max() <= limit
        pay = np.array([rng.choice([0, 2, 8]) for _ in places])
        cuts, at = packing.best_cuts(places, pay, limit), dict(zip(places.tolist(), pay.tolist(), strict=True))
        assert sum(padding(b - a, limit) + at[b] + 1 for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) == brute(places.tolist(), pay.tolist(), limit)


def test_packing_in_small_batches(monkeypatch, rows):
    """Batches of 3,000 ids, long documents cut over several of them."""
    monkeypatch.setattr(packing, "BATCH", 3000)
    code = packing.Encoder(PATH)
    ids = dict(zip((i for i, _ in rows), library_ids([t for _, t in rows]), strict=True))
    packer = packing.Packer(code, 1024)
    pieces = [x for i, t in ids.items() for p in packer.add(i, np.array(t, np.uint32)) for x in p] + packer.pack(last=True)
    named = [type("Row", (), dict(zip(packing.COLUMNS, p, strict=True))) for p in pieces]
    assert packed(named, ids, 1024) < 0.02 * sum(map(len, ids.values()))


def test_packing_of_odd_tables(spark, odd):
    texts = [(k, t) for k, (_, t) in enumerate(ODD)]
    result = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), PATH).collect()
    packed(result, dict(zip(range(len(ODD)), library_ids([t for _, t in texts]), strict=True)), 1024)
    counts = Counter(r.doc_id for r in packing.pack_documents(odd, PATH).where("start = 0").collect())
    assert counts == Counter(i for i, _ in ODD)
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, PATH, 0)


# spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:p] + a[p + 1 :] == b for p in range(len(a)))


def brute_variants(rows, every=97, least=5, often=3):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w
            counts[w] += len(w) >= least
    n = {w: k for w, k in counts.items() if k >= often}
    meet = defaultdict(set)
    for w in n:
        for k in {w} | {w[:p] + w[p + 1 :] for p in range(len(w))}:
            meet[k].add(w)
    others = defaultdict(set)
    for ws in meet.values():
        for a in ws:
            others[a] |= {b for b in ws if near(a, b)}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in others.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), k, len(others[w]), n.get(form.get(w))) for w, k in n.items())


def lines(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling(docs, rows):
    wanted = brute_variants(rows)
    assert lines(spelling.spelling_variants(docs)) == wanted
    assert any(f and r != f for _, f, r, *_ in wanted) and sum(w[4] for w in wanted) > 1000


@pytest.mark.parametrize("group", [20_000, 50, 3])
def test_dense_words_and_split_groups(spark, group):
    """Words over three letters: nearly all are near many others, edits stand at several places; groups of more than `group` are split."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    words += ["a" * 300, "a" * 301, "a" * 299 + "b", "a" * 200 + "b" + "a" * 100]
    rows = [(k, " ".join(rng.choices(words, k=200))) for k in range(40)] + [(None, None), (5, ""), (5, "A" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.spelling_variants(df, every=7, least_length=2, least_often=1, group=group)
    assert lines(got) == brute_variants(rows, 7, 2, 1)
    if group == 3:
        split = spelling.cells(got.select("word", "n"), 2, group).groupBy("group").agg(F.count("*").alias("many"), F.max(F.col("high") - F.col("low")).alias("places"))
        assert split.where("many > 3 and places > 1").count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100):
        values = rng.permutation(n)
        tree = spelling.Wavelet(values)
        low, least = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        high, most = np.minimum(n, low + rng.integers(0, n + 1, 50)), np.minimum(n, least + rng.integers(0, n + 1, 50))
        query, value = tree.report(low, high, least, most)
        wanted = [(q, v) for q in range(50) for v in values[low[q] : high[q]].tolist() if least[q] <= v < most[q]]
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == sorted(wanted)


def test_spelling_of_odd_tables(odd):
    assert lines(spelling.spelling_variants(odd)) == brute_variants(ODD)
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd, times=1)
