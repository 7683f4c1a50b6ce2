"""Filter audit, token counts and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statforge.llm import filter_audit, queries, resampling, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n_words string, mask string, part string"
LABELS = "doc_id long, quality int, toxic int, part string"


def audit_rows(r):
    texts = [None, "", " \n", "A B C", "x # y", "word " * 250, " ".join(f"w{i}" for i in range(230)), " ".join(f"W{i}" for i in range(300)), "a\x0bb\x0cc é É " * 90, "  \x1c"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "9", "m", "p") for i in range(300)]
    rows += [(1000 + i, texts[5], "en", None, None, None) for i in range(200)]  # one group of copies holds a third
    rows += rows[:20] + [(None, texts[6], "en", None, None, None), (None, "only here", "de", None, None, None), (None, "only here", None, None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "q") for i in range(0, 600, 2)] + [(2, 1, 1, "q"), (None, 1, 1, "q")]
    return rows, labels


def brute_audit(rows, labels):
    fails = {
        "A": lambda t, w: len(w) < 200,
        "B": lambda t, w: 100 * len(set(w)) < 50 * len(w),
        "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
        "D": lambda t, w: bool(re.search(r"[#$%&*|]", t)),
    }
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x, _ in labels if i is not None and x == 1}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        bad = {f for f, test in fails.items() if test(t, w)}
        if t in first and (i is None or first[t] < i):
            bad.add("E")
        docs.append((lang or "", bad, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                key = (part, "".join(order), step + 1)
                redundant = sum(f in d[1] for d in mine) - len(gone)
                out[key] = (len(left), len(gone), redundant, sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows, labels = audit_rows(random.Random(4))
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * 3
    for x in got:
        assert tuple(x[3:]) == want[x.part, x.filter_order, x.step], x


def test_filter_audit_of_nothing(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(none, labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "", "", "")], DOCS), labels).collect()
    assert len(one) == 600 and {x.removed for x in one if x.filter_order[x.step - 1] == "A"} == {1}


def test_filter_audit_of_other_filters(spark):
    """Without duplicates, and with filters of one's own."""
    mine = lambda text: {"X": F.length(text) < 2, "Y": text.contains("y")}
    docs = spark.createDataFrame([(1, "y", "a"), (2, "yyy", "a"), (3, "xx", "a")], "doc_id long, text string, lang string")
    got = filter_audit.filter_audit(docs, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), filters=mine, duplicates=None).collect()
    steps = {(x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.shapley) for x in got}
    assert steps == {("XY", 1): (2, 1, 0, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 1, 3), ("YX", 2): (1, 0, 1, 0, 0, 1)}


@pytest.mark.parametrize("n", range(1, 7))
def test_orders_by_adjacent_swaps(n):
    orders = list(filter_audit.adjacent_orders(n))
    assert sorted(o for o, _ in orders) == sorted(itertools.permutations(range(n)))
    for (a, _), (b, i) in itertools.pairwise(orders):
        assert [k for k in range(n) if a[k] != b[k]] == [i, i + 1] and (a[i], a[i + 1]) == (b[i + 1], b[i])


def test_walk_updates_two_steps_a_swap():
    walk = filter_audit.Walk(np.random.default_rng(1).integers(0, 9, (3, 32, 3)), 5)
    orders = walk.run()
    assert walk.updated == 5 + 2 * 119
    fresh = filter_audit.Walk(walk.cells, 5)
    for order, steps in orders:
        for i in range(5):
            fresh.step(order, i)
        assert (fresh.steps == steps).all()


def odd_texts(r):
    alphabet = ["a", "b", "Z", "é", "é", "́", "ß", "İ", "Σ", "1", "²", "Ⅷ", "'", "'s", "'LL", ".", ",", "!", "。", "你好", "한", "ᄒ", "ᅡ", "|", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\x0b", " ", " ", "_", "-", "😀", "\x00", "‍"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.public_words())
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts(spark):
    r = random.Random(8)
    texts = [None, "", " "] + odd_texts(r) + ["It's 12,345.67 o'clock. " * 400, "z" * 3000, "<|endoftext|>" * 5]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, "again", "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").repartition(4)
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.count_tokens(docs, token_counts.public_words()).collect())
    counts = library_counts([t for _, t, *_ in rows])
    assert got == sorted((i or 0, len((t or "").encode()), n, n > 2048) for (i, t, *_), n in zip(rows, counts, strict=True))
    assert any(x[3] for x in got)
    assert token_counts.count_tokens(docs.limit(0), token_counts.public_words()).count() == 0


def test_token_counts_of_long_texts(monkeypatch):
    """Small batches, portions and memos give the same: every text is cut at many places."""
    for name, value in (("BATCH_BYTES", 40), ("LONG", 8), ("MEMO", 30)):
        monkeypatch.setattr(token_counts, name, value)
    with open(token_counts.public_words(), "rb") as f:
        counter = token_counts.WordCounter(f.read())
    r = random.Random(2)
    texts = odd_texts(r) + ["".join(r.choice("ab1.,:é。 '") for _ in range(5000)), "abc" * 900, "1" * 500 + "a.b" * 300]
    encoded = []
    encode = counter._encode
    counter._encode = lambda parts: encoded.append(sum(map(len, parts))) or encode(parts)
    assert counter.counts(texts) == library_counts(texts)
    assert len(encoded) > 100


def test_tokenizers_that_cannot_be_cut_are_refused(spark, tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "whole.json")
    Tokenizer(models.BPE({"a": 0, " ": 1, "a ": 2}, [("a", " ")], unk_token=None)).save(path)
    docs = spark.createDataFrame([(1, "a a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="reach across"):
        token_counts.count_tokens(docs, path)
    with pytest.raises(ValueError, match="neither"):
        token_counts.count_tokens(docs, "x.txt")


def test_token_counts_of_sentence_pieces(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = [None, "", *odd_texts(r)[:200], "".join(r.choice(["ab", "the", " ", " ", "é", "  ", ".", "1"]) for _ in range(9000))]
    want = [len(model.encode(t or "")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_tokens for x in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 50)
    with open(path, "rb") as f:
        counter = token_counts.PieceCounter(f.read())
    assert counter.counts([t or "" for t in texts]) == want


FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text, longest, buckets):
    w = FEATURE.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def brute_resample(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    found = [(i, *brute_features(t, longest, buckets)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, f, _ in found:
        for b in f:
            s[b] += 1
    for x in target:
        for b in brute_features(x, longest, buckets)[0]:
            t[b] += 1
    n_s, n_t = sum(s), sum(t)
    rows = []
    for i, f, n in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = percent * len(able) // 100
    drawn = [(*r[:4], n + 1) for n, r in enumerate(able[:k])]
    rest = [(*r[:4], None) for r in able[k:]] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(drawn + rest, key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest, monkeypatch):
    r = random.Random(6)
    text = lambda: "".join(r.choice(["the ", "Thé-", "x9 ", "Ünder_", "a", " ", "\x00", "good ", "zz ", "\n"]) for _ in range(r.randint(0, 120)))
    docs = [(i - 40, text()) for i in range(400)] + [(5000, None), (5001, ""), (5002, "w" * 300 + " ok" * 30)] + [(None, text()) for _ in range(9)]
    docs += [(7777, "the same text " * 9)] * 150  # a third of the rows are one row again and again
    target = [None, "", "The x9 good", "good good thé " * 5]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, n_words int").repartition(5)
    bench = spark.createDataFrame([(t, 3) for t in target], "text string, doc_id int")
    out = resampling.resample(frame, bench, longest=longest, percent=40)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute_resample(docs, target, longest, percent=40)
    assert sorted((tuple(x) for x in out.collect()), key=repr) == want
    # Texts longer than a portion are taken piece by piece.
    monkeypatch.setattr(resampling, "PORTION", 64)
    for _, t in docs:
        buckets, counts, words, n = resampling._long_features((t or "").encode(), longest, 10_000)
        f, w = brute_features(t, longest, 10_000)
        assert (words, n) == (w, len(f)) and dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {b: f.count(b) for b in set(f)}


def test_resampling_of_few_rows(spark):
    bench = spark.createDataFrame([("a b",)], "text string")
    none = resampling.resample(spark.createDataFrame([], "doc_id long, text string"), bench)
    assert none.count() == 0
    few = resampling.resample(spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string"), bench)
    assert sorted((x.doc_id, x["rank"]) for x in few.collect()) == [(1, None), (2, None)]
    every = resampling.resample(spark.createDataFrame([(1, "a " * 30), (2, "b"), (3, "c " * 20)], "doc_id long, text string"), bench, percent=100)
    assert sorted((x.doc_id, x["rank"] or 0) for x in every.collect())[1] == (2, 0) and {x["rank"] for x in every.collect()} == {None, 1, 2}
    without = resampling.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), bench.limit(0), percent=100)
    assert [tuple(x) for x in without.collect()] == brute_resample([(1, "a " * 30)], [], percent=100)


def test_checksums():
    r = np.random.default_rng(3)
    buf = r.integers(0, 256, 4000).astype(np.uint8)
    starts = r.integers(0, 4000, 500)
    ends = np.minimum(4000, starts + r.integers(0, 200, 500))
    assert resampling.crc32(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("spread", [2, 2**63])
def test_radix_select(spark, spread):
    r = random.Random(spread)
    rows = [(r.randrange(-spread, spread), r.choice([0, 1, 2**40, -1]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    unsigned = lambda x: tuple(v % 2**64 for v in x)
    order = sorted(rows, key=unsigned)
    for k in (1, 250, 500):
        found, jobs = resampling.radix_select(frame, ["a", "b", "c"], k)
        got = frame.filter(resampling.up_to(["a", "b", "c"], found)).collect()
        assert sorted(map(tuple, got), key=unsigned) == order[:k] and jobs <= 3 * 7


def test_registered_sql_is_that_of_the_contract():
    assert {"op11_filter_audit", "op13_importance_resampling"} <= set(queries.oracle_sql()) <= set(queries.queries())
