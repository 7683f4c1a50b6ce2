"""Window deduplication and the Jaccard join against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from statforge.llm import jaccard, repeats, suffix_dedup
from statforge.llm import substring_dedup as substring_dedup_module
from statforge.llm.jaccard import ngram_jaccard_join
from statforge.llm.substring_dedup import substring_dedup
from statforge.llm.suffix_dedup import suffix_array_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, docs, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


def mixed_docs(seed, n=120):
    r = random.Random(seed)
    vocab = ["the", "of", "é", "x", "and", "er$$$", "a", "ü%"] + [f"w{i}" for i in range(60)]
    pool = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 80))) for _ in range(8)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            x = r.random()
            p = r.choice(pool) if x < 0.4 else "Shti " * r.randint(1, 60) if x < 0.5 else " ".join(r.choice(vocab) for _ in range(r.randint(1, 60)))
            if r.random() < 0.3:
                w = p.split()
                w[r.randrange(len(w))] = f"EDIT{d}"
                p = " ".join(w)
            parts.append(p)
        text = r.choice([" ", "\n", "  "]) + "\n".join(parts) if parts else r.choice(["", None, " \n"])
        docs.append((d * 3 + 1, r.choice(docs)[1] if docs and r.random() < 0.1 else text))
    r.shuffle(docs)
    return docs


def brute_bytes(docs, width=50):
    least, out = {}, {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            least[b[i : i + width]] = min(least.get(b[i : i + width], d), d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()
    return out


def brute_words(docs, width=35):
    seen, words, out = collections.Counter(), [(d, WORDS.findall(t or "")) for d, t in docs], {}
    for _, w in words:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    for d, w in words:
        gone = [0] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [1] * width
        out[d] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_arrays(spark, seed):
    docs = mixed_docs(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_array_dedup(frame(spark, docs)).collect()}
    assert got == brute_bytes(docs)


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_trees(spark, seed):
    docs = mixed_docs(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(frame(spark, docs)).collect()}
    assert got == brute_words(docs)


def test_dedup_edges(spark):
    assert suffix_array_dedup(frame(spark, [], 1)).collect() == [] and substring_dedup(frame(spark, [], 1)).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(1, text), (1, text), (None, "x " * 100), (None, None), (5, "é" * 100_000), (6, "é" * 30)]
    df = spark.createDataFrame([(*d, "doc", 1) for d in docs], "doc_id long, text string, doc string, part int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_array_dedup(df).collect())
    assert got == sorted([("1", len(text), 0)] * 2 + [("None", 200, 0), ("None", 0, 0), ("5", 200_000, 0), ("6", 60, 60)])
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup(df).collect())
    assert got == sorted([("1", 40, 40)] * 2 + [("None", 100, 100), ("None", 0, 0), ("5", 1, 0), ("6", 1, 0)])
    whole = suffix_array_dedup(frame(spark, [(1, "é" + "a" * 49), (2, "ĩ" + "a" * 49), (3, "xé" + "a" * 49)]), whole_characters=True, min_bytes=50)
    assert {r.doc_id: bytes(r.kept).decode() for r in whole.collect()} == {1: "é" + "a" * 49, 2: "", 3: "x"}
    with pytest.raises(ValueError):
        suffix_array_dedup(df, carry=("doc_id",))


def test_groups_are_bounded():
    docs = mixed_docs(2)
    rule = repeats.Rule(50, 20, False, 3, 2)
    blobs = rows_of(docs, rule, repeats.Bytes())
    sizes = [sum(map(len, parts)) for bucket in blobs.values() for parts, small in repeats.prefix_groups(bucket, rule, repeats.Bytes(), 20) if small]
    assert sizes and max(sizes) <= 20


def locally(docs, words, two_rounds):
    """n_removed of every document, by the functions of the Spark plan without Spark, so that limits can be patched."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    rule = repeats.Rule(35, 8, True, 1, 7) if words else repeats.Rule(50, 20, False, 1, 7)
    symbols, solve = (repeats.Words(), substring_dedup_module.subtree) if words else (repeats.Bytes(), suffix_dedup.family)
    batches = [pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in part], pa.int64()), "salt": pa.array([0] * len(part), pa.int64()), "text": pa.array([x for _, x in part], pa.string())}) for part in (docs[i::3] for i in range(3))]
    kind = lambda rows, k: [b.filter(pa.array(np.asarray(b.column(0)) == k)) for b in rows]
    keys = repeats.row_keys(np.array([d for d, _ in docs]), np.zeros(len(docs), np.int64))
    spans, windows = [], []
    if two_rounds:
        units = [b for batch in batches for b in repeats.unit_scanner(symbols, rule)(iter([batch]))]
        hints = list(repeats.unit_reducer(rule)(iter(units)))
        spans += kind(hints, repeats.SPAN)
        table = pa.table({"doc": pa.array([d for d, _ in docs], pa.int64()), "key": pa.array(keys.view(np.int64)), "z": pa.array([zstandard.ZstdCompressor().compress((x or "").encode()) for _, x in docs], pa.binary())})
        rows = repeats.asker(symbols, rule)(None, table, pa.Table.from_batches(kind(hints, repeats.ASK), schema=repeats._ARROW)).to_batches()
    else:
        rows = [b for batch in batches for b in repeats.scanner(symbols, rule)(iter([batch]))]
    out = list(repeats.reducer(rule, symbols, solve, False)(iter(rows)))
    windows = kind(out, repeats.WINDOW)
    spans += kind(out, repeats.SPAN) + list(repeats.window_reducer(rule)(iter(windows)))
    finish = substring_dedup_module._finish if words else suffix_dedup._finish
    done = finish(pa.array([d for d, _ in docs], pa.int64()), keys, [(x or "").encode() for _, x in docs], repeats.read_spans(pa.Table.from_batches(spans, schema=repeats._ARROW)))
    return dict(zip(done.column("doc_id").to_pylist(), done.column("n_removed").to_pylist(), strict=True)), sum(b.num_rows for b in windows)


@pytest.mark.parametrize("limits", [{}, {"SEGMENT": 70, "FLUSH": 9000}, {"GROUP": 40_000}, {"GROUP": 2000}, {"UNITS": 50, "BUCKET": 200}])
@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("two_rounds", [True, False])
def test_limits_change_nothing(monkeypatch, limits, words, two_rounds):
    """Long texts in segments, rows in portions, buckets split by longer prefixes or window by window, units in passes."""
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(suffix_dedup, "BATCH", 300)
    docs = mixed_docs(5, 80)
    got, windows = locally(docs, words, two_rounds)
    assert got == {d: x[1] for d, x in (brute_words if words else brute_bytes)(docs).items()}
    assert (windows > 0) == (limits.get("GROUP") == 2000)


@pytest.mark.parametrize("elsewhere", [True, False])
def test_units_of_one_fingerprint_may_differ(elsewhere):
    """Equal g alone settles nothing: the k-gram and both lengths must agree as well."""
    rule = repeats.Rule(35, 8, True, 3, 2) if elsewhere else repeats.Rule(50, 20, False, 3, 2)
    column = lambda values, kind: np.array(values, kind)
    n = 4
    units = [column([1, 2, 1, 1], np.uint64), column([5] * n, np.uint64), column([1, 2, 3, 4], np.int64), column([0] * n, np.uint64), column([0] * n, np.int64), column([3, 3, 4, 3], np.uint8), column([2] * n, np.uint8)]
    open_, (_, at, _) = repeats.settled_units(units, rule)
    assert len(open_[0]) + len(at) >= n and 3 in open_[2] and 2 in open_[2]
    same = [c[[0, 0, 0]] if i != 2 else column([1, 2, 3], np.int64) for i, c in enumerate(units)]
    open_, (_, at, _) = repeats.settled_units(same, rule)
    assert open_[2].tolist() == [1, 2] and len(at) == 1  # two are compared, the third shares what they have
    of_one = [c[[0, 0, 0, 0]] if i != 2 else column([2, 1, 1, 2], np.int64) for i, c in enumerate(units)]
    open_, (_, at, _) = repeats.settled_units(of_one, rule)
    assert open_[2].tolist() == ([1, 1] if elsewhere else [1, 1, 2]) and len(at) == (2 if elsewhere else 1)


def removed(df, column):
    return {r.doc_id: r[column] for r in df.collect()}


def rows_of(docs, rule, symbols):
    """The blobs of suffix rows by bucket, of documents in three batches."""
    import pyarrow as pa

    out = {}
    for part in (docs[i::3] for i in range(3)):
        salt = [int.from_bytes(hashlib.md5((t or "").encode()).digest()[:7], "little") for _, t in part]
        batch = pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in part], pa.int64()), "salt": pa.array(salt, pa.int64()), "text": pa.array([t for _, t in part], pa.string())})
        for b in repeats.scanner(symbols, rule)(iter([batch])):
            for kind, key, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == repeats.ENTRY:
                    out.setdefault(key, []).append(blob)
    return out


def test_levels_find_repeats_when_a_batch_arrives():
    docs = [(i, "".join(random.Random(i % 7).choice("abcdefgh ") for _ in range(300)) + str(i)) for i in range(40)]
    rule = repeats.Rule(50, 20, False, 3, 1)
    batches = [repeats.thaw(b, rule, repeats.Bytes()) for b in rows_of(docs, rule, repeats.Bytes())[0]]
    levels = suffix_dedup.Levels(rule)
    for i, batch in enumerate(batches):
        levels.add(batch)
        known = sum(len(s[0]) for s in levels.spans) + sum(int(x.seen.any(1).sum()) for x, _ in levels.levels)
        assert (known > 0) == (i > 0 or known > 0)
        sizes = [len(x) for x, _ in levels.levels]
        assert all(a > 2 * b for a, b in itertools.pairwise(sizes))
    for x, _ in levels.levels:
        strings = repeats.suffix_strings(x.table[:, : rule.width])
        assert (strings[1:] >= strings[:-1]).all()


def test_index_of_suffix_arrays(spark, tmp_path):
    """Documents that come in several calls are judged as if they had come in one."""
    docs = sorted(mixed_docs(4, 160), key=lambda d: d[0])
    want, got, levels = {d: x[1] for d, x in brute_bytes(docs).items()}, {}, []
    for lo, hi in ((0, 90), (90, 110), (110, 125), (125, 160)):
        got |= removed(suffix_array_dedup(frame(spark, docs[lo:hi], 3), index=str(tmp_path / "index")), "n_removed")
        levels.append([n for n, _, _ in suffix_dedup.stored_levels(spark, str(tmp_path / "index"))])
    assert got == want and levels[0] == [90] and all(a > 2 * b for some in levels for a, b in itertools.pairwise(some))


def test_rows_that_share_an_id(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = [(None, one), (None, two), (3, one), (3, two + " end"), (9, two)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_array_dedup(frame(spark, docs)).collect())
    assert got == sorted([("None", len(one), 0), ("None", len(two), 0), ("3", len(one), len(one)), ("3", len(two) + 4, len(two)), ("9", len(two), len(two))])
    lone = [(1, one), (1, "x " * 30 + "y"), (2, one)]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(frame(spark, lone)).collect()) == [(1, 0), (1, 60), (2, 60)]


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [512, 1024, 8192])
def test_structured_words_differ(spark, n):
    """Words that polynomial fingerprints modulo a power of two take for equal."""
    one, two = thue_morse(n)
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(frame(spark, [(1, one), (2, two)], 1), words=3, percent=90).collect()}
    assert got == {1: 1, 2: 2}
    rest = " ".join(f"w{i}" for i in range(34))
    assert removed(substring_dedup(frame(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}")], 1)), "n_removed") == {1: 0, 2: 0}


def sets(text, k):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs, k, percent):
    s = {d: sets(t, k) for d, t in docs}
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(s, 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in s}


def family_docs(seed, n=600):
    r = random.Random(seed)
    fam = [[f"w{r.randrange(3000)}" for _ in range(r.choice([4, 9, 12, 30, 60, 200]))] for _ in range(40)]
    docs = []
    for d in range(n):
        x, w = r.random(), []
        if x < 0.7:
            w = list(r.choice(fam[:12]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                i = r.randrange(len(w))
                w[i] = r.choice([f"E{r.randrange(50)}", w[i].upper(), w[i]])
        elif x < 0.95:
            w = r.choice(fam)
        docs.append((d * 2 + 1, " ".join(w) if w or r.random() < 0.5 else None))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("words,percent,block", [(3, 90, 1024), (5, 80, 1024), (3, 90, 20)])
def test_jaccard_join(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = family_docs(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), words=words, percent=percent).collect()}
    assert got == brute_components(docs, words, percent)


def test_jaccard_edges(spark):
    assert ngram_jaccard_join(frame(spark, [], 1)).collect() == []
    docs = [(9, "A b c d"), (9, "a B c d"), (4, "a b  c\nd"), (None, "a b c d"), (None, None), (2, ""), (3, None), (8, "a b"), (7, "a b"), (1, "a b x")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_jaccard_join(df, words=3, percent=90).collect())
    assert got == sorted([("9", 2, "4"), ("9", 2, "4"), ("4", 2, "4"), ("None", 2, "None"), ("None", 0, "None"), ("2", 0, "2"), ("3", 0, "3"), ("8", 1, "7"), ("7", 1, "7"), ("1", 1, "1")])


def test_levels_hold_every_link():
    for percent in (80, 90):
        for n in range(1, 3000):
            c = jaccard.level_of(n, percent)
            assert jaccard.first_size(c, percent) <= n < jaccard.first_size(c + 1, percent)
            top = n * 100 // percent
            assert jaccard.level_of(top, percent) <= c + 1
            parts, spare = jaccard.parts_of(c, percent)
            assert parts - spare > (n + top) * (100 - percent) // (100 + percent)


@pytest.mark.parametrize("parts,local,most", [(1, 10, 99), (4, 64, 10)])
def test_jaccard_full_signatures(spark, monkeypatch, parts, local, most):
    """Pairs that share one passage with all others: some pairs agree only in signatures that too many have."""
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(jaccard, "MOST", most)
    passage, docs = [f"p7y{i}" for i in range(16)], []
    for i in range(30):
        docs += [(d, " ".join([*passage, f"q7x{i}x0", *(f"{own}7x{i}x{j}" for j in range(2))])) for d, own in ((i, "a"), (59 - i, "b"))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs, parts), words=1, percent=80).collect()}
    assert got == brute_components(docs, 1, 80)
    assert len({c for _, c in got.values()}) == 30


def test_prefixes_hold_every_link():
    """Sets that link share one of the shingles that prefixes() takes, whatever the weights."""
    r, rng = random.Random(4), np.random.default_rng(4)
    for percent in (80, 90):
        some = []
        for _ in range(60):
            base = r.sample(range(400), r.randint(1, 60))
            some += [set(base), set(base[: len(base) - r.randint(0, 3)]) | set(r.sample(range(400), r.randint(0, 3)))]
        some.append(set())
        code = np.concatenate([np.array(sorted(x), np.uint64) for x in some])
        offs = np.cumsum([0, *map(len, some)])
        owner, token = jaccard.prefixes(code, offs, rng.integers(0, 5, jaccard.PLACES), percent)
        taken = [set(token[owner == i].tolist()) for i in range(len(some))]
        links = [(i, j) for i, j in itertools.combinations(range(len(some)), 2) if some[i] and 100 * len(some[i] & some[j]) >= percent * len(some[i] | some[j])]
        assert len(links) > 20
        assert all(taken[i] & taken[j] for i, j in links)


def passage_family(seed, clusters, alone):
    """Documents that hold one passage: clusters of near copies, a few links across sizes, and many that link with none."""
    r = random.Random(seed)
    passage, docs = [f"p{i}" for i in range(12)], []
    for c in range(clusters):
        own = [f"c{c}x{i}" for i in range(30)]
        for _ in range(40):
            words = [*passage, *own]
            for _ in range(r.randint(0, 2)):
                words[r.randrange(12, len(words))] = f"e{len(docs)}"
            docs.append(words)
    docs += [[*passage, *(f"a{i}x{j}" for j in range(r.randint(1, 40)))] for i in range(alone)]
    r.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("hubs", [16, 10**6])
def test_jaccard_across_blocks(spark, monkeypatch, hubs):
    """A family of many blocks, most of whose documents aren't connected with its first one, with and without hubs."""
    for name, value in (("BLOCK", 25), ("LOCAL", 8), ("MOST", 16), ("GROUP", hubs)):
        monkeypatch.setattr(jaccard, name, value)
    docs = passage_family(8, 6, 200)
    for words in (1, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), words=words, percent=80).collect()}
        assert got == brute_components(docs, words, 80)


def test_loose_documents_open_few_blocks(spark, monkeypatch):
    """Documents of a large family that link with none are shipped to few blocks, not to each."""
    monkeypatch.setattr(jaccard, "BLOCK", 25)
    monkeypatch.setattr(jaccard, "LOCAL", 8)
    monkeypatch.setattr(jaccard, "MOST", 16)
    written, keep = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: written.update({name: keep(df, name)}) or written[name])
    docs = passage_family(9, 2, 1200)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), words=1, percent=80).collect()}
    assert got == brute_components(docs, 1, 80)
    blocks = written["cells"].select("family", "block").distinct().count()
    loose = written["loose"].filter("loose").count()
    assert blocks > 20 and loose > 500
    n = written["guests"].count()
    assert n < loose * blocks / 20


def test_jaccard_ids_with_several_texts(spark):
    """Rows that share an id link by each of their texts."""
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(5, one), (5, two), (7, one + " more"), (9, two + " more"), (3, "c d e f")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), words=3, percent=90).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]
