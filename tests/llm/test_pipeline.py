"""The stages of the corpus pipeline, one by one and together, against brute force on a small table."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from test_dedup import brute_components
from test_text import brute_counts

from statforge.llm import mixing, quality

P = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=6, n=260):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)] + ["é" * 3, "naïve", "œuvre"]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passages, texts = [" ".join(words(40)) for _ in range(4)], []
    for _ in range(n):
        x = r.random()
        if texts and x < 0.25:  # near copies
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 2, 9])):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
        elif x < 0.4:
            texts.append(" ".join([*words(30), r.choice(passages), *words(25)]))
        elif x < 0.5:
            texts.append(r.choice(["", "short text", " ".join(f"{w}$$$" for w in words(60)), " ".join(words(9) * 8), " ".join(words(50)).upper()]))
        else:
            texts.append(" ".join(words(r.randint(30, 150))))
    rows = [(3 * i + 1, t, r.choice(["en", "de", "fr"]), f"src{r.randrange(6)}", len(t)) for i, t in enumerate(texts)]
    rows += [(5, None, "en", "src1", None), (2, " ".join(words(60)), None, None, 9)]
    r.shuffle(rows)
    return rows


def kept_by_quality(rows, least_rows=200, width=4.0):
    """Base rules, and fences from quartiles of each language and source, or of the language where rows are few."""
    ratios, base = {}, {}
    for d, t, lang, source, _ in rows:
        n_words, chars, symbols, dup, repeats = brute_counts(t)
        lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\r\v\f"))
        upper = sum("A" <= c <= "Z" for c in t or "")
        base[d] = n_words < 20 or 100 * repeats > 30 * n_words
        one = lambda b: max(b, 1)
        ratios[d] = {"symbols": symbols / one(n_words), "length": chars / one(n_words), "repeats": repeats / one(n_words), "lines": dup / one(lines), "upper": upper / one(chars)}
    own, wide = defaultdict(list), defaultdict(list)
    for d, _, lang, source, _ in rows:
        if not base[d]:
            own[lang, source].append(ratios[d])
            wide[lang].append(ratios[d])
    quarter = lambda values, q: sorted(values)[max(1, math.ceil(q * len(values))) - 1]
    out = set()
    for d, _, lang, source, _ in rows:
        if base[d]:
            continue
        group = own[lang, source] if len(own[lang, source]) >= least_rows else wide[lang]
        ok = True
        for name, (_, low, least) in quality.RATIOS.items():
            q1, q3 = (quarter([g[name] for g in group], q) for q in (0.25, 0.75))
            spread = width * (q3 - q1) + least
            ok &= ratios[d][name] <= q3 + spread and (not low or ratios[d][name] >= q1 - spread)
        if ok:
            out.add(d)
    return out


def without_repeats(docs, width=50):
    """Texts without bytes that a smaller id has; a character of which a byte goes, goes whole."""
    least, out = {}, {}
    for d, t in docs:
        b = t.encode()
        for i in range(len(b) - width + 1):
            least[b[i : i + width]] = min(least.get(b[i : i + width], d), d)
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out[d] = "".join(kept)
    return out


def mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.sql(budget_percent=90, max_epochs=1)}) WHERE n_epochs > 0").fetchall()}


def test_stages_and_run(spark, tmp_path):
    import tiktoken

    import corpus_pipeline as c

    rows = corpus()
    home = {r[0]: r for r in rows}
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] or "" for r in rows}

    want = []
    kept = kept_by_quality(rows)
    want.append({d: texts[d] for d in kept})
    component = brute_components(list(want[-1].items()), 5, 80)
    want.append({d: t for d, t in want[-1].items() if component[d][1] == d})
    want.append({d: t for d, t in without_repeats(list(want[-1].items())).items() if t.strip(" ")})
    taken = mixed([(d, t, home[d][2], home[d][3]) for d, t in want[-1].items()])
    want.append({d: t for d, t in want[-1].items() if d in taken})
    sizes = [len(rows), *map(len, want)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) >= 4  # the stages have something to do

    for i, (name, stage) in enumerate(c.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == c.COLUMNS
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert {r.doc_id: r.text for r in docs.collect()} == want[i], name

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        from statforge.llm import bpe

        ranks = bpe.Encoder(f.read().splitlines(), P.PATTERN).ranks
    ref = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = {}
    for d, t in want[-1].items():
        ids = ref.encode_ordinary(t)
        tokens[d] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in c.run(spark, str(tmp_path)).collect()}
    assert got == tokens


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).collect() == []
