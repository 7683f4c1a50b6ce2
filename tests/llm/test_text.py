"""Quality counts, BPE, HTML, archives, mixing, licences and top-k against brute force."""

import hashlib
import io
import math
import os
import random
import re
import zipfile
from collections import Counter

import pytest

from statforge.llm import bpe, htmlcut, licenses, mixing, quality, topk, warczip
from statforge.llm.license_texts import LICENSES, NOTICES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    r = random.Random(3)
    texts = [None, "", " \n\n", "a\na\n a\na", "\n\na b\n\na b\n", "é ü x\x0by #$"]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "é ", "#|", " ", "\n", "long "]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += [" ".join(["x y z a b c d e f"] * 3), " ".join("abcdefg") * 2]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    for i, t, *_ in rows:
        x, b = got[i], brute_counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == b, t
        assert x.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (x.base_failed and x.kept)


def test_quality_of_long_and_repeated_rows(spark):
    """One text of a megabyte; rows that are there twice are judged alike; a small group has its language's fences."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(80), "en", "s") for i in range(220)] + [(1, "x y", "en", "s")] * 2 + [(500, text(180_000), "en", "rare"), (501, " ".join(w.upper() for w in text(90).split()), "en", "rare"), (None, text(70), None, None)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and all(x.n_words == 180_000 and x.kept for x in got if x.doc_id == 500)
    assert [x.kept for x in got if x.doc_id == 501] == [False] and sorted((x.n_words, x.kept) for x in got if x.doc_id == 1) == [(2, False), (2, False), (80, True)]
    assert [x.kept for x in got if x.doc_id is None] == [True]


def test_lines_that_look_alike(spark):
    """Lines of structured bytes, which polynomial fingerprints modulo a power of two take for equal."""
    one = "ab"
    while len(one) < 2048:
        one += one.translate({97: "b", 98: "a"})
    two = one.translate({97: "b", 98: "a"})
    rows = [(1, f"{one}\n{two}", "en", "s"), (2, f"{one}\n{one}", "en", "s"), (3, " ".join([one, *"cdefghi", two, *"cdefghi"]), "en", "s")]
    got = {x.doc_id: (x.n_dup_lines, x.n_repeat_words) for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0)}


def test_quality_verdicts(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(800)]
    clean = [" ".join(r.choice(words) for _ in range(r.randint(60, 300))) for _ in range(300)]
    junk = [" ".join(f"{r.choice(words)}$$$" for _ in range(100)) for _ in range(30)] + [" ".join(r.choice(words).upper() for _ in range(100)) for _ in range(30)]
    rows = [(i, t, ("en", None)[i % 2], "s") for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.kept for x in quality.quality_rules(df).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 360))
    wide = df.withColumnRenamed("doc_id", "n_words")
    assert sorted(x.n_words for x in quality.quality_filter(wide).collect()) == list(range(300))
    assert quality.quality_rules(df.limit(0)).collect() == [] and quality.quality_filter(df.limit(0)).collect() == []


P = pytest.importorskip("public_tokenizers")


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        enc = bpe.Encoder(f.read().splitlines(), P.PATTERN)
    ref = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    r, tokens = random.Random(1), list(enc.ranks)
    texts = ["", "a" * 5000, "it'\u017f so 'S 'ſ\u212a I'\u212a \u0130'T x'\u0131", " " * 3000 + "x", "<|endoftext|>", "   \r\n x", "don't WE'LL 12³ ½ Ⅷ"]
    for i in range(4000):
        if i % 2:
            texts.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x800, 0xD000), r.randrange(0x1F300, 0x1F600), r.randrange(32)])) for _ in range(r.randint(0, 30))))
        else:
            texts.append(b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "ignore"))
    for t in texts:
        ids = enc.encode(t).tolist()
        assert ids == ref.encode_ordinary(t), t
        assert enc.decode(ids) == t.encode()
    twice = [(8, "the same row", b"")] * 2
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts[:8])] + [(9, None, b""), (None, "w " * 200_000, b""), *twice], "doc_id long, text string, ids binary")
    rows = bpe.encode_texts(df, path, P.PATTERN).collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == 12 and len({bytes(x.ids) for x in rows if x.doc_id == 8}) == 1 and bytes(got[None].decoded) == b"w " * 200_000
    assert bytes(got[9].ids) == b"" and all(bytes(got[i].decoded) == t.encode() for i, t in enumerate(texts[:8]))
    assert bpe.encode_texts(df.limit(0), path, P.PATTERN).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>My Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy now, it is cheap and good for everyone who reads this very long line of words, really.</div>
<div id="cookie-notice">We use cookies on this site to make it better for you and for all our partners.</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 paragraph&nbsp;here<br>next.<p>Short.</p><ul><li>one</li><li>two</li></ul><aside>Related things</aside><form><p>Your mail</p></form></article>
<section class="comments"><p>A reader says that this was a very good article and that they liked it a lot, thank you so much.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_html():
    assert htmlcut.main_text(PAGE) == "Title & more\n\nFirst bold paragraph here next.\n\nShort.\n\none\n\ntwo"
    assert htmlcut.main_text(None) == htmlcut.main_text("") == htmlcut.main_text("<script>x") == ""
    long = "word " * 40
    assert htmlcut.main_text(f"<body><div class=menu><a href=x>Home</a></div><div><p>{long}</p><p>{long}</p></div><p class='x>y'>{long}</p><foo") == "\n\n".join([long.strip()] * 3)
    assert htmlcut.main_text(f"<article><p>{long}</p></arti").strip() == long.strip()


@pytest.mark.parametrize("depth", [0, 1, 3, 20])
def test_html_depth(depth):
    long, caption = "word " * 40, "a caption of forty characters, or about."
    inner = f"<p>{long}</p><figure><figcaption>{caption}</figcaption></figure><p>{long}</p>"
    page = f"<html><body>{'<div>' * depth}{inner}{'</div>' * depth}</body></html>"
    assert htmlcut.main_text(page) == "\n\n".join([long.strip(), caption, long.strip()])


@pytest.mark.parametrize("skipped", ["<svg/>", "<math />", "<svg width='1'/>", "<button>", "<select>", "<object>", "<canvas>", "<noscript>", "<template>", "<svg>", "<button>no</button>", "<template>no</template>"])
def test_html_skips_only_what_is_closed(skipped):
    long = "word " * 40
    page = f"<html><body>{'<div>' * 6}<p>{long}</p>{skipped}<p>{long}</p>{'</div>' * 6}</body></html>"
    assert htmlcut.main_text(page) == "\n\n".join([long.strip()] * 2)


PROSE = "A sentence of an article that goes on for a while, says one thing after another, and is long enough to be told from a caption or a label."


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        (f'<section id="search-algorithms"><h2>Search</h2><p>{PROSE}</p><p>Short one.</p></section>', ["Search", PROSE, "Short one."]),
        (f'<div class="related-work"><p>{PROSE}</p></div>', [PROSE]),
        ('<p class="lead share-price">The share price fell by two.</p>', ["The share price fell by two."]),
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as known</p>", ["Energy is E=mc2 as known"]),
        ("<p>See <object data=x>the figure</object> and <canvas>the chart</canvas>.</p>", ["See the figure and the chart."]),
        (f"<noscript><p>{PROSE}</p></noscript>", [PROSE]),
        (f'<h2 id="comments">On comments</h2><p>{PROSE}</p>', ["On comments", PROSE]),
        (f'<section id="discussion"><p>{PROSE}</p></section>', [PROSE]),
        (f'<div class="form-follows-function"><p>{PROSE}</p></div>', [PROSE]),
        # These go, inside an article as well.
        (f'<div class="comments-area"><p>{PROSE}</p></div>', []),
        (f'<section id="comments"><p>{PROSE}</p></section>', []),
        (f'<div class="ad-slot"><p>{PROSE}</p></div>', []),
        (f'<div class="cookieNotice"><p>{PROSE}</p></div>', []),
        ('<div class="share-buttons">Share this</div><div class="related"><ul><li><a href=x>One more</a></li></ul></div>', []),
        (f'<div role="complementary"><p>{PROSE}</p></div><form class=x><p>{PROSE}</p></form>', []),
        (f'<div class="widget social"><a href=x>{PROSE}</a></div>', []),
    ],
)
def test_html_names_inside_an_article(inside, want):
    first, last = PROSE.replace("sentence", "start"), PROSE.replace("sentence", "close")
    page = f"<html><body class='has-sidebar post'><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{first}</p>{inside}<p>{last}</p></article><footer>Us</footer></body></html>"
    assert htmlcut.main_text(page).split("\n\n") == ["Title", first, *want, last]


def made_page(r):
    """A page and its article's blocks, as they were put together."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "ab", "c"]) for _ in range(n)) + r.choice([".", "!", "?"])
    name = lambda: r.choice(["", f' id="{r.choice(["search-methods", "form-of-words", "related-work", "legal-history", "tags-and-trees", "share-of-votes", "login-trouble"])}"', f' class="{r.choice(["lead", "has-sidebar", "no-comments", "intro text", "wide"])}"'])
    want, body = [], []
    for _ in range(r.randint(2, 8)):
        text = words(r.randint(6, 60))
        kind = r.choice(["p", "p", "p", "section", "quote", "list", "heading"])
        if kind == "list":
            items = [words(r.randint(5, 12)) for _ in range(r.randint(1, 4))]
            body.append(f"<ul{name()}>" + "".join(f"<li>{x}" + r.choice(["</li>", "", "\n"]) for x in items) + "</ul>")
            want += items
        else:
            body.append({"p": f"<p{name()}>{text}</p>", "section": f"<section{name()}>\n<p>{text}</p></section>", "quote": f"<blockquote{name()}>{text}</blockquote>", "heading": f"<h2{name()}>{text}</h2>"}[kind])
            want.append(text)
        if r.random() < 0.3:
            body.append(r.choice([f'<aside>{words(30)}</aside>', f'<div class="advert">{words(9)}</div>', f'<form><p>{words(40)}</p></form>', f"<script>{words(5)}</script>", f'<div class="comment-list"><p>{words(50)}</p></div>', f"<!-- {words(4)} -->", f"<style>{words(3)}</style>"]))
    around = lambda: "".join(r.choice([f"<nav><ul><li><a href=x>{words(2)}</a></ul></nav>", f'<div class="sidebar"><p>{words(40)}</p></div>', f'<div id="cookie-banner">{words(20)}</div>', f"<footer>{words(5)}</footer>", f'<header><a href="/">{words(2)}</a></header>', f'<section class="comments"><p>{words(60)}</p></section>']) for _ in range(r.randint(0, 3)))
    return f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around()}<{r.choice(['article', 'main'])}>{''.join(body)}</article></main>{around()}</body></html>", want


def test_html_of_made_pages():
    r = random.Random(12)
    for _ in range(400):
        page, want = made_page(r)
        assert htmlcut.main_text(page) == "\n\n".join(want), page


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 7)
        costs = [r.randint(-9, 9) for _ in range(n)]
        ties = [(i, j, r.randint(0, 6)) for i in range(n) for j in range(i) if r.random() < 0.6]
        price = lambda side: sum(c for c, s in zip(costs, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(costs, side, strict=True) if c < 0 and s) + sum(c for i, j, c in ties if side[i] != side[j])  # noqa: B023, E731
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(htmlcut.minimum_cut(costs, ties)) == best


def without_hints(r):
    """A page of blocks of which few tell of themselves what they are."""
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randint(2, 7) for _ in range(n))
    kinds = [lambda: f"<p>{words(40)}</p>", lambda: f"<p>{words(5)}</p>", lambda: f"<div>{words(3)}</div>", lambda: f"<div>{words(8)}</div>", lambda: f"<li><a href=x>{words(3)}</a></li>", lambda: f"<div><div><span>{words(10)}</span></div></div>", lambda: f"<h2>{words(2)}</h2>"]
    return "<html><body><div>" + "".join(r.choice(kinds)() for _ in range(r.randint(2, 10))) + "</div></body></html>"


def test_html_cut_decides_what_blocks_dont():
    """Over generated pages: the labels are those of a cheapest cut, and ties change many of them."""
    r, changed, every = random.Random(7), 0, 0
    for _ in range(300):
        found = htmlcut.blocks_of(without_hints(r))
        costs, ties, keep = [htmlcut.capacity(b) for b in found], htmlcut.ties_of(found), htmlcut.labels(found)
        price = lambda side: sum(abs(c) for c, s in zip(costs, side, strict=True) if (c > 0) != s and c) + sum(c for i, j, c in ties if side[i] != side[j])  # noqa: B023, E731
        assert price(keep) == min(price([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
        changed += sum(k != (c > 0) for k, c in zip(keep, costs, strict=True))
        every += len(found)
    assert changed > every // 20


def test_html_long_pages():
    import time

    long, short = "word " * 40, "two words"
    page = "<html><body>" + "".join(f"<div><p>{long if i % 3 else short} {i}</p></div><div class='ad'>x</div>" for i in range(5000)) + "</body></html>"
    began = time.process_time()
    found = htmlcut.blocks_of(page)
    middle = time.process_time()
    keep = htmlcut.labels(found)
    assert len(found) == 10_000 and time.process_time() - middle < 1 and middle - began < 5
    assert sum(keep) == 5000 and not any(k for k, b in zip(keep, found, strict=True) if b.text == "x")


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars, r.n_chars == len(r.text)) for r in htmlcut.extract_main_text(df).collect())
    assert got[2] == ("None", 0, True) and got[0] == ("1", 0, True) and got[1][1] > 50
    assert htmlcut.extract_main_text(df.limit(0)).collect() == []


def test_zip_directory():
    for zip64 in (False, True):
        buf = io.BytesIO()
        w = warczip.ArchiveWriter(buf, zip64)
        for i in range(5):
            w.add(i, f"http://x/{i}", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), None if i else 3)
        w.close()
        at = warczip.directory(buf, buf.tell() or len(buf.getvalue()))
        with zipfile.ZipFile(buf) as z:
            for name in z.namelist():
                off, n = at[name]
                assert z.read(name) == buf.getvalue()[off : off + n]
    # A ZIP64 end record and wide fields, as files over 4 GB have them.
    import struct

    data = b"hello"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"f" + data
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"f" + extra
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    loc = b"PK\6\7" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + central + end64 + loc + end
    off, n = warczip.directory(io.BytesIO(raw), len(raw))["f"]
    assert raw[off : off + n] == data


def test_warc_records_are_checked(tmp_path):
    class Stream(io.RawIOBase):  # as an object store's: no seeking
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    out = Stream()
    w = warczip.ArchiveWriter(out)
    w.add(1, None, b"fine", hashlib.sha1(b"fine").hexdigest(), None)
    w.add(2, "u", b"wrong", hashlib.sha1(b"other").hexdigest(), None)
    w.add(3, "u", b"again", hashlib.sha1(b"again").hexdigest(), 1)
    w.close()
    members = warczip.directory(io.BytesIO(out.data), len(out.data))
    (base, _), (at, n) = members[warczip.DATA], members[warczip.INDEX]
    import json

    lines = [json.loads(x) for x in out.data[at : at + n].decode().splitlines()]
    records = [warczip.read_record(out.data[base + x["offset"] :][: x["length"]]) for x in lines]
    warczip.check(*records[0])
    warczip.check(*records[2])
    with pytest.raises(ValueError):
        warczip.check(*records[1])
    assert warczip.store_of("file:///x/y")[1] == "/x/y" and "s3" in warczip.store_of("s3a://bucket/key?region=us-east-1")[0].type_name


def test_warc_of_long_and_repeated_pages(spark):
    long = "päge " * 400_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (2, "u", long), (3, "u", "")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warczip.warc_round_trip(df).collect())
    assert got == [(1, 2_400_000, "revisit", 2), (2, 2_400_000, "response", None), (2, 2_400_000, "response", None), (3, 0, "response", None)]


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a\r\nX: y", big, "x"), (2, None, big, "x"), (7, "u", big, "x"), (3, "u", "é" * 499, "x"), (4, "u", "é" * 499, "x"), (5, "u", None, "x"), (None, "u", "z" * 2000, "x"), (None, "u", big, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in warczip.warc_round_trip(df).collect())
    want = []
    for page, _, text, _ in rows:
        p = (text or "").encode()
        visit = text == big and page != 7
        want.append((str(page), len(p), hashlib.sha1(p).hexdigest(), "revisit" if visit else "response", 7 if visit else None, None if visit else p))
    assert got == sorted(want, key=lambda x: x[:4]) or sorted(map(str, got)) == sorted(map(str, want))
    assert warczip.warc_round_trip(df.limit(0)).collect() == []


def test_mixing_budgets(spark):
    rows = [(i, "w " * 10, "en" if i % 3 else "de", f"src{i % 5}") for i in range(500)] + [(1000, None, None, None), (1001, "w " * 7, None, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, slice int")
    got = mixing.mix_sources(df, budget_percent=50, max_epochs=2, weights={"lang": {"de": 3}}).collect()
    assert len(got) == len(rows)
    taken, budget = Counter(), {}
    for r in got:
        taken[(r.domain, r.lang, r.source)] += r.n_tokens * r.n_epochs
        budget[(r.domain, r.lang, r.source)] = r.leaf_budget
    assert all(budget[k] - 10 < taken[k] <= budget[k] or budget[k] == 0 for k in budget)
    assert sum(budget.values()) <= 5007 // 2 and sum(budget.values()) > 5007 // 2 - 20
    again = {r.doc_id: r.n_epochs for r in mixing.mix_sources(df, budget_percent=50, max_epochs=2, weights={"lang": {"de": 3}}).collect()}
    assert again == {r.doc_id: r.n_epochs for r in got}
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_mixing_equals_sql(spark):
    """Weights on all three levels; a leaf whose digests fall into many slices."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, None if i == 3 else "w " * (i % 9), ("en", "de", None)[i % 3], f"src{i % 7}" if i % 2 else "src9") for i in range(3000)] + [(1, "w", "en", "src1"), (None, "w w", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    key = lambda r: tuple(map(str, r))
    got = sorted(map(key, mixing.mix_sources(df, weights=mixing.TARGETS).collect()))
    assert got == sorted(map(key, con.execute(mixing.sql(weights=mixing.TARGETS)).fetchall()))


def test_mixing_stage_keeps_what_is_taken(spark, tmp_path):
    import corpus_pipeline as c

    rows = [(i, "w " * 10, "en" if i % 3 else None, f"src{i % 5}", 20) for i in range(200)]
    rows += [(None, "w", "en", "src1", 1), (None, "w", None, None, 1), (7, "w " * 9, "de", "src2", 18), (7, "w " * 400, "fr", "src3", 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    taken = {(r.doc_id, r.lang, r.source, r.n_tokens) for r in mixing.mix_sources(df, budget_percent=90, max_epochs=1).collect() if r.n_epochs}
    got = {(r.doc_id, r.lang or "?", r.source or "?", len(r.text.split())) for r in c.mixing_stage(spark, df, str(tmp_path)).collect()}
    assert got == taken and any(d is None for d, *_ in got)


def test_water_fill(spark):
    rows = [("a", 10, 1, 100), ("b", 100, 1, 100), ("c", 100, 2, 100), ("d", 50, 0, 100)]
    got = {r.k: r.share for r in mixing.water_fill(spark.createDataFrame([("p", *r) for r in rows], "p string, k string, cap long, weight long, budget long"), ["p"], "k").collect()}
    assert got == {"a": 10, "b": 30, "c": 60, "d": 0}


def test_licenses(spark):
    mit = LICENSES["MIT"]
    rows = [(1, "Copyright (c) 2020 Me\n" + mit.upper().replace(",", "")), (2, mit.replace("sublicense", "sublicence") + "\n"), (3, "text\n\tReleased under  the MIT Licence!\nlicensed under CC-BY-NC 4.0"), (4, None), (None, mit), (5, mit + " more"), (6, ""), (7, "Made under the Toy deal."), (7, "word " * 100_000), (8, "conversion of it"), (9, "convof it")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    out = licenses.license_scan(df, notices=NOTICES | {"Toy": "made under the TOY deal"}).collect()
    got = {(r.doc_id, r.license_id, r.notice_ids) for r in out}
    assert got == {(1, "MIT", None), (2, "MIT", None), (3, None, "CC-BY-NC-4.0,MIT"), (4, None, None), (None, "MIT", None), (5, None, None), (6, None, None), (7, None, "Toy"), (7, None, None), (8, None, None), (9, None, None)}
    assert len(out) == len(rows) and len({r.digest for r in out if r.doc_id in (8, 9)}) == 2
    assert licenses.license_scan(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_licenses_by_digest(spark):
    read = lambda name: open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()  # noqa: E731, SIM115
    gpl = read("GPL-3")
    one_line = " ".join(read("MPL-2.0").split())
    rows = [(1, gpl), (2, gpl.replace("  ", " ").upper()), (3, one_line), (4, read("Apache-2.0") + "x"), (5, "Copyright 2024 A. Body\n" + read("LGPL-2.1"))]
    got = {r.doc_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "GPL-3.0", 2: "GPL-3.0", 3: "MPL-2.0", 4: None, 5: "LGPL-2.1"}


def test_top_k(spark):
    r = random.Random(4)
    vec = lambda: [r.choice([-1.0, 0.5, 0.25, r.gauss(0, 1)]) for _ in range(6)]
    rows = [(i, vec()) for i in range(0, 1500, 5)] + [(1, None), (2, [None] * 6), (3, [float("nan")] * 6), (None, vec()), (4, [1.0, 2.0]), (100, vec()), (6, [])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    import math

    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for x in topk.exact_top_k(df, k=10, every=100).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q in {i for i, _ in ok if i % 100 == 0 and i != 100}:
        qv = next(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv))[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.exact_top_k(df.limit(0)).collect() == []


def test_top_k_in_a_grid(spark, monkeypatch):
    """Queries beyond what is broadcast: blocks of either side meet in cells, each pair once."""
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3 if i % 5 else 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    for name, value in (("CANDIDATES", 16), ("QUERIES", 4), ("RUN", 5), ("HELD", 3)):
        monkeypatch.setattr(topk, name, value)
    plain = sorted(map(tuple, topk.exact_top_k(df, every=7).collect()))
    monkeypatch.setattr(topk, "SMALL", 0)
    assert sorted(map(tuple, topk.exact_top_k(df, every=7).collect())) == plain
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    for q in (0, 7, 455):
        best = sorted(((-score(q, i), i) for i in whole if i != q and len(whole[i]) == len(whole[q])))[:10]
        assert [(x[2], x[3]) for x in plain if x[0] == q] == [(i, -s) for s, i in best]


def test_top_k_of_repeated_rows(spark):
    """Rows that share an id are queries of their own, and candidates of each other."""
    r = random.Random(8)
    same, other = [2.0] * 6, [-1.0] * 6
    rows = [(100, same)] * 3 + [(100, other), (200, None)] + [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(1, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.exact_top_k(df, k=10, every=100).collect())
    import math

    whole = lambda v: [math.floor(1024 * a) for a in v]
    want = []
    for n, (i, q) in enumerate(rows):
        if i == 100:
            best = sorted((-sum(a * b for a, b in zip(whole(q), whole(v), strict=True)), j) for m, (j, v) in enumerate(rows) if m != n and v)[:10]
            want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert got == sorted(want) and len(got) == 40


def test_top_k_of_large_components(spark):
    """Scores beyond 2 ** 53 are ranked by their true values, and beyond 64 bits come back as the nearest number."""
    rows = [(100, [1e17, 3.0]), (1, [1e17, 3.0]), (2, [1e17, 3.001]), (3, [-1e17, 0.0]), (4, [1e306, 0.0]), (5, [2.0**45 / 1024, 1.0]), (200, [2.0**25, 2.0**-10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = [(x.query_id, x.vec_id, x.score) for x in sorted(topk.exact_top_k(df, k=10, every=100).collect(), key=lambda x: (x.query_id, x.rank))]
    most = 2**63 - 1
    assert [g for g in got if g[0] == 100] == [(100, 2, most), (100, 1, most), (100, 5, most), (100, 200, most), (100, 3, -most - 1)]
    assert (200, 5, 2**35 * 2**45 + 1024) not in got and (200, 5, most) in got


@pytest.mark.parametrize("blocks", [1, 4])
def test_top_k_bounds_go_from_block_to_block(blocks):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.integers(-50, 50, (4000, 8)).astype(float)
    x[:30] = 900 + r.integers(0, 50, (30, 8))
    rows = np.arange(0, 4000, 200)
    q = np.abs(x[rows]) + 1
    q[0] = -q[0]
    best, reads = topk.Best(q, 10), []
    for ids in np.array_split(np.arange(4000), blocks):
        here = np.flatnonzero(np.isin(rows, ids))
        reads.append(topk.block_top_k(ids, x[ids], (rows[here] - ids[0], here), best))
    assert (reads[-1] < 1).all() and reads[-1].mean() <= reads[0].mean()
    for j in range(len(q)):
        s = x @ q[j]
        s[rows[j]] = -np.inf
        assert best.ids[best.query == j].tolist() == np.lexsort((np.arange(4000), -s))[:10].tolist()


@pytest.mark.parametrize("dims", [1, 2, 8])
def test_top_k_reads_lists_only(dims):
    """Bounds are made of what the lists were read to; vectors are opened for the final scores of a few alone."""
    import numpy as np

    r = np.random.default_rng(dims)
    x = np.floor(r.pareto(1.5, (6000, dims)) * 100 * r.choice([-1, 1], (6000, dims)))

    class Vectors:
        opened = 0

        def __getitem__(self, rows):
            self.opened += len(rows)
            return x[rows]

    q = r.integers(-9, 10, (20, dims)).astype(float)
    lists, vectors, best = topk.Lists(x), Vectors(), topk.Best(q, 10)
    ids = np.arange(6000)
    read = topk.block_top_k(ids, vectors, (np.arange(20), np.arange(20)), best, lists)
    zero = ~q.any(1)
    assert vectors.opened <= 8 * 10 * 20 and (read[~zero] < 1).mean() > 0.5
    if 2 * lists.depth < 6000:  # beyond it, the two ends meet
        unread = ~np.isfinite(lists.top) & ~np.isfinite(lists.bottom)
        assert unread.any()
        assert not lists.met[unread.all(1)].any()
    for j in range(20):
        s = x @ q[j]
        s[j] = -np.inf
        assert best.ids[best.query == j].tolist() == np.lexsort((ids, -s))[:10].tolist()
    again = topk.Best(q, 10)  # other queries find the lists read
    topk.block_top_k(ids, vectors, (np.arange(20), np.arange(20)), again, lists)
    assert again.ids.tolist() == best.ids.tolist() and again.scores.tolist() == best.scores.tolist()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in c.run(spark, SF).collect()}
    assert got and set(got) <= set(texts) and [s for s, _ in c.STAGES][0] == "quality rules"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in c.quality_rules(spark, docs, SF).collect()}
    assert all(d in kept for d, q in labels.items() if q and len(texts[d].split()) >= 20)
    assert not any(d in kept for d, q in labels.items() if not q)
