"""Each operator against a plain version, on the small table and on awkward rows."""

import gzip
import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from souklens.llm import bpe, fmindex, language, licences, minmax, pii, quality, queries, warc, wrappers
from souklens.llm import textbytes as tb
from souklens.llm.components import components


def both(small, edge):
    """The small table and the awkward rows, ids of the latter moved out of the way."""
    return small.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# -- spans and hashes of bytes


def test_spans_do_not_cross_texts():
    block = next(tb.blocks(pa.array(["ab c", None, "", "de", " f"])))
    starts, ends = tb.spans(tb.SOLID[block.data], block.offsets)
    assert [block.data[a:b].tobytes() for a, b in zip(starts, ends)] == [b"ab", b"c", b"de", b"f"]
    codes, words = tb.distinct(block.data, starts, ends)
    assert [words[c] for c in codes] == [b"ab", b"c", b"de", b"f"]
    other = next(tb.blocks(pa.array(["x  f de"])))
    codes, others = tb.distinct(other.data, *tb.spans(tb.SOLID[other.data], other.offsets))
    assert tb.hash_words(others)[codes][[2, 1]].tolist() == tb.hash_words(words)[[2, 3]].tolist()


def test_codes_of_rows():
    rng = np.random.default_rng(0)
    for top in (3, 1 << 20, 1 << 40):
        columns = [rng.integers(0, top, 2000) % 7 * (top // 7 + 1) for _ in range(5)]
        codes, rows = tb.dense(columns).tolist(), list(zip(*[c.tolist() for c in columns]))
        assert len(set(zip(codes, rows))) == len(set(codes)) == len(set(rows))
    assert tb.dense([np.zeros(0, np.int64)] * 3).tolist() == []


def thue_morse():
    """Two words of 2,048 letters that any polynomial hash modulo 2^64 takes for one."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_equal_words_have_equal_bytes(spark, library):
    """Ops 3, 4, 6, 8, 9 and 10 on two words that a weak hash can't tell apart."""
    x, y = thue_morse()
    tail = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, x), (2, y), (3, f"{x} {tail}\n{y} {tail}\n{x} {tail}"), (4, f"{x} {x} {x} {x}"), (5, f"{y} {y} {y} {y}"), (6, f"{x} a {x} b {y} a {x} b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = queries.tokenizer_file()
    want = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows for ids in [library.encode(t, add_special_tokens=False).ids]]
    same([tuple(r)[:4] for r in bpe.round_trip(docs, path).collect()], want)
    same([(r["doc_id"], r["n_tokens"]) for r in bpe.token_counts(docs, path, size=5).collect()], [w[:2] for w in want])
    same([tuple(r) for r in minmax.near_duplicates(docs, percent=85).collect()],
         [(i, n, c, c == i) for i, (n, c) in brute.components(rows, 85).items()])
    bench = spark.createDataFrame([(1, y), (2, f"{y} one two three four five six seven eight nine")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["items"]) for r in fmindex.scan(docs, bench).collect()}
    assert found == {1: (0, []), 2: (1, ["1"]), 3: (10, ["1", "2"]), 4: (0, []), 5: (4, ["1"]), 6: (1, ["1"])}
    got = {r["doc_id"]: r for r in licences.scan(docs, phrases={y: "y"}).collect()}
    assert [got[i]["n_base"] for i in range(1, 7)] == [0, 1, 1, 0, 4, 1] and got[6]["first_word"] == 4
    made = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.assess(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert made[3][0] == 1 and made[6] == (0, 6) and made[4] == (0, 4)


def test_blocks_hold_whole_texts():
    texts = ["a" * n for n in (3, 50, 1, 0, 7)]
    got = [b.text(i).decode() for b in tb.blocks(pa.array(texts), limit=8) for i in range(len(b))]
    assert got == texts


# -- 1


def test_pii_base(small, edge):
    df = both(small, edge)
    extra = df.sparkSession.createDataFrame([(1, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 4111-1111 11111111 +1 (2)345-678-901 +12 12345678901234567890 é a@b.co"),
                                             (2, "9" * 3000 + " " + "a" * 3000 + "@" + "1." * 500)], "doc_id long, text string")
    df = df.unionByName(extra)
    got = pii.find(df).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t))) for i, t in rows_of(df)]
    same([tuple(r) for r in got], want)


def test_pii_adds_and_redacts(spark):
    def line(i):
        return f"call +1 ({200 + i}) 555-{1000 + i} or write to user{i}@mail.example.com now"

    rows = [(i, line(i)) for i in range(60)] + [(100, "call (321) 555-4321 today"), (101, None), (102, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [s["kind"] for s in got[3]["base"]] == ["email", "phone"]
    assert [(s["kind"], rows[60][1][s["start"]:s["end"]]) for s in got[100]["spans"]] == [("phone", "(321) 555-4321")]
    assert got[100]["base"] == [] and got[101]["spans"] == [] and got[102]["spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[3] == "call [PHONE] or write to [EMAIL] now" and clean[100] == "call [PHONE] today" and clean[101] is None and clean[102] == "nothing here"


def test_pii_adds_as_many_as_base(spark):
    """As many plain spans as base ones, and as many of what is known to be wrong."""
    rows = []
    for i in range(200):
        rows += [(i, f"call +1 ({200 + i}) 555-{1000 + i} or write to user{i}@mail.example.com now"), (1000 + i, f"call 1 ({200 + i}) 555-{1000 + i} today"),
                 (2000 + i, f"call ({200 + i}) 555-{1000 + i} today"), (3000 + i, f"write to user{i} (at) mail (dot) com now"),
                 (4000 + i, f"from 10.20.{i}.7 on 2024-10-{10 + i % 20} at 20-10-{10 + i % 20}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r["doc_id"]: [(s["kind"], text[r["doc_id"]][s["start"]:s["end"]]) for s in r["spans"]] for r in pii.find(docs).collect()}
    for i in range(200):
        assert got[1000 + i] == [("phone", f"1 ({200 + i}) 555-{1000 + i}")]
        assert got[2000 + i] == [("phone", f"({200 + i}) 555-{1000 + i}")]
        assert got[3000 + i] == [("email", f"user{i} (at) mail (dot) com")]
        assert got[4000 + i] == [("ip", f"10.20.{i}.7")]


def test_pii_adds_secrets(spark):
    """Keys by their name or prefix, and unnamed ones of the same form; not revisions, check sums, words or numbers."""
    def hexed(i):
        return hashlib.sha1(str(i).encode()).hexdigest()

    rows = []
    for i in range(120):
        rows += [(i, f'set token = "{hexed(i)}" and go'), (1000 + i, f"use password={hexed(i)[:18]}."), (2000 + i, f"the key AKIA{hexed(i)[:16].upper()} is ours"),
                 (3000 + i, f"commit {hexed(-i - 1)} of sha256: {hexed(-i - 2)}"), (4000 + i, f"Donaudampfschifffahrtsgesellschaft internationalization {10**29 + i * 7919}"),
                 (5000 + i, f"see {hexed(i)[:9]}.example.com or user{hexed(i)[:12]}@mail.example.com")]
    rows += [(9000, f'here "{hexed(7777)}" stands alone'), (9001, "a" * 5000 + "1" * 5000 + "@"), (9002, None), (9003, "x-" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    got = {i: [text[i][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "secret"] for i, r in found.items()}
    for i in range(120):
        assert got[i] == [hexed(i)] and got[1000 + i] == [hexed(i)[:18]] and got[2000 + i] == ["AKIA" + hexed(i)[:16].upper()]
        assert got[3000 + i] == [] and got[4000 + i] == [] and got[5000 + i] == []
    assert got[9000] == [hexed(7777)]
    assert got[9001] == [] and got[9002] == [] and got[9003] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[5] == 'set token = "[SECRET]" and go' and clean[1005] == "use password=[SECRET]." and clean[3005] == text[3005]


def test_pii_thresholds_are_set_on_other_rows():
    """Trees see one half only: a form that is right there and wrong in the other half is left out."""
    x = {f: 0 for f in pii.FEATURES}
    good, bad = {**x, "digits": 9}, {**x, "digits": 3}
    fit = [(good, 50, 50), (bad, 0, 50)]
    assert pii.Model({"card": (fit, [(good, 30, 30), (bad, 0, 30)])}).least["card"] < math.inf
    assert pii.Model({"card": (fit, [(good, 10, 30), (bad, 1, 30)])}).least["card"] == math.inf


def test_pii_without_rows(none):
    assert pii.find(none).count() == 0 and pii.redact(none).columns == none.columns


# -- 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p><article>";</script></head><body><header>Site</header><nav><ul><li>Home<li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head {i} &amp; more</h1><p class="tag">Share this</p><p><b>First   {i}<br>line<p>Second&nbsp;{i} <i>in</i>line</p>
<form><input>Mail</form><div id="comments">nice {i}</div></article><aside>side {i}</aside><footer>(c) {i}</footer>"""


def test_wrapper_text(spark):
    rows = [(i, f"http://a.example.com/{i}", PAGE.replace("{i}", str(i))) for i in range(5)]
    rows += [(10, "http://b.example.com/x", "<p>only text<p>twice"), (11, None, None), (12, "http://b.example.com/y", ""), (13, None, "<div><div class=ad>ad</div>plain &lt;b&gt;"),
             (14, "http://c.example.com", "<div>" * 3000 + "deep" + "<a \"" * 200), (10, "http://b.example.com/x", "<p>only text<p>twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert got[2] == "Head 2 & more\n\nFirst 2 line\n\nSecond 2 inline"  # the tag line never changes: template
    assert got[10] == "only text\n\ntwice" and got[11] == "" and got[12] == "" and got[13] == "plain <b>" and got[14].startswith("deep")
    assert wrappers.extract(pages).count() == len(rows)
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_wrapper_names_are_whole_classes(spark):
    text = "<article><h1>Head {i}</h1><p>Text {i}</p></article>"
    whole = ["<div class='layout has-sidebar'>" + text + "</div>", "<div class=no-sidebar>" + text + "</div>", "<form id=aspnetForm><div id=comments>nice</div>" + text + "</form>",
             "<div class='sidebar'>" + text + "</div>", "<article><div class='article-header'><h1>Head {i}</h1></div><p>Text {i}</p></article>",
             "<main><div class='post-header header'><h1>Head {i}</h1></div><form><input>Mail</form><p>Text {i}</p><div class=comment-list>nice</div></main>",
             "<div>Site</div><form id=aspnetForm><nav>Menu</nav><div><h2>Head {i}</h2><p>Text {i}</div></form>",
             "<form id=aspnetForm><div><h2>Head {i}</h2><p>Text {i}</div></form>",
             text + "<div class='related posts'><article><h2>Other {i}</h2></article></div><div class=cookie-notice>We use cookies</div>"]
    rows = [(i, f"http://h{i}.example.com/", h.replace("{i}", str(i))) for i, h in enumerate(whole)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(len(whole)):
        assert got[i] == ("Site\n\n" if i == 6 else "") + f"Head {i}\n\nText {i}", (i, got[i])
    hidden = "<div hidden><article>Gone</article></div><aside><main>Gone</main></aside><p>Left</p><div class=sidebar>Side</div><form>Mail</form>"
    assert wrappers.article(hidden, None, set(), wrappers.Aligner()) == "Left"


def test_wrapper_keeps_constant_article_text(spark):
    quoted = "<body><div class=top>Top</div><p>{i}</p><blockquote>Quoted</blockquote>"
    recipe = "<body><h3>Our recipes</h3><article><h1>Dish {i}</h1><p class=byline>By us</p><h2>Ingredients</h2><p>Flour {i}</p><h2 id=how>Method</h2><p>Stir {i}</p><table><td>Serves 4</table><h3>Our recipes</h3></article>"
    rows = [(i, f"http://a.example.com/{i}", quoted.replace("{i}", "copied")) for i in range(8)]
    rows += [(10 + i, f"http://a.example.com/{i}", f"<body><div class=top>Top</div><p>{i}</p><{t}>own {i}</{t}>") for i, t in enumerate("ul ol pre dl table section".split())]
    rows += [(20 + i, f"http://b.example.com/{i}", recipe.replace("{i}", str(i))) for i in range(8)]
    # five of twelve distinct pages agree: less than the share
    rows += [(40 + i, f"http://c.example.com/{i}", f"<body><p>{i}</p>" + ("<blockquote>Quoted</blockquote>" if i < 5 else "")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "copied\n\nQuoted" for i in range(8)), got[0]
    assert got[10] == "0\n\nown 0"
    assert all(got[20 + i] == f"Dish {i}\n\nIngredients\n\nFlour {i}\n\nMethod\n\nStir {i}\n\nServes 4" for i in range(8)), got[20]
    assert all(got[40 + i] == f"{i}\n\nQuoted" for i in range(5)), got[40]


def test_wrapper_without_landmarks(spark):
    """Only the slots say what is text here: no article element, no telling names."""
    plain = "<body><div class=ka><ul><li>Home<li>News</ul></div><div class=kb>{ad}</div><div class=kc><div class=kd>Text {i}</div><p>more of {i}<p>and {i}</div><div class=ke>{foot}</div>"
    fill = lambda i, **more: plain.format(i=i, ad=f"Buy {i % 3}", foot=f"Host {i % 2}", **more)
    rows = [(i, f"http://a.example.com/{i}", fill(i)) for i in range(30)]
    # four texts under twelve adverts and menus in turn: what varies least is the text, and nothing is cut that could be it
    rows += [(100 + i, f"http://b.example.com/{i}", plain.format(i=i % 4, ad=f"Buy {i % 12}", foot="Host")) for i in range(24)]
    # too few pages for a wrapper
    rows += [(200 + i, f"http://c.example.com/{i}", fill(i)) for i in range(4)]
    # inside an article texts in turn are its own
    rows += [(300 + i, f"http://d.example.com/{i}", f"<body><div class=ka>Menu {i % 2}</div><article><h1>Head {i}</h1><div class=kb>Part {i % 2}</div><p>Text {i}</p></article>") for i in range(30)]
    rows += rows[:40] * 2  # copies are no evidence
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {}
    for r in wrappers.extract(pages).collect():
        assert got.setdefault(r["page_id"], r["text"]) == r["text"]
    for i in range(30):
        assert got[i] == f"Text {i}\n\nmore of {i}\n\nand {i}", (i, got[i])
        assert got[300 + i] == f"Head {i}\n\nPart {i % 2}\n\nText {i}", (i, got[300 + i])
    for i in range(12):
        assert got[100 + i] == f"Buy {i}\n\nText {i % 4}\n\nmore of {i % 4}\n\nand {i % 4}", (i, got[100 + i])
    assert got[200] == "Home\n\nNews\n\nBuy 0\n\nText 0\n\nmore of 0\n\nand 0\n\nHost 0"


def test_wrapper_of_given_pages(spark):
    """Every text of the given pages against a plain reading of their article elements."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        inner = re.sub(r"<(script|style|form)\b.*?</\1>|<!--.*?-->", "", inner[1] if inner else "", flags=re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d|div|li|ul|ol|table|tr|td|blockquote|section)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b), r["page_id"]


def test_simple_tree_matching():
    a, _ = wrappers.parse("<body><div class=x><p>1</p></div><div class=y><ul><li>2</li></ul></div>")
    b, _ = wrappers.parse("<body><div class=z><p>0</p></div><div class=x><p>1</p></div><section>s</section><div class=y><ul><li>2</li></ul></div>")
    size, pairs = wrappers.match(wrappers.read(wrappers.written(a)), wrappers.read(wrappers.written(b)))
    assert len(pairs) == 7 and dict(pairs)[2] == 4  # class x meets class x, not the first div


# -- 3


def test_licences(small, edge):
    df = both(small, edge)
    text = "The MIT License. Apache license, CC BY-NC; released under the MIT license GNU General Public License mit mit license"
    df = df.unionByName(df.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licences.scan(df).collect()]
    same(got, [(i, *brute.licences(t)) for i, t in rows_of(df)])


def test_licence_templates(spark):
    grant, words = licences.TEMPLATES["mit-grant"], licences.TEMPLATES["mit-grant"].split()
    rows = [(1, "x " + grant + " y"), (2, " ".join(words[:20] + ["(edited)", "by", "us"] + words[20:])), (3, " ".join(words[:12])), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY 4.0"), (6, None)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit-grant" and got[1]["spans"][0]["start"] == 1 and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit-grant" and 0.9 < got[2]["score"] <= 1.0
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < 0.5
    assert got[4]["labels"] == "cc-by,cc-by-nc-4.0" and got[5]["labels"] == "cc-by,cc-by-4.0"
    assert got[6]["score"] == 0.0 and got[6]["labels"] == ""


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(30):
        sequences = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.randint(0, 4) for _ in range(40)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton = licences.Automaton(sequences)
        for i, (state, size) in enumerate(automaton.statistics(text)):
            want = max([n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in runs], default=0)
            assert size == want
            for k, end in automaton.ends[state] if size else []:
                assert sequences[k][end + 1 - size:end + 1] == text[i + 1 - size:i + 1]


# -- 4 and 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


def test_bpe_as_library(small, edge, library):
    df = both(small, edge)
    got = bpe.round_trip(df, queries.tokenizer_file()).drop("same").collect()
    want = []
    for i, t in rows_of(df):
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, len(ids), brute.sha(packed), brute.sha(library.decode(ids, skip_special_tokens=False))))
    same([tuple(r) for r in got], want)


def test_bpe_walk_as_library(library):
    with open(queries.tokenizer_file(), "rb") as f:
        own = bpe.Bpe(f.read())
    rng = random.Random(7)
    pieces = ["a", "b", "z", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r", "19", "!", ".", "é", " ", "　", "日本", "٣", "²", "́", "​", "🙂", "\x1c", "\x85", "<|endoftext|>", "<|endof", "The", " the", "ing", "՘"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["ab" * 8000, " " * 2000 + "x"]
    for block in tb.blocks(pa.array(texts), limit=4096):
        ids, offsets = own.encode(block)
        for i, back in enumerate(own.decode(ids, offsets)):
            text = texts[block.first + i]
            assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
            assert back == text


def test_encode_then_decode(edge):
    path = queries.tokenizer_file()
    back = bpe.decode(bpe.encode(edge, path), path)
    same([tuple(r) for r in back.collect()], [(i, t or "") for i, t in rows_of(edge)])


def test_token_counts(small, edge, library):
    df = both(small, edge)
    want = []
    for i, t in rows_of(df):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    for size in (0, 5, bpe.FREQUENT):  # the table never changes a count
        same([tuple(r) for r in bpe.token_counts(df, queries.tokenizer_file(), size=size).collect()], want)


def test_bpe_without_rows(none):
    assert bpe.round_trip(none, queries.tokenizer_file()).count() == 0 and bpe.token_counts(none, queries.tokenizer_file()).count() == 0


# -- 5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = language.identify(docs, docs, keep=["doc_id", "lang"]).filter(language.held_out("doc_id"))
    row = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row["right"] > 0.98 and 0 <= row["low"] and row["high"] <= 1


def test_language_of_every_label(spark):
    # 205 regional tags in known families; each has words of its own
    codes = [f"{c}-{r}" for c in ("en", "fr", "pl", "lt", "hi") for r in range(100, 141)]
    rows = [(8 * i + j, code, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + k) % 26)}q" for k in range(12)) * 2) for i, code in enumerate(codes) for j in range(8)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string")
    sample = Counter(r["lang"] for r in language.pick_sample(docs, 1600).collect())
    assert set(sample) == set(codes) and set(sample.values()) == {8}
    machines = language.train(docs)
    assert len(machines.families) == 5 and len(machines.pairs) == 10 + 5 * 41 * 40 // 2
    made = language.predict(docs, machines, keep=["lang"])
    assert made.filter("lang = lang_pred").count() > 0.95 * len(rows)
    assert language.family_of("de_AT") == language.family_of("EN-us") == "germanic" and language.family_of("xx-1") == "xx" and language.family_of("") == ""


def test_language_sample_rows_are_packed(spark):
    docs = spark.createDataFrame([(i, "en" if i % 2 else "fr", f"word {i} " * 400) for i in range(4000)], "id long, lang string, text string")
    assert language.pick_sample(docs, language.SAMPLE_ROWS).count() == 2400


def test_language_machines_of_many_pairs():
    rng = np.random.default_rng(1)
    sample = [(f"x{i}", np.array([3 * i, 3 * i + 1, 1000 + j]), np.array([0.5, 0.3, 0.2], np.float32)) for i in range(30) for j in range(2)]
    machines = language.fit(sample)
    assert len(machines.pairs) > len(sample) and machines.weights.shape[1] == len(sample)  # kept by sample rows, not by pairs
    dense = np.zeros((len(sample), 1 << language.BITS), np.float32)
    for i, (_, at, share) in enumerate(sample):
        dense[i, at] = share
    lang, score = machines.decide(machines.margins(dense @ machines.weights))
    assert lang == [s[0] for s in sample] and 0 < score.min() <= score.max() <= 1


def test_language_edges(small, edge, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(edge, small).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= got and (4, "und") not in got and (6, "und") not in got
    assert {r["lang_pred"] for r in language.identify(edge, none).collect()} == {"und"}
    assert language.identify(none, small).count() == 0
    one = small.filter("lang = 'fr'")
    assert {r["lang_pred"] for r in language.identify(one, one).collect()} == {"fr"}


# -- 6


def test_leaks(spark, small, edge):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(90, "same words in the"), (91, None), (92, ""), (None, "long long"), (93, "LONG long long"), (93, "one two"), (94, "here same")], "item_id long, text string")
    bench, df = bench.unionByName(more), both(small, edge)
    want = [(i, n, len(hit), items) for i, n, hit, items in brute.leaks(rows_of(df), [(r[0], r[1]) for r in bench.collect() if r[0] is not None])]
    for size in (fmindex.BENCHMARK_BYTES, 1500):  # one block of the benchmark, and several
        got = fmindex.scan(df, bench, benchmark_bytes=size).select("doc_id", "n_words", "n_hit", "items").collect()
        same([tuple(r) for r in got], want)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in fmindex.scan(df, bench).collect()}
    assert spans[10_000_005] == [(0, 2)]
    assert fmindex.scan(df, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0
    assert fmindex.scan(df.limit(0), bench).count() == 0


def test_leaks_are_cut(spark):
    docs = spark.createDataFrame([(1, "before it. Alpha beta, gamma! after", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(1, "alpha BETA gamma")], "item_id long, text string")
    rows, back = tb.plain_columns(docs)
    got = {r["doc_id"]: (r["text"], r["n_words"]) for r in back(fmindex.remove(rows, bench, "c1")).collect()}
    assert got == {1: ("before it. \n! after", "x"), 2: (None, "y"), 3: ("clean", "z")}


# -- 7


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(3, "http://x/\r\nEvil: 1", long), (1, None, long), (2, "u", None), (5, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", long), (1, "u", long),
            (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 100), (8, "u", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = h == long and i != 1
        want.append((i, len(data), brute.sha(data), "revisit" if other else "response", 1 if other else None))
    same(got, want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_long_urls(spark, tmp_path, monkeypatch):
    rows = [(1, "http://x/" + "a" * 70_000, "long " * 30), (2, "u", "short"), (3, "http://x/" + "é" * 200_000, "long " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["payload_bytes"], r["record_type"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (rows[0][1], 150, "response"), 2: ("u", 5, "response"), 3: (rows[2][1], 150, "revisit")}
    # headers that do not end stop at the next version line
    warc.write_archives(pages.coalesce(1), str(tmp_path / "a"))
    plain = next((tmp_path / "a").glob("part-*")).read_bytes()
    got = list(warc.salvage(b"WARC/1.1\r\nWARC-Type: response\r\n" + plain))
    assert [r["kind"] for r in got] == ["gap", "response", "response", "revisit"] and got[0]["length"] == 31 and got[0]["reason"] == "headers do not end"
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: read(*a, **k).filter("record_id != '<urn:page:2>'"))
    with pytest.raises(ValueError, match="2 of 3"):
        warc.round_trip(pages)


def test_warc_files_of_long_pages(spark, tmp_path):
    """Many short pages beside long ones in one partition: no file outgrows its bound, nothing is lost."""
    rows = [(i, f"u{i}", "s" * 20) for i in range(1500)] + [(2000 + i, "u", f"{i:03d}" + "x" * 60_000) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert warc.write_archives(pages, str(tmp_path / "a"), file_bytes=1 << 17, most_bytes=1 << 19) == 1540
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert max(sizes) <= 1 << 19 and sum(sizes) > 2_400_000
    back = warc.read_archives(spark, str(tmp_path / "a"), payloads=False)
    assert back.filter("kind = 'response'").count() == 1540 and back.filter("kind = 'gap'").isEmpty()


def test_warc_size_groups():
    assert warc.size_groups([], 100, 1000) == [((0, 0), 1)]
    assert warc.size_groups([(4, 10, 200, 30), (3, 10, 100, 15)], 100, 1000) == [((3, 4), 6)]
    assert warc.size_groups([(3, 1000, 10_000, 15), (9, 1, 900, 900)], 100, 1000) == [((3, 3), 10), ((9, 9), 1)]
    assert warc.size_groups([(12, 3, 15_000, 5_000)], 100, 1000) == [((12, 12), 1)]


def test_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    plain = next((tmp_path / "a").glob("part-*")).read_bytes()
    records = [r for r in warc.salvage(plain)]
    assert [r["kind"] for r in records] == ["response"] * 6 and sum(r["length"] for r in records) == len(plain)
    cuts = [r["offset"] for r in records] + [len(plain)]
    whole = [plain[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    damaged = bytearray(plain)
    damaged[cuts[2] + len(whole[2]) - 10] ^= 1  # a byte of a payload
    got = list(warc.salvage(b"junk" + bytes(damaged[:-20])))
    assert [r["kind"] for r in got] == ["gap", "response", "response", "gap", "response", "response", "gap"]
    assert sum(r["length"] for r in got) == 4 + len(damaged) - 20
    members = [gzip.compress(x) for x in whole]
    broken = members[1][:len(members[1]) // 2]
    got = list(warc.salvage(members[0] + broken + members[2] + whole[3] + b"\x1f\x8b\x08junk" + members[4]))
    assert [r["kind"] for r in got] == ["response", "gap", "response", "response", "gap", "response"]
    assert [r["record_id"] for r in got if r["record_id"]] == [records[i]["record_id"] for i in (0, 2, 3, 4)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b" / "y.warc").write_bytes(b"")
    assert warc.read_archives(spark, str(tmp_path / "b")).filter("kind = 'response'").count() == 6


# -- 9


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, small, percent):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    for k in range(150):  # near copies around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((10_000 + k, " ".join(copy)))
    for k in range(60):  # a long common passage is no near copy
        rows.append((20_000 + k, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))])))
    rows += [(30_000 + i, t) for i, t in enumerate([None, "", "a b", "A b", "a b c d e", "A B C d e", "a b c d e f"])]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    want = brute.components(rows, percent)
    same([tuple(r) for r in got], [(i, n, c, c == i) for i, (n, c) in want.items()])


def test_near_duplicates_edges(edge, none):
    got = Counter(tuple(r) for r in minmax.near_duplicates(edge).collect())
    n = len(brute.shingles("same words in the same order here " * 30))
    assert got[(9, n, 8, False)] == 2 and got[(8, n, 8, True)] == 1 and got[(None, n, None, True)] == 1
    assert got[(1, 0, 1, True)] == 1 and sum(got.values()) == edge.count()
    assert minmax.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


# -- 10


def test_quality_rules(spark, small, edge):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    df = both(small, edge)
    got = quality.assess(df, labels).collect()
    same([tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got], [(i, *brute.quality(t)) for i, t in rows_of(df)])
    assert all(r["kept"] is False for r in got if r["base_failed"])
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"]) for r in got)


def test_quality_verdict(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    made = quality.assess(docs, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("score").alias("score")).collect()
    by = {r["quality"]: r for r in made}
    assert by[1]["kept"] > 0.99 and by[0]["kept"] < by[1]["kept"] and by[0]["score"] < by[1]["score"]


def test_quality_threshold_stands_on_several(spark):
    rng = random.Random(2)
    words = lambda mark, n=120: " ".join(f"{mark}{rng.randint(0, 400)}" for _ in range(n))
    rows = [(i, words("good")) for i in range(60)] + [(100 + i, words("junk")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(100, 1, 0)] + [(i, 0, 0) for i in range(101, 150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.assess(docs, labels).collect()}  # one junk text is trusted by mistake
    assert all(got[i] for i in range(60)) and sum(got[100 + i] for i in range(1, 300)) == 0


def test_quality_without_labels(edge, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] != r["base_failed"] for r in quality.assess(edge, labels).collect())
    assert quality.assess(none, labels).count() == 0


def test_frequent_pretokens_are_counted_on_every_text(spark):
    """More texts than any sample: words that stand in one text only, twice, are all found."""

    word = F.concat(F.lit("q"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("z"))
    docs = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, F.concat_ws("\n", word, word)).otherwise(F.lit("")).alias("text"))
    found = {w for w, _ in bpe.frequent(docs, queries.tokenizer_file())}
    assert {f"q{str(i).translate(str.maketrans('0123456789', 'abcdefghij'))}z".encode() for i in range(0, 200_000, 1000)} <= found
