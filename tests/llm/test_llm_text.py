"""Operators 6, 7, 9, 10 and 1 against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nnprobe.llm.anchor_pii import find_spans, personal_data
from nnprobe.llm.line_first import clean_lines
from nnprobe.llm.positional_index import ascii_lower, build_index, contamination, item_windows, proximity_matches
from nnprobe.llm.quote_link import link_conversations
from nnprobe.llm.text_density import extract_pages, main_text
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20\-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def _digits(s):
    return sum(c in "0123456789" for c in s)


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= _digits(m[0]) <= 19 and _luhn(m[0])]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= _digits(m[0]) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0129()%é_4\n", max_size=60))
def test_base_spans_are_the_patterns(t):
    got = [s for s in find_spans(t) if s[0] in ("email", "ip", "card", "phone")]
    assert got == brute_spans(t)


def test_added_spans_and_long_runs():
    t = 'see https://u.example.org/a?b=1, token = "bc0d31ba76f1" by @some_one or a@b.co'
    kinds = {k: t[s:e] for k, s, e in find_spans(t)}
    assert kinds == {"url": "https://u.example.org/a?b=1", "account": "bc0d31ba76f1", "handle": "@some_one", "email": "a@b.co"}
    assert find_spans("1" * 300_000 + "." + "@" * 1000 + "a" * 300_000) == []
    assert find_spans(None) == find_spans("") == []
    assert find_spans("0" * 5000 + ".1.1.1")[0][0] == "ip"


def test_long_account_values_are_whole():
    value = "eyJ0" + "aB3_-xYz." * 600 + "Q9"
    t = f"token: {value} end"
    assert find_spans(t) == [("account", 7, 7 + len(value))]
    assert find_spans("token:" + "token-" * 100_000) == []


@pytest.mark.parametrize("t", [
    "API key: sk1234567", "apiKey=sk1234567", "ApiKey sk1234567", "API_key is sk1234567", "pAsSwOrD: sk1234567",
    "Social Security number: sk1234567", "É SSN No. sk1234567", "Passport NUMBER sk1234567"])
def test_cues_in_any_case(t):
    assert [(k, t[s:e]) for k, s, e in find_spans(t)] == [("account", "sk1234567")]


def test_schemes_in_any_case_and_offsets():
    t = "İÉ HtTpS://a.b/C token ISABCDE123"
    assert [(k, t[s:e]) for k, s, e in find_spans(t)] == [("account", "ISABCDE123"), ("url", "HtTpS://a.b/C")]


def test_personal_data_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x@y.zz 1.2.3.4", 0), (3, "x@y.zz 1.2.3.4", 0), (None, "é a@b.c", 0)],
                               "doc_id long, text string, spans int")
    got = sorted((tuple(r) for r in personal_data(df).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    two = hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[0] == (1, 0, 0, 0, 0, none, "", 0) and got[1] == (2, 0, 0, 0, 0, none, "", 0)
    assert got[2] == got[3] == (3, 1, 1, 0, 0, two, "email:0:6,ip:7:14", 0)
    assert got[4][6] == "email:2:7"
    assert personal_data(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<nav><a href="/">Home</a></nav><div id="cookie-notice"><p>We use cookies on this long notice, as everyone does.</p></div>
<div class="content"><article><header>Site head</header><h1>Title &amp; more</h1><p>First  paragraph
with <b>bold</b>&nbsp;text.<p>Second one, <a href="x">linked</a>.<br>After a break.<ul><li>one<li>two</ul>
<script>var a = "</p>";</script><form>Name <input></form></article></div>
<div class="sidebar"><a href="a">Other</a> <a href="b">More</a></div><section id="comments"><p>First!</p></section>
<aside>beside</aside><footer>&copy; end</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == ("Title & more\nFirst paragraph with bold text.\nSecond one, linked. After a break.\none\ntwo")


def test_two_sections_beside_each_other():
    body = "".join(f"<div><p>{'words of a text ' * 8}{i}</p><p>{'more of the text ' * 8}{i}</p></div>" for i in range(3))
    got = main_text(f"<body><div class=menu><a href=a>x</a></div><main>{body}</main></body>").split("\n")
    assert len(got) == 6


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("only text", "only text"), ("<p>a", "a"), ("<script>x", ""), ("<![foo[ x ]]><p>y</p>", "y"),
    ("</div></p><b>t</b>", "t"), ("<p>&eacute;&#8364;&bogus;</p>", "é€&bogus;"), ("<div hidden>x</div><p>y</p>", "y")])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_deep_page_and_rows(spark):
    assert main_text("<div>" * 30_000 + "deep" + "</p>" * 30_000) == "deep"
    df = spark.createDataFrame([(1, "u", None, "t"), (2, "v", PAGE, "t"), (2, "v", PAGE, "t")],
                               "page_id long, url string, html string, text string")
    got = extract_pages(df).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0)] + [(2, len(main_text(PAGE)))] * 2
    assert extract_pages(df.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(docs, items):
    tok = lambda t: WORD.findall((t or "").translate(LOW))
    out = []
    for doc_id, text in docs:
        w, hit, found = tok(text), set(), set()
        for item_id, item in items:
            v = tok(item)
            n = min(len(v), 10)
            for win in {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s:s + n]) == win:
                        hit.update(range(s, s + n))
                        found.add(str(item_id))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), names, bool(hit)))
    return out


def test_contamination_equals_brute_force(spark):
    import random
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(["Le", "la", "été", "x1", "of", "THE", "a-b", "ÉTÉ", "q"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 5, 10, 14, 30]))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "the the the")]
    docs = [(i, some(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, f"{some(5)}, {t}; {some(3)}") for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "..")]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, n long, words string")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, words string")
    want = sorted(brute_hits(docs, items))
    assert sorted(tuple(r) for r in contamination(d, b).collect()) == want
    assert sorted(tuple(r) for r in contamination(d, b, block_bytes=64).collect()) == want     # several blocks
    assert contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in contamination(d, b.limit(0)).collect())


def test_contamination_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "w1 w2")], "doc_id long, text string")
    b = spark.createDataFrame([(1, long), (1, long), (2, long)], "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in contamination(d, b).collect()), key=str)
    assert got == [(1, 30, 30, 2), (1, 30, 30, 2), (2, 2, 0, 0), (None, 30, 0, 0)]


def test_proximity(spark):
    text = "alpha b1 b2 b3 omega c1 c2 c3 c4 c5"
    near = "alpha b1 b2 b3 x y omega"
    d = spark.createDataFrame([(1, near), (2, "omega " + "z " * 40 + "alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "alpha omega")], "item_id long, text string")
    win = item_windows(b)
    anchors, postings = build_index(d, win)
    assert [(r.doc_id, r.shift) for r in proximity_matches(anchors, postings, slop=5).collect()] == [(1, 5)]
    assert proximity_matches(anchors, postings, slop=4).count() == 0
    assert text


def test_ascii_lower(spark):
    got = spark.createDataFrame([("ABCÉ",), ("XYZ",), ("ΑΣ İ A",)], "t string").select(ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abcÉ", "xyz", "ΑΣ İ a"]


def brute_base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    rep = set()
    for i, x in enumerate(wins):
        if wins.count(x) > 1:
            rep.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed)


def test_line_first_base(spark):
    eight = "a b c d e f g h"
    texts = [None, "", " \n\t ", eight, f"{eight} {eight}", f"{eight} x {eight}\n{eight}", "a " * 30, "é #$ <x>\né #$ <x>\r\n\n",
             " ".join(f"w{i}" for i in range(50)) + ".", "w" * 100_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.doc_id: (r._lf_n, r._lf_chars, r._lf_symbols, r._lf_dups, r._lf_repeat, r._lf_base_failed)
           for r in clean_lines(df).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    assert clean_lines(df.limit(0)).count() == 0


def test_line_first_verdict(spark):
    prose = "\n".join(f"Line {i} has w{i} and x{i} in it." for i in range(6))
    nav = "\n".join(["Home", "Login", "a | b | c | d | e", "© 2020 All rights reserved.", "SOME LOUD CAPITALS IN A LINE!"])
    junk = "\n".join(f"### word{i} ### %%% other{i} &&&" for i in range(9))
    df = spark.createDataFrame([(1, prose), (2, f"{prose}\n{nav}"), (3, f"{junk}\nOne good sentence."), (4, prose + "\n" + prose)],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in clean_lines(df).collect()}
    assert got[1]._lf_kept and got[1]._lf_lost == 0 and got[1]._lf_text == prose
    assert got[2]._lf_kept and got[2]._lf_text == prose
    assert not got[3]._lf_kept and got[3]._lf_text == "One good sentence."
    assert not got[4]._lf_kept and got[4]._lf_base_failed
    assert clean_lines(df).where("_lf_kept").count() == 2       # a filter changes no value


MSGS = "conv_id long, turn long, role string, text string, level int"


def test_quotes_link_and_order(spark):
    a = "Hello all,\nwhat is the plan for Monday?"
    data = [
        (1, 0, "u", a), (1, 1, "v", "> what is the  PLAN for Monday?\nWe start at nine."), (1, 2, "w", "Unrelated thread."),
        (1, 3, "u", "On Tue, V wrote:\n> > what is the plan for Monday?\n> We start at nine.\n\nThanks!"),
        (1, 4, "x", "> Unrelated\n> thread.\nIndeed."), (1, 5, "y", "> never said\nHm."),
        (2, 0, "u", "> We start at nine.\nNo such message here."), (2, 1, "v", None), (None, 0, "n", a), (3, None, "n", a)]
    df = spark.createDataFrame([(*x, 9) for x in data], MSGS)
    got = {(r.conv_id, r.turn): r for r in link_conversations(df).collect()}
    assert len(got) == len(data)
    parent = {k: r.parent_turn for k, r in got.items() if r.parent_turn is not None}
    assert parent == {(1, 1): 0, (1, 3): 1, (1, 4): 2}
    assert [t for _, t in sorted((r.position, r.turn) for k, r in got.items() if k[0] == 1)] == [0, 1, 3, 2, 4, 5]
    assert (got[1, 3].root_turn, got[1, 3].depth, got[1, 3].max_level) == (0, 2, 2)
    assert got[1, 3].text == "Thanks!" and got[1, 1].text == "We start at nine." and got[1, 4].text == "Indeed."
    assert got[2, 1].text == "" and got[1, 0].text == a
    assert link_conversations(df.limit(0)).count() == 0


def test_quote_chain_and_repeats(spark):
    data = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    data += [(2, 0, "u", "same"), (2, 0, "u", "same"), (2, 1, "v", "> same\n> same\nsame")]
    got = link_conversations(spark.createDataFrame([(*x, 9) for x in data], MSGS)).collect()
    one = sorted((r.position, r.turn, r.root_turn, r.depth) for r in got if r.conv_id == 1)
    assert one == [(i, i, 0, i) for i in range(40)]
    two = sorted((r.position, r.turn, r.parent_turn) for r in got if r.conv_id == 2)
    assert [x[:2] for x in two] == [(0, 0), (1, 0), (2, 1)] and two[2][2] == 0


ARTICLE = "<p>" + "This is a sentence of the article, long enough to be one. " * 5 + "</p>"
PLAIN = " ".join(ARTICLE[3:-4].split())


@pytest.mark.parametrize("layout", [
    '<div id=page class="sidebar-right"><article>{}</article></div>', '<div class="page menu-left"><main>{}</main></div>',
    '<div class="elementor-widget">{}</div>', '<div class="main search-enabled">{}</div>', "<form action=/x>{}</form>",
    "<header>{}</header>", '<article><div class="related-work">{}</div></article>',
    '<article><section class="social-science">{}</section></article>', '<article><div class="share-price">{}</div></article>',
    '<article><div class="research-search">{}</div></article>', "<header><h1>Site</h1></header><article>{}</article>",
    '<article>{}<section class="comments"><article class="comment">I like it.</article></section></article>',
    '<article>{}</article><div class="post-comments">' + "<p>what a reader has to say</p>" * 60 + "</div>",
    '<article>{}<div class="related-posts"><a href=1>one</a> <a href=2>two</a></div></article>',
    '<article>{}<div class="ad">Buy this now, it is cheap.</div><div class="social-share">Tell others</div></article>',
])
def test_layouts_keep_the_article_alone(layout):
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{}<footer>2020</footer></body></html>"
    assert main_text(page.format(layout.format(ARTICLE))) == PLAIN


@pytest.mark.parametrize("html", [
    "<a b=" * 200_000, "<!-- " * 200_000, "<" * 300_000, "<li><ul>" + "<span>" * 15_000 + "<li>" * 15_000, "<p>" * 50_000,
    "<div>" * 50_000, "<table>" + "<td>" * 50_000, "</x" * 100_000, "<script>" * 100_000, "<a b=\'" * 100_000, "&amp" * 100_000,
    "<a " + "/" * 300_000, "<a " + "=" * 300_000, "<a" + " " * 300_000, ("<a x" + " " * 50) * 20_000, "<!" * 300_000, "<a b=\"x",
])
def test_pages_that_never_close_take_linear_time(html):
    import time
    start = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - start < 20


def test_tags_are_read_as_browsers_do():
    body = "<body><p>" + "plain words of the text here " * 8
    for mark, want in (("<!-->a", "a"), ("<!-- x -->a", "a"), ("<!-- x --!>a", "a"), ("<?php x?>a", "a"), ("</ x>a", "a"),
                       ("a < b", "a < b"), ("<b title=\'>\'>a</b>", "a"), ('<b title=">" x=1/>a', "a"), ("<B CLASS=x>a</B >", "a"),
                       ("<script>if (a</p> b)</script>a", "a"), ("<style>p{}</STYLE >a", "a"), ("&lt;i&gt; &eacute;&#33;", "<i> é!"),
                       ("<b hidden>x</b>a", "a"), ("a<!-- no end", "a"), ("a<b no end", "a")):
        assert main_text(body + mark).split("here")[-1].strip() == want, mark


def plain_density(page):
    """The method on nested tuples (tag, [children or texts]), by recursion and without any sharing of sums."""
    import math

    def chars(x, in_link=False):
        if isinstance(x, str):
            return len(x), len(x) if in_link else 0
        got = [chars(c, in_link or x[0] == "a") for c in x[1]]
        return sum(g[0] for g in got), sum(g[1] for g in got)

    def tags(x, name=None):
        return 0 if isinstance(x, str) else sum((not isinstance(c, str) and name in (None, c[0])) + tags(c, name) for c in x[1])

    body_chars, body_linked = chars(page)

    def density(x):
        c, lc = chars(x)
        if not c:
            return 0.0
        t, lt = max(tags(x), 1), max(tags(x, "a"), 1)
        inner = c / max(c - lc, 1) * max(lc, 1) + body_linked / max(body_chars, 1) * c + math.e
        return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(math.log(inner))

    def total(x):
        return sum(density(c) for c in x[1] if not isinstance(c, str))

    def nodes(x, path):
        yield x, path
        for c in x[1]:
            if not isinstance(c, str):
                yield from nodes(c, [*path, x])

    best, path = max(nodes(page, []), key=lambda n: total(n[0]))
    return best, min(density(x) for x in [*path, best]), density, chars, path


def test_density_equals_the_plain_method():
    """Pages of div, p and a: the best subtree, and beside its path what reaches the threshold or is a paragraph with few links."""
    rnd = random.Random(8)

    def made(depth):
        if depth == 0 or rnd.random() < 0.25:
            text = " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(3, 40)))
            return ("p", [text] if rnd.random() < 0.6 else [("a", [text])])
        return ("div", [made(depth - 1) for _ in range(rnd.randint(1, 5))])

    def html(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(html, x[1])) + f"</{x[0]}>"

    def lines(x):
        if x[0] == "p":
            return [re.sub("<[^>]*>", "", html(x))]
        return [y for c in x[1] for y in lines(c)]

    for _ in range(150):
        page = ("body", [made(3) for _ in range(rnd.randint(1, 4))])
        best, least, density, chars, path = plain_density(page)

        def text(x):
            if x is best:
                return lines(x)
            out = []
            for c in x[1]:
                if any(c is p for p in (*path, best)):
                    out += text(c)
                else:
                    n, linked = chars(c)
                    if density(c) >= least > 0 or c[0] == "p" and linked <= n / 3:
                        out += lines(c)
            return out

        assert main_text(html(page)) == "\n".join(text(page))


@pytest.mark.parametrize("text, value", [
    ("IBAN: GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268 19"),
    ("iban DE89 3704 0044 0532 0130 00 and more words", "DE89 3704 0044 0532 0130 00"),
    ("my iban is DE89370400440532013000.", "DE89370400440532013000"),
    ("iban DE88370400440532013000", "DE88370400440532013000"),            # a wrong check number: the general rule
    ("account number 1234 5678 9012", "1234 5678 9012"), ("Account no: 12-345678", "12-345678"),
    ("passport C01X00T47", "C01X00T47"), ("password: hunter", "hunter"), ("token: abcdefghijkl", "abcdefghijkl"),
    ("secret=s3cr3t!word", "s3cr3t"), ("api_key = 'Zz-9_x.Yw'", "Zz-9_x.Yw"), ("SSN 123-45-6789", "123-45-6789"), ("ssn: 123456789", "123456789"),
    ("ssn 000-45-6789", None), ("ssn 123-00-6789", None), ("token 2024-05-01", None), ("token: 01.05.2024", None),
    ("password hunter", None), ("the token of esteem", None), ("secret: ab", None), ("iban", None), ("token:", None),
])
def test_account_values(text, value):
    got = [text[s:e] for k, s, e in find_spans(text) if k == "account"]
    assert got == ([value] if value else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789", "GB29 NWBK 6016 1331 9268 19", "iban ", "IBAN: ", "ssn ", "token: ", "password=", "secret ",
                                 "account number ", " ", "-", ".", "abcdef", "A1", "123-45-6789", "2024-05-01", "\n", "é"]), max_size=14).map("".join))
def test_added_spans_hold_what_they_must(text):
    """Every account span stands behind a cue on its line, holds a value of its kind, and none overlaps another."""
    spans = sorted((s, e) for k, s, e in find_spans(text) if k == "account")
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    for s, e in spans:
        before = text[max(0, s - 40):s].lower()
        assert re.search("(iban|ssn|token|password|secret|account number)[ \\t]*(is|no|number)?[ \\t]*[:=#]?[ \\t]*$", before)
        assert len(text[s:e]) >= 6 and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text[s:e])


def test_lines_of_other_scripts_and_languages(spark):
    hindi = "\n".join(f"यह एक लंबा वाक्य है जो क्रमांक {i} का है और यहाँ समाप्त होता है।" for i in range(6))
    arabic = "\n".join(f"هذه جملة طويلة رقم {i} وهي تنتهي هنا مع علامة استفهام؟" for i in range(6))
    prose = "This is a sentence of the text that says something new each time, number {}."
    notices = ["Alle Rechte vorbehalten.", "Tous droits réservés.", "TODOS LOS DERECHOS RESERVADOS.", "All rights reserved.",
               "Diese Seite verwendet Cookies.", "Lea nuestra política de privacidad.", "This site uses cookies. Accept all cookies. " * 9 + "."]
    long_line = " ".join(prose.format(i) for i in range(12)) + " Its last one speaks of a privacy policy."
    rows = [(0, hindi), (1, arabic)] + [(10 + i, "\n".join([*map(prose.format, range(8)), n])) for i, n in enumerate(notices)] + [(30, long_line)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]._lf_lost == 0 for i in (0, 1, 30))
    for i, n in enumerate(notices):
        assert n not in got[10 + i]._lf_text and prose.format(7) in got[10 + i]._lf_text, n


LINE_PIECES = ["Plain words stand here. ", "ACCEPT ALL COOKIES", "Politique de ConfidentialitÉ", "privacy polic", "terms of use ",
               "Conditions d’utilisation", "VERBOTEN UND VORBEHALTEN", "Ä", "É", "K", "|", "»", "#", ".", "。", "\"", "”)", "*" * 45,
               " " * 41, "\r", "\u0085", " ", "word", "CAPITALS", "x" * 200, "İ"]


def test_line_rules_equal_the_plain_rules(spark):
    """What is looked at first (line end, signs of a phrase, capitals) changes no verdict."""
    from nnprobe.llm import line_first as L
    from random import Random
    rnd = Random(10)
    seen = ["".join(rnd.choices(LINE_PIECES, k=rnd.randint(1, 7))) for _ in range(3000)]
    phrases = ["all rights reserved", "privacy policy", "cookie policy", "accept all cookies", "accept cookies", "uses cookies",
               "terms of use", "terms of service", "enable javascript", "subscribe to our", "newsletter", "copyright ©", "lorem ipsum",
               "licensed under", "released under the", "is free software", "permission is hereby granted", "alle rechte vorbehalten",
               "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "nutzungsbedingungen", "tous droits réservés",
               "politique de confidentialité", "utilise des cookies", "accepter les cookies", "conditions d'utilisation",
               "mentions légales", "todos los derechos reservados", "política de privacidad", "utiliza cookies", "aceptar las cookies",
               "aceptar cookies", "condiciones de uso", "aviso legal"]
    df = spark.createDataFrame([(x,) for x in {*seen, *phrases, *(p.upper() for p in phrases)}], "line string")
    letters = F.regexp_replace("line", "\\P{L}+", "")
    capitals = F.length(F.regexp_replace(letters, "\\P{Lu}+", ""))
    upper = (F.length(letters) >= 20) & (capitals * 10 > F.length(letters) * 7)
    line = F.col("line")
    got = df.select("line", L._ends(line) == line.rlike(L.LINE_END), ~line.rlike(L.BOILERPLATE) | L._has_sign(line),
                    ~upper | L.line_fails(line)).collect()
    assert all(r[1] and r[2] and r[3] for r in got), [r for r in got if not all(r[1:])]
    assert df.where(line.rlike(L.BOILERPLATE)).count() >= 2 * len(phrases)


def test_line_rules_cost_less_than_the_phrases_alone(spark):
    from time import perf_counter

    from nnprobe.llm import line_first as L
    prose = "The river rises in the hills and runs past several small towns before it comes to the sea, where ships lie. " * 4
    df = spark.range(0, 20_000, 1, 4).select(F.concat(F.lit(prose), F.col("id").cast("string"), F.lit(".")).alias("line")).cache()
    df.count()

    def took(rule):
        times = []
        for _ in range(3):
            began = perf_counter()
            df.where(rule).write.format("noop").mode("overwrite").save()
            times.append(perf_counter() - began)
        return min(times)

    assert took(L.line_fails(F.col("line"))) < took(F.col("line").rlike(L.BOILERPLATE))
