import itertools
import random
import time

from folioforge.llm.html_extract import NOT_CONTENT, Parser, _edges, extract_main_text, label, log_odds, main_text, min_cut

LONG = "This paragraph has a fair number of words, and it says one thing after another until it ends."
BODY = "\n\n".join(["A title", LONG, "Short one.", LONG + " Again & again."])
INNER = f"<p>{LONG}<p>Short <b>one</b>.</p>\n<p>{LONG[:20]}\n  {LONG[20:].strip()} Again &amp; again."


def clean(x):
    return x.replace("  ", " ")


def test_templates():
    nav = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a></ul></nav><header><a href=/>Site</a></header>"
    foot = "<footer>&copy; 2020 Site. All rights are reserved by somebody, somewhere, and for ever.</footer>"
    side = f"<aside><h2>Related</h2><p>{LONG}</p></aside><div class='sidebar'><p>{LONG}</p></div>"
    form = "<form><label>Your mail</label><input><p>Subscribe to all our letters now.</p></form>"
    comments = f"<section class='comments'><h3>Comments</h3><p>{LONG}</p></section><div id='disqus_thread'><p>{LONG}</p></div>"
    notice = "<div class='cookie-notice'><p>We use cookies, as everybody does, to see what you do here.</p></div>"
    ad = "<div class='ad'>Buy this wonderful thing, it is cheap and it is good for you.</div>"
    script = "<script>var x='<p>no</p>';</script><style>p{}</style><noscript>Enable it</noscript><!-- <p>no</p> -->"
    want = clean(BODY)
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("<div>", "</div>")):
        page = f"<!DOCTYPE html><html><head><title>t</title>{script}</head><body>{notice}{nav}{ad}{open_}<h1>A title</h1>{INNER}{close}{side}{form}{comments}{foot}"
        assert main_text(page) == want, open_
        assert main_text(page + "</body></html>") == want
    inside = f"<body>{nav}<article><header><h1>A title</h1></header>{ad}{INNER}{comments}{form}</article>{foot}"
    assert main_text(inside) == want


def test_forms_and_class_words_around_the_article():
    nav = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a></ul></nav><header><a href=/>Site</a></header>"
    foot = "<footer>&copy; 2020 Site. All rights are reserved by somebody, somewhere, and for ever.</footer>"
    side = f"<aside><h2>Related</h2><p>{LONG}</p></aside><div class='sidebar'><p>{LONG}</p></div>"
    form = "<form><label>Your mail</label><input><p>Subscribe to all our letters now.</p></form>"
    comments = f"<section class='comments'><h3>Comments</h3><p>{LONG}</p></section>"
    notice = "<div class='cookie-notice'><p>We use cookies, as everybody does, to see what you do here.</p></div>"
    want = clean(BODY)
    wrappers = [("<form method=post action=x><input type=hidden name=__VIEWSTATE value=x>", "</form>"), *((f"<div class={w}>", "</div>") for w in sorted(NOT_CONTENT))]
    for before, after in wrappers:
        for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("<div>", "</div>")):
            text = f"<h1>A title</h1>{INNER}"
            around = f"<html><body>{notice}{nav}{before}{open_}{text}{close}{after}{side}{form}{comments}{foot}"
            within = f"<html><body>{notice}{nav}{open_}{before}{text}{after}{close}{side}{form}{comments}{foot}"
            assert main_text(around) == want, (before, open_)
            assert main_text(within) == want, (before, open_)
            if before.startswith("<form") or before == "<div class=legal>":
                assert main_text(f"<html><body>{before}{notice}{nav}{open_}{text}{close}{side}{form}{comments}{foot}{after}") == want, (before, open_)
    # a form of controls stays one, comments stay comments beside the shortest article
    assert main_text(f"<form><p>{LONG}</p><label>A</label><input><label>B</label><input></form><p>{LONG} And so on.</p>") == f"{LONG} And so on."
    assert main_text(f"<p>{LONG}</p><div class=comments>{'<p>' + LONG * 9}</div>") == LONG


def test_a_page_of_a_short_plain_list():
    assert main_text("<ul><li>Milk<li>Eggs<li>Bread</ul>") == "Milk\n\nEggs\n\nBread"
    assert main_text("<nav><ul><li><a href=/a>Home</a></ul></nav><div class=ad>Buy it</div>") == ""


def test_nested_wrappers_are_linear():
    began = time.time()
    assert main_text("<div class=widget>" * 3000 + f"<p>{LONG}</p>" + "<form>" * 3000 + f"<p>{LONG * 3}</p>") != ""
    assert time.time() - began < 10


def test_cases():
    assert main_text(None) == main_text("") == main_text("<p> \n</p>") == ""
    assert main_text("<article><p>caf&eacute; &#x1F642; &lt;b&gt;</p></article>") == "café 🙂 <b>"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")) == 3000 * len(LONG) + 2 * 2999


def test_wrappers_of_the_article():
    for wrapper in ("<div class='layout has-sidebar'>", "<div class=noSidebar>", "<div class='grid sidebar-right'>", "<div id=page class=social>", "<div class=widget><div class='banner top'>"):
        for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div role=main>", "</div>")):
            side = f"<div class=sidebar><p>{LONG}</p></div><section class=comments><article><p>{LONG}</p></article></section><div class=ad>{LONG}</div>"
            page = f"<html><head><title>t</title></head><body>{wrapper}{open_}<h1>A title</h1>{INNER}<div class=ad>{LONG}</div>{close}{side}</div></div></body></html>"
            assert main_text(page) == clean(BODY), (wrapper, open_)
    # articles beside the text stay what they are
    side = f"<div class=sidebar><article><p>{LONG}</p></article></div><div class=comments><article><p>{LONG}</p></article></div>"
    assert main_text(f"<body><div><h1>A title</h1>{INNER}</div>{side}") == clean(BODY)


def test_head_without_end():
    head = "<meta charset=utf-8><title>t</title><link rel=x><style>p{}</style><script>var x;</script>\n"
    for html in ("<html><head>", "<head>", "<!DOCTYPE html><html lang=en><head id=h>"):
        for body in ("<body>", "", "<body class=x>"):
            assert main_text(f"{html}{head}{body}<article><h1>A title</h1>{INNER}</article>") == clean(BODY), (html, body)
    assert main_text(f"<html><head>{head}{LONG}") == LONG
    assert main_text(f"<head>{head}<noscript><img src=x></noscript></head><body><p>{LONG}</p>") == LONG


def test_min_cut_is_minimal():
    r = random.Random(8)
    for _ in range(60):
        n = r.randrange(1, 8)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(keep):
            return sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(min_cut(gain, edges)) - best) < 1e-6


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in extract_main_text(df).collect()), key=repr)
    assert got == [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_markup_never_leaks_or_raises():
    text = "hello there my dear friend, this is a sentence of some length."
    for junk in ("<![foo[x]]>", "<![if !IE]>", "<![endif]-->", "<![CDATA[x]]>", "<!x y>", "<?php echo 1 ?>", "<!-->", "<!--->", "<!-- <p>x</p> -->", "</>", "</ x>", "<!>"):
        assert main_text(f"<p>{text}{junk}</p><p>{text}</p>") == f"{text}\n\n{text}", junk
    for rest in ("<!-- open <p>x</p>", "<!", "<?", "<!x", "<a href='x", '<a href="x>y', "<a", "<a href", "<a href=", "<a href= ", "</a", "<title>x", "<script>x"):
        assert main_text(f"<p>{text}{rest}") == text, rest
    assert main_text(f"<p>{text} 1 < 2 <") == f"{text} 1 < 2 <"
    assert main_text("<p>&#xD800;&#x110000;&#0; is what they made of it, and so it went on.</p>").encode()
    sums = "<article><p>The sum <math><mi>x</mi><annotation>TeX</annotation></math> is what we want to have.</p><button>Copy</button><h2><button>Heading of it</button></h2></article>"
    assert main_text(sums) == "The sum x is what we want to have.\n\nHeading of it"


def test_mutated_pages():
    r = random.Random(3)
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body class='a b'><nav><a href=/x>x</a></nav><article><h1>A title</h1>{INNER}<table><tr><td>1<td>2</table></article><!-- c --></body></html>".encode()
    junk = [b"<![", b"<!", b"<?", b"<!--", b"-->", b"<", b">", b'"', b"'", b"=", b"&", b"</", b"\0", b"<math>", b"&#xD800;", b"<table>", b"</p>"]
    for _ in range(3000):
        h = bytearray(page)
        for _ in range(r.randrange(1, 10)):
            i = r.randrange(len(h) + 1)
            h[i : i + r.choice([0, 0, 1, 9])] = r.choice(junk) if r.random() < 0.6 else bytes([r.randrange(256)])
        assert main_text(h.decode("utf-8", "replace")).encode() is not None


def test_depth_costs_no_more_than_length():
    for part in ("<div>", "<span>", "<b>x</i>", "<fieldset>", "<!--", "</", "<a x='", "<ul><li>"):
        n = 100_000
        began = time.time()
        main_text(part * n)
        assert time.time() - began < 10, part
    deep = "".join(f"<div>{x}" for x in ["word"] * 20_000) + "</div>and" * 20_000
    assert len(label(deep)) == 40_000


def test_labels_of_whole_pages_are_the_best_of_all():
    r = random.Random(5)
    texts = ["A title", LONG, "Short one.", "Home", "<a href=x>a link to somewhere</a>", "© 2020 somebody", LONG[:40]]
    tags = ["p", "div", "h2", "li", "td", "aside", "nav", "article", "section class=comments", "div class=ad", "main", "form"]
    for _ in range(80):
        html, open_ = "", []
        for _ in range(r.randrange(1, 12)):
            if open_ and r.random() < 0.4:
                html += f"</{open_.pop().split()[0]}>"
            open_.append(r.choice(tags))
            html += f"<{open_[-1]}>{r.choice(texts)}"
        p = Parser(html)
        gain, edges = [log_odds(b) for b in p.blocks], list(_edges(p))
        assert len(gain) <= 15

        def cost(keep):
            return sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        best = min(map(cost, itertools.product([False, True], repeat=len(gain))))
        assert abs(cost([k for _, k in label(html)]) - best) < 1e-6
        # distances in the tree, by whole paths
        path = lambda x: [x, *path(p.parent[x])] if x else [0]
        for i in range(1, len(gain)):
            a, b = set(path(p.blocks[i - 1].node)), set(path(p.blocks[i].node))
            assert (i - 1, i, 1.6 / max(1, len(a ^ b) - 1)) in edges
