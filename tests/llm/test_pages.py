"""Archives and page texts."""

import hashlib
import random

from quadrille.llm import html_text, warc

PAGE = "page_id long, url string, html string, size long"


def test_archives(spark, tmp_path):
    big = "x\r\n\r\ny WARC/1.1 é" * 100
    rows = [(1, "http://a/b", big), (2, "http://a/c", big), (2, "http://a/c", big), (3, None, None), (4, "u\r\nWARC-Type: metadata", "é"), (4, "u", "é"), (5, "http://a/b", big), (None, "n", "z")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], PAGE)
    path = warc.write(pages, str(tmp_path / "w"))
    t = warc.transactions(warc.read_records(spark, path)).collect()
    assert len(t) == len(rows) and all(x.request is not None and x.metadata is not None for x in t)
    full = [x for x in t if x.response.type == "response" and x.response["size"] >= 1000]
    assert len(full) == 1 and bytes(full[0].response.payload) == big.encode() and full[0].response.sha1 == hashlib.sha1(big.encode()).hexdigest()
    assert {x.response.refers_to for x in t if x.response.type == "revisit"} == {full[0].capture_id}
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(warc.query(spark, str(tmp_path)).collect(), key=str)
    digest = hashlib.sha1(big.encode()).hexdigest()
    want = [(i, len(big.encode()), digest, "revisit" if i != 5 else "response", 5 if i != 5 else None) for i in (1, 2, 2, 5)]
    want += [(i, len(x.encode()), hashlib.sha1(x.encode()).hexdigest(), "response", None) for i, x in ((3, ""), (4, "é"), (4, "é"), (None, "z"))]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(type(got[0])(*r)) if False else str(r)) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame([], PAGE).write.parquet(str(tmp_path / "none/pages.parquet"))
    assert warc.query(spark, str(tmp_path / "none")).count() == 0


def test_main_text(spark):
    tree = html_text.train()
    page = '''<html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies to make this better</div>
    <nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><main><article><h1>Title &eacute;</h1><p class="lead">Hello   <b>wor</b>ld &amp; all&nbsp;that<br>x<p>Second<aside>Related: foo</aside>
    <ul><li>One<li>Two <a href=#>link</a></ul><form>Name <input><button>Go</button></form><div class="ad">Buy!</div><!-- no --><section class="comments"><h2>Comments</h2><p>I like this very much indeed because it is nice.</p></section></article></main><footer>&copy; c</footer></body></html>'''
    assert html_text.main_text(page, tree) == "Title é\nHello world & all that x\nSecond\nOne\nTwo link"
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav><a>x</a></nav>", tree) == ""
    plain = "<body><ul><li><a>a</a></li><li><a>b</a></li><li><a>c d</a></li></ul><h1>A plain heading here now yes</h1>" + "<p>" + "long words of a text " * 12 + "</p><p>" + "and more of it goes on " * 10 + "</p>"
    assert html_text.main_text(plain, tree).count("long words") == 12
    x, y = html_text.labelled()
    assert (html_text.predict(tree, x) == y).mean() > 0.97
    pages = spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0)], PAGE)
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in html_text.extract(pages).collect())
    assert [g[0] for g in got] == [1, 1, 2] and all(a == b for _, a, b in got) and html_text.extract(pages.limit(0)).count() == 0


def test_layout_words_do_not_make_the_article_chrome():
    from quadrille.llm import html_text

    tree = html_text.train()
    body = "<p>" + "long running words of the story " * 12 + "</p><p>" + "and some more of it here " * 12 + "</p>"
    want = "\n".join([("long running words of the story " * 12).strip(), ("and some more of it here " * 12).strip()])
    menu, foot = "<nav><a href=x>Home</a></nav>", "<div class='comments'><article class='comment'><p>I do not agree with any of this at all</p></article></div><footer>Imprint</footer>"
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div class='post tag-news'>", "</div>"), ("<article class='review'>", "</article>"), ("<div class='widget'><article>", "</article></div>"), ("<div class='search'><main>", "</main></div>")):
        below = foot if "<article" in start else foot.replace("article", "div")
        assert html_text.main_text(f"<body>{menu}{start}{body}{end}{below}</body>", tree) == want, start
    # chrome by element or role stays, and so do plain words on what is no article
    for start, end in (("<aside><article>", "</article></aside>"), ("<div role='complementary'><article>", "</article></div>"), ("<div class='sidebar'>", "</div>")):
        assert html_text.main_text(f"<body>{start}{body}{end}</body>", tree) == "", start


def test_forms_go_but_not_the_page_inside_one():
    tree = html_text.train()
    body = "<h1>The title of it</h1><p>" + "words of the story itself " * 15 + "</p>"
    want = "The title of it\n" + ("words of the story itself " * 15).strip()
    ask = "<form><fieldset><p>" + "please tell us what you think of this page " * 10 + "</p><input></fieldset></form>"
    for page in (f"<form action=x><nav><a href=y>Home</a></nav><article>{body}</article></form>", f"<article>{body}{ask}</article>", f"<form><main>{body}</main>{ask}</form>", f"<main>{body}</main>{ask}", f"<body>{ask}{body}</body>"):
        assert html_text.main_text(f"<body>{page}</body>", tree) == want, page
    assert html_text.main_text(f"<body>{ask}</body>", tree) == ""


def test_generated_pages_give_their_articles_whole():
    tree, rng = html_text.train(), random.Random(5)
    say = lambda n: " ".join(rng.choice(("river", "stone", "of", "the", "winter", "light", "a&amp;b", "caf&eacute;")) for _ in range(n))
    plain = lambda t: t.replace("&amp;", "&").replace("&eacute;", "é")
    for _ in range(300):
        parts = [(rng.choice(("p", "h2", "li", "blockquote")), say(rng.choice((1, 2, 7, 30, 200)))) for _ in range(rng.randint(1, 9))]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
        noise = lambda: rng.choice((
            f"<nav><ul><li><a href=u>{say(2)}</a></ul></nav>", f"<aside><p>{say(60)}</p></aside>", f"<footer><p>{say(30)}</p></footer>", f"<div class='ad'><p>{say(25)}</p></div>", f"<form><p>{say(40)}</p></form>",
            f"<script>{say(9)}</script>", f"<style>{say(9)}</style>", f"<section class='comments'><p>{say(50)}</p></section>", f"<div id='cookie-notice'>{say(20)}</div>", f"<p>{say(80)}</p>"))
        page = f"<html><body>{noise()}{noise()}<article>{inner}</article>{noise()}{noise()}</body></html>"
        assert html_text.main_text(page, tree) == "\n".join(plain(x) for _, x in parts)


def test_the_tree_takes_the_best_split_of_all():
    x, y = html_text.labelled()

    def impurity(rows):
        p = sum(y[i] for i in rows) / len(rows) if rows else 0
        return 2 * p * (1 - p) * len(rows)

    def walk(node, rows, depth):
        if not isinstance(node, tuple):
            assert node == int(2 * sum(y[i] for i in rows) >= len(rows))
            return
        split = lambda f, t: ([i for i in rows if x[i, f] <= t], [i for i in rows if x[i, f] > t])
        left, right = split(node[0], node[1])
        mine = impurity(left) + impurity(right)
        for f in range(x.shape[1]):
            for t in {x[i, f] for i in rows}:
                a, b = split(f, t)
                assert not a or not b or mine <= impurity(a) + impurity(b) + 1e-9
        walk(node[2], left, depth + 1)
        walk(node[3], right, depth + 1)

    walk(html_text.train(), list(range(len(y))), 0)


def test_revisits_are_read_through_their_link(spark):
    rows = [("r", 7, "response", None, 1200, "aa"), ("v", 3, "revisit", "r", 0, "empty"), ("w", 4, "revisit", "gone", 0, "empty"), ("r", 7, "response", None, 1200, "aa")]
    t = spark.createDataFrame(rows, "capture_id string, page_id long, type string, refers_to string, size long, sha1 string")
    got = sorted(map(tuple, warc.resolve(t).collect()), key=str)
    assert got == sorted([(7, "response", 1200, "aa", None)] * 2 + [(3, "revisit", 1200, "aa", 7), (4, "revisit", None, None, None)], key=str)
