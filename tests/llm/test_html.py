import html
import os
import random
import re
import time
import tracemalloc

import pytest

from millrace.llm import html_text as H
from millrace.llm import queries


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b &lt;c&gt;", "a\nb <c>"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T&eacute;</h1><p>one <b>two</b>\n three<br>four</p></article><footer>foot</footer>", "Té\none two three four"),
        ("<article><header>h</header><p>x</p><script>var t='</p><p>no'</script><style>p{}</style><form>f<input></form><p>y</p></article>", "x\ny"),
        ("<div id=main><p>long enough text here</p></div><div class='side sidebar-2'><p>links and a far longer text than the main one has</p></div>", "long enough text here"),
        ("<article><p>x</p><div class=ad>buy</div><div class='comments'><p>me too</p></div><aside>z</aside><p>y</p><div role=navigation>n</div></article>", "x\ny"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
        ("<article><p>cut off he<b", "cut off he"),
        ("<article><!-- no --><p>a < b and a&nbsp;&#39;c&#x27;</p><p hidden>h</p><p style='display: none'>s</p></article>", "a < b and a 'c'"),
        ("<body class=no-sidebar><div class='has-sidebar'><form><p>x</p></form><nav>n</nav></div></body>", "x"),
        ("<ARTICLE><P TITLE='a>b'>x</P></ARTICLE>", "x"),
    ],
)
def test_pages(page, text):
    assert H.read(page).main_text(None) == text


def test_the_host_decides(spark):
    usual = "<body><div class='c{}'><p>words of the main part go here</p></div><div class=extra><p><a href=x>{}</a></p></div></body>"
    rows = [(i, f"http://A.example.org/{i}", usual.format(i, "x"), "h", 1) for i in range(5)]
    rows += [(9, "https://a.example.org/9", usual.format(9, "here the other part is the longer one by a good deal"), "h", 1)]
    rows += [(10, "http://b.example.org/", "<article><p>other</p></article>", "h", 1), (11, "http://a.example.org/11", "<section><p>fallback</p></section>", "h", 1)]
    rows += [(12, None, None, None, None), (13, "none", "", "h", 1), (None, None, "<p>x</p>", "h", 1), (10, "http://b.example.org/", "<article><p>other</p></article>", "h", 1), (14, "http://c.example.org", "<article>" + "<p>para graph</p>" * 5000 + "</article>", "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path int")
    found = H.main_texts(pages).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[9] == texts[0] == "words of the main part go here"
    assert (texts[10], texts[11], texts[12], texts[13], texts[None]) == ("other", "fallback", "", "", "x")
    assert texts[14].count("\n") == 4999 and all(r.n_chars == len(r.text) for r in found)
    assert H.main_texts(pages.limit(0)).count() == 0


def _words(rng, n):
    return " ".join(rng.choice("stone river light morning garden window paper summer market letter".split()) for _ in range(n)) + "."


def test_what_stands_beside_the_container_stays():
    rng = random.Random(3)
    title, body = "The title", _words(rng, 95)
    page = f"<html><body><div class=head><h1>{title}</h1></div><div class=content><p>{body}</p></div></body></html>"
    assert H.read(page).main_text() == f"{title}\n{body}"
    one, two = _words(rng, 40), _words(rng, 60)
    halves = H.read(f'<html><body><div class="a"><p>{one}</p></div><div class="b"><p>{two}</p></div></body></html>')
    usual = H.read(f'<html><body><div class="a"><p>{two}</p></div></body></html>')
    assert halves.main_text(usual.vote()) == f"{one}\n{two}"


@pytest.mark.parametrize("kind", ["menu-of-the-day", "related-work", "comments-on-the-law", "banner-history", "share-prices", "ad-hoc"])
def test_a_strong_word_among_others_needs_links_inside_an_article(kind):
    rng = random.Random(4)
    body, own = _words(rng, 100), _words(rng, 25)
    page = "<html><body><article><p>{}</p><div class='{}'><p>{}</p></div></article></body></html>"
    assert H.read(page.format(body, kind, own)).main_text() == f"{body}\n{own}"
    assert H.read(page.format(body, kind, f"<a href=x>{own}</a> and")).main_text() == body
    for alone in ("related-posts", "comment-list", "ad", "share-buttons", "sidebar-2"):
        assert H.read(page.format(body, alone, own)).main_text() == body


def test_hosts_of_several_templates_by_brute_force(spark):
    """Pages without an article: each template lays out a title, parts of the text, and what is to go, marked or only by its links."""
    rng, rows, want = random.Random(11), [], {}
    frames = ["<body><div class=head{i}><h1>{t}</h1></div><div class=content><p>{a}</p>{x}<p>{b}</p></div>{m}</body>", "<body>{m}<section class='s{i}'><h2>{t}</h2><p>{a}</p></section>{x}<section class='s{i}'><p>{b}</p></section></body>", "<body><table><tr><td class=text>{t}<p>{a}<p>{b}</td></tr></table>{m}{x}</body>"]
    junk = ["<nav><a href=x>{}</a></nav>", "<footer><p>{}</p></footer>", "<div class='ad'><p>{}</p></div>", "<aside>{}</aside>", "<div class=sidebar><p>{}</p></div>", "<script>{}</script>", "<form><p>{}</p></form>"]
    for i in range(120):
        t, a, b = f"Title {i}", _words(rng, rng.randint(5, 80)), _words(rng, rng.randint(5, 80))
        x, links = rng.choice(junk).format(_words(rng, rng.randint(1, 8))), "<div class=more>" + "".join(f"<p><a href=x{j}>{_words(rng, 3)}</a></p>" for j in range(3)) + "</div>"
        page = rng.choice(frames).format(i=i, t=t, a=a, b=b, x=x, m=rng.choice([links, rng.choice(junk).format(_words(rng, 4))]))
        rows.append((i, f"http://h{i % 4}.example.org/{i}", page))
        want[i] = f"{t}\n{a}\n{b}"
    found = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == want


@pytest.mark.parametrize("kind", ["content with-sidebar", "overflow-hidden overlay", "post search-result", "legal-text"])
def test_an_articles_own_wrapper_stays(kind):
    body = "".join(f"<p>The long sentence number {i} of the article.</p>" for i in range(20))
    page = H.read(f'<html><body><div class="top">A title</div><div class="{kind}">{body}<div class="sidebar"><p>aside</p></div></div><p>(c) 2020</p></body></html>')
    lines = [x for _, x in page.lines]
    assert sum("number" in x for x in lines) == 20 and "aside" not in lines
    page = H.read(f'<html><body><article>{body}</article><div class="comments">{body.replace("long", "other")}{body.replace("long", "third")}</div></body></html>')
    assert len(page.lines) == 20


def test_a_path_that_holds_little_of_a_page_does_not_win_there(spark):
    text = "".join(f"<p>The long sentence number {i} of the article.</p>" for i in range(10))
    many = [(i, f"http://h.org/{i}", f"<html><body><div>{text}</div></body></html>") for i in range(5)]
    few = [(9, "http://h.org/9", f"<html><body><div><p>teaser</p></div><section><article>{text}</article></section></body></html>")]
    found = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(many + few, "page_id long, url string, html string")).collect()}
    assert all(t.count("number") == 10 for t in found.values())


@pytest.mark.parametrize("tag,item", [("ul", "li"), ("div class=b", "p")])
def test_text_around_the_longest_part_stays(tag, item):
    items = "".join(f"<{item}>entry {i} of a long list of things</{item}>" for i in range(30))
    page = f"<html><body><div><p>{'before ' * 30}</p><{tag}>{items}</{tag.split()[0]}><div class=c><p>{'after ' * 30}</p></div></div></body></html>"
    text = H.read(page).main_text(None)
    assert text.count("before") == text.count("after") == text.count("entry") == 30


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>one <button>Share</button> two</p><p>x</p></article>", "one two\nx"),
        ("<article><p>one <svg><path d='M0'/><text>no</text></svg> two</p></article>", "one two"),
        ("<article><p>one <span hidden>a <span>b</span> c</span> two</p></article>", "one two"),
        ("<article><p>one <span class=ad>buy</span> two</p></article>", "one two"),
        ("<article><p>one <script>var x = '<p>';</script> two<span>!</span></p></article>", "one two!"),
        ("<article><p>one <span hidden>x</p><p>two</p></article>", "one\ntwo"),
        ('<article><h2 class="section-header">Head</h2><p>text</p><div class="legal"><p>The terms of this law.</p></div></article>', "Head\ntext\nThe terms of this law."),
        ('<body><div class="content with-sidebar"><p>The article has a good many words here.</p></div><div>stray</div></body>', "The article has a good many words here.\nstray"),
        ("<body><div class=a><p>" + "word " * 30 + "</p></div><div class=b><p>" + "term " * 29 + "</p></div></body>", ("word " * 30).strip() + "\n" + ("term " * 29).strip()),
        ("<head><title>t</title><p>an unclosed head</p>", "an unclosed head"),
        ("<article><p>a <a href='x>y'>link</a> and <a title=it's>more</a></p><p>it's</p></article>", "a link and more\nit's"),
        ('<article><p>a</p><img alt="no end><p>b</p></article>', "a\nb"),
        ("<article><p>x</p></ ><!----><p>y</p><! doctype><p>z</p></>", "x\ny\nz"),
        ("<article><table><tr><td><h2>a</h2>b<td>c<tr><td>d</table><p>e</p></article>", "a\nb\nc\nd\ne"),
        ("<div id=page><form><p>All of the page stands in a form.</p><button>Go</button></form></div>", "All of the page stands in a form."),
    ],
)
def test_left_outs_and_containers(page, text):
    assert H.read(page).main_text() == text


@pytest.mark.parametrize("unit", ["<div>x", "<p>x", "<span hidden>x", "<li>x", "<td>x", "<b>x</i>", "<blockquote>x", "<h1>x<li>", "<a title='x>", "<p a=\">\" ", "x</div>", "<!-- x "])
def test_time_and_memory_grow_with_the_length(unit):
    def cost(n):
        start = time.process_time()
        H.read("<article>" + unit * n + "<p>end").main_text()
        return time.process_time() - start

    cost(2_000)
    few, many = cost(10_000), cost(100_000)
    assert many < 30 * max(few, 0.02)
    tracemalloc.start()
    H.read("<article>" + unit * 100_000 + "<p>end").main_text()
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def made(rng, depth=0):
    """A random well-formed element as (markup, lines): the lines it adds to the text around it, block by block."""
    kind = rng.choice(["p", "p", "p", "ul", "div", "section", "gone", "h2"] if depth < 4 else ["p", "h2"])
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta &amp; more", "x &lt; y", "caf&eacute;"])
    if kind in ("p", "h2"):
        words = [word() for _ in range(rng.randint(1, 12))]
        inner = "".join(f"<b>{w}</b> " if rng.random() < 0.2 else f"{w}<span class=ad>buy</span>\n" if rng.random() < 0.1 else f"{w} " for w in words)
        return f"<{kind}>{inner}</{kind}>", [html.unescape(" ".join(words))]
    if kind == "ul":
        items = [word() for _ in range(rng.randint(1, 4))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", [html.unescape(x) for x in items]
    if kind == "gone":
        tag = rng.choice(["nav", "footer", "aside", "div class='ad'", "div role=navigation", "script", "style"])
        return f"<{tag}>gone {word()}</{tag.split()[0]}>", []
    parts = [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return f"<{kind}>" + "".join(x for x, _ in parts) + f"</{kind}>", [y for _, x in parts for y in x]


@pytest.mark.parametrize("seed", range(40))
def test_whole_articles_by_the_tree_they_are_made_from(seed):
    rng = random.Random(seed)
    parts = [made(rng) for _ in range(rng.randint(1, 12))]
    page = f"<html><head><title>no</title></head><body><nav><a href=/>menu</a></nav><article>{''.join(x for x, _ in parts)}</article><footer>foot</footer></body></html>"
    assert H.read(page).main_text() == "\n".join(y for _, x in parts for y in x)


def plainly(page):
    """The article of a test page by patterns alone."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|li|ul)\b[^>]*>", re.sub(r"<(script|style)\b.*?</\1>", "", inner, flags=re.S))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", x))).split()) for x in blocks]
    return "\n".join(x for x in texts if x)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_the_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = queries.op9_html_extraction(spark, folder).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == plainly(pages[r.page_id]) and r.n_chars == len(r.text)
