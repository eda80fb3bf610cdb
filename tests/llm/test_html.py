import re
import zlib
from urllib.parse import urlsplit

from ordlens.llm import html

PAGES = "page_id long, url string, html string, text string, host int"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_and_chrome():
    src = page("<nav><ul><li><a href='/x'>Menu</a></ul></nav><header>Site</header><!-- <p>no</p> --><div class=\"ad big\">Buy</div>"
               "<article><header><h1>Title &amp; more</h1></header><p><b>Bold<br>line <i>two</i><p>next\n\t para &eacute;&#233;</p>"
               "<aside>Side</aside><form>Name <input></form><style>p{}</style><ul><li>one<li>two</ul><div id='comments'><p>Nice!</div>"
               "</article><div class='cookie-notice'>We use</div><footer>End</footer>")
    assert " ".join(t for t in [html.text_of_page(src)]) == "Title & more Bold line two next para éé one two"
    assert html.text_of_page(page("<div class=menu>M</div><div>Body <a>text</a></div><p hidden>x</p>")) == "Body text"
    for odd in (None, "", "<", "<p", "a < b", "</div></p>x", "<p>a<div>b</p>c"):
        assert isinstance(html.text_of_page(odd), str)
    assert html.text_of_page("a < b &lt;c&gt;") == "a < b <c>"


def test_simple_tree_matching():
    a = ["r", [["x", []], ["y", [["p", []]]], ["z", []]]]
    b = ["r", [["x", []], ["w", []], ["y", [["p", []], ["q", []]]]]]
    assert html.match(a, b)[0] == 4
    assert html.match(a, ["s", []])[0] == 0
    html.merge(a, b)
    assert a == ["r", [["x", []], ["w", []], ["y", [["p", []], ["q", []]]], ["z", []]]]
    assert html.slots_of(a, ["r", [["y", [["q", []]]], ["z", []]]]) == [0, 3, 5, 6]


def test_template_texts_go_and_content_stays(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN_IN", 2)
    rows = []
    for i in range(40):
        extra = "<section><p>Optional box</p></section>" if i % 3 == 0 else ""
        body = (f"<article><h1>Head {i}</h1><p class=note2>Read our rules</p>{extra}" + "".join(f"<p>Para {i} {j}</p>" for j in range(i % 4 + 1))
                + "<div>Share this page</div></article>")
        rows.append((i, f"http://a.com/{i}", page(body), "x", 1))
    rows += [(100 + i, "http://copies.com/", page("<article><p>Same</p><p>again</p></article>"), "x", 1) for i in range(20)]
    rows += [(200, None, page("<p>No url</p>"), None, None), (None, "http://a.com/z", None, None, None),
             (201, "http://a.com/y", "", None, None), (0, *rows[0][1:])]
    got = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(40):
        box = "Optional box " if i % 3 == 0 else ""
        assert by[i] == f"Head {i} {box}" + " ".join(f"Para {i} {j}" for j in range(i % 4 + 1))
    assert all(by[100 + i] == "Same again" for i in range(20)) and by[200] == "No url" and by[None] == "" and by[201] == ""
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_long_page(spark):
    src = page("<article>" + "".join(f"<p>w{i}</p>" for i in range(20_000)) + "</article>")
    got = html.main_text(spark.createDataFrame([(1, "http://a.com/", src, None, None)], PAGES)).collect()
    assert got[0].text == " ".join(f"w{i}" for i in range(20_000))


def test_copies_with_other_chrome_count_once(spark):
    """20 copies that differ only in advert, menu and layout are most of the host's pages, and keep their text."""
    def body(article, i):
        ads = "".join(f"<div class=ad><p>Advert {i} {j}</p></div><hr class=r{i % 5}>" for j in range(i % 3 + 1))
        return page(f"<nav><a href=/>Menu {i}</a></nav>{ads}<article>{article}<p>Read our rules</p></article>")

    rows = [(i, f"http://b.com/{i}", body("<h1>Same</h1><p>Story one</p><p>Story two</p>", i), "x", 1) for i in range(20)]
    rows += [(100 + i, f"http://b.com/o{i}", body(f"<h1>Head {i}</h1><p>Own {i}</p>", i), "x", 1) for i in range(10)]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(by[i] == "Same Story one Story two" for i in range(20))
    assert all(by[100 + i] == f"Head {i} Own {i}" for i in range(10))


def test_very_deep_pages_return(spark):
    deep = "<div>" * 100_000
    pages = [(1, "http://d.com/1", page(f"<article><p>One</p>{deep}<p>low</p></article>"), "x", 1),
             (2, "http://d.com/2", page(f"<article><p>Two</p>{'<section>' * 50_000}{'<ul><li>' * 20_000}low"), "x", 1),
             (3, "http://d.com/3", page("<article><p>Three</p></article>"), "x", 1)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {1: "One low", 2: "Two low", 3: "Three"}


def test_flat_trees_come_back():
    tree = ["r", [["x", [["p", []], ["q", [["z", []]]]]], ["y", []]]]
    assert html.unflat(html.flat(tree)) == tree


def test_region_is_the_container_of_most_varying_prose():
    #        0 r   1 menu          2 side            3 box   4 h    5 p (run)   6 note  7 q
    tree = ["r", [["menu", []], ["side", []], ["box", [["h", []], ["p", []], ["note", [["q", []]]]]]]]
    assert html.region(tree, {1: 10, 2: 300, 4: 50, 5: 900, 7: 40}, set()) == (3, 8)
    assert html.region(tree, {2: 300, 5: 200}, set()) == (0, 8)  # the larger part is one run of text: its parent
    assert html.region(tree, {2: 300, 4: 60, 5: 110, 7: 50}, {4, 5, 7}) == (3, 8)  # up to twice the prose of an article
    assert html.region(tree, {}, set()) == (0, 8)


def renamed(source, host):
    """The page with its containers as div and class names made up per host, so that no name tells what is content."""
    for tag in ("article", "nav", "footer", "aside", "header"):
        source = re.sub(rf"<{tag}\b", f'<div class="{tag}"', source.replace(f"</{tag}>", "</div>"))
    return re.sub(r'class="([^"]*)"', lambda m: f'class="x{zlib.crc32((host + m[1]).encode())}"', source)


def test_wrapper_finds_the_article_without_names(spark):
    """Every page of the test table with its containers renamed to div and all class names scrambled."""
    rows, want = [], {}
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        host = urlsplit(r.url or "").netloc.lower()
        rows.append((r.page_id, r.url, renamed(r.html or "", host), None, None))
        want[r.page_id] = html.text_of_page(r.html)
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.95 * len(want), same / len(want)


def test_teasers_and_sidebars_vary_but_are_not_the_region(spark):
    rows = []
    for i in range(30):
        teasers = "".join(f"<div class=k{j}><a href=/t>Other story {i} {j} with a fairly long teaser line</a></div>" for j in range(6))
        side = f"<div class=s><p>Today {i}: sunny</p><p>Poll {i}</p></div>"
        story = f"<h1>Head {i}</h1>" + "".join(f"<p>{f'Sentence {i} {j} goes on. ' * 8}</p>" for j in range(i % 5 + 1))
        rows.append((i, f"http://t.com/{i}", page(f"<div class=z1>{teasers}</div><div class=z2><div class=z3>{story}</div>{side}</div>"),
                     "x", 1))
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(30):
        assert by[i] == f"Head {i} " + " ".join(("Sentence %d %d goes on. " % (i, j) * 8).strip() for j in range(i % 5 + 1))


def test_very_long_blocks_are_measured(spark):
    rows = [(i, f"http://l.com/{i}", page(f"<div class=a>Menu {i}</div><div class=b><h1>Head {i}</h1><p>{f'word{i} ' * 20_000}</p></div>"),
             None, None) for i in range(9)]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(by[i] == f"Head {i} " + (f"word{i} " * 20_000).strip() for i in range(9))
