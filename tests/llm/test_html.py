import doctest
import random
import time
from collections import defaultdict
from html.parser import HTMLParser
from statistics import median

import pytest

from chainloom.llm import html_text
from chainloom.llm.common import table
from chainloom.llm.queries import op5_html_extract

PAGE = "<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav>{}<footer>c</footer></body></html>"
KIND = "page_id bigint, url string, html string, host string, name string, key string, marks int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], KIND)


def kept_by_markup(page):
    blocks, kind = html_text.judged(page)
    return " ".join(b.text for b in blocks if (b.where != "out" if kind == "plain" else b.where in ("article", kind)))


def test_doctests():
    assert doctest.testmod(html_text).failed == 0


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A</h1><p>b <b>c</b>d<br>e<p>f &amp; g&nbsp;h</article>", "A b cd e f & g h"),
        ("<div class='cookie-notice'>no</div><main><p>yes</p><aside>no</aside><form>no</form></main>", "yes"),
        ("<article><header><h1>T</h1></header><p>x</p><div class=comments><p>no</p></div><div id='ad-1'>no</div></article>", "T x"),
        ("<article><p>a<script>var x='</p>'</script>b</p><style>p{}</style><!-- c --><p hidden>no</p></article>", "ab"),
        ("<p>loose &lt;text&gt;</p><ul><li><a>l1</a></li><li><a>l2</a></li></ul>", "loose <text>"),
        ("", ""),
        ("<article><p>1 < 2 &unknown; &#65; &#x42;</article>", "1 < 2 &unknown; A B"),
        ("<div class='page with-sidebar'><article><p>in</p></article></div>", "in"),
        ("<article><p class='notice-board'>a</p><section class='related-work'>b</section><p class='notice'>no</p></article>", "a b"),
        ("<p><a href=x>one paragraph that is a link</a></p><p>b</p>", "one paragraph that is a link b"),
        ("<article><p title='class=ad'>a</p><p>b &#99999999999; &#xFFFFFFFFFFFF;</p></article>", "a b � �"),
        ("<article><p>a</p><p title=\"never closed>b</p></article>", "a b"),
        ("<article><p>text<button>Click</button> more</p></article>", "text more"),
        ("<article><p>wo<span class='ad'>x</span>rd <a class='share'>Share <b>it</b></a>and<span hidden>h</span> on</p></article>", "word and on"),
        ("<article><p>pick<select><option>1<option>2</select> one<svg><text>t</text></svg>.</p></article>", "pick one."),
        ("<article><p>a<span class='ad'>x<span>y</span>z</span>b</p></article>", "ab"),
        ("<article><p>a<a class='share'><div>no</div></a>b</p></article>", "a b"),
        ("<article><p class='share'>Share<h2>Head two</h2><p>Body</article>", "Head two Body"),
        ("<article><p class='share'>Share<div>Head two</div><p>Body</article>", "Head two Body"),
        ("<article><p>a<table><tr><td><p class='ad'>no<td>c</table></article>", "a c"),
        ("<main><p>A</p><article><p>teaser</p></article><p>long true text</p></main>", "A teaser long true text"),
        ("<main><p>A</p><article><p>the long text of an article</p></article><p>b</p></main>", "the long text of an article"),
        ("<article><p class='dialog'>Hello there</p><div class='alert'>mind</div><p class='disclaimer'>c</p></article><p class='alert'>no</p>", "Hello there mind c"),
        ("<div class='alert'>no</div><main>a</main>", "a"),
    ],
)
def test_main_text(body, text):
    assert kept_by_markup(PAGE.format(body)) == text


@pytest.mark.parametrize("part", ["<b", '<a "', '<a "x ', "<a '\">", '<a ">" ', "<!--", "&", "&#9", "<", "<div>", "</x>", "<script"])
def test_broken_markup_is_linear(part):
    for page in (part * (1_000_000 // len(part)), "<div>" * 20_000 + part * (500_000 // len(part)) + ">"):
        began = time.perf_counter()
        html_text.judged(page)
        assert time.perf_counter() - began < 8  # about a second; quadratic time would be minutes


class Plain(HTMLParser):
    """What the text of a page with an article is, by the standard library's parser: whole blocks, no shared code."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.now = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "li", "ul", "div", "article", "nav", "footer", "br", "body", "title", "script", "style", "head"):
            self.cut()
        if tag == "p" and "p" in self.open:
            self.open.remove("p")
        if tag not in ("br", "meta", "img", "link"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "ul", "div", "article", "nav", "footer", "body", "title", "script", "style", "head"):
            self.cut()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "article" in self.open and not {"script", "style", "nav", "footer"} & set(self.open):
            self.now.append(data)

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.blocks += [text] if text else []
        self.now = []


def test_given_pages_against_another_parser(spark):
    """Every page of the given tables has an article; nothing of it may be lost or added."""
    for r in table(spark, "/root/testdata/sf0.01", "pages").join(op5_html_extract(spark, "/root/testdata/sf0.01").select("page_id", "text", "n_chars"), "page_id").collect():
        reader = Plain()
        reader.feed(r.html)
        reader.close()
        reader.cut()
        assert r.text == " ".join(reader.blocks) and r.n_chars == len(r.text)


def extracted_by_hand(rows, least=8, share=html_text.ARTICLE_SHARE, articles=html_text.ARTICLES):
    """The whole query by its definition, over tuples of tokens."""
    pages, where, whole, all_articles = [], defaultdict(set), defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        blocks, kind = html_text.judged(page or "")
        host = url.split("/")[2].lower() if url else ""
        inside = [b for b in blocks if b.where == "article" or kind == "main" and b.where == "main"] if kind != "plain" else []
        says = tuple(b.text for b in (inside or blocks))
        pages.append((host, blocks, kind, inside))
        run = []
        for b in [*blocks, None]:
            if b is not None and not any(b is x for x in inside):
                run += b.text.split(" ")
                continue
            for i in range(len(run) - least + 1):
                where[host, tuple(run[i : i + least])].add(says)
            run = []
        long = [b.text for b in inside if len(b.text.split(" ")) >= least]
        for t in long:
            whole[host, t].add(says)
        if long:
            all_articles[host].add(says)
    out = []
    for host, blocks, kind, inside in pages:
        if kind != "plain":
            stands = lambda b: len(whole[host, b.text])  # noqa: E731, B023
            out.append(" ".join(b.text for b in inside if not (stands(b) >= articles and stands(b) >= share * len(all_articles[host]))))
            continue
        tokens = [w for b in blocks for w in b.text.split(" ")]
        n = [len(where[host, tuple(tokens[i : i + least])]) for i in range(len(tokens) - least + 1)]

        def left(most):
            gone = {i + j for i, x in enumerate(n) if x >= most for j in range(least)}  # noqa: B023
            kept, longest, at = [], 0, 0
            for b in blocks:  # noqa: B023
                k = len(b.text.split(" "))
                runs, here = [], list(range(at, at + k))
                for i in here:
                    if runs and (i in gone) == runs[-1][0]:
                        runs[-1][1].append(i)
                    else:
                        runs.append((i in gone, [i]))
                mine = [tokens[i] for g, r in runs for i in r if not g or not (len(r) >= least or len(r) == k)]  # noqa: B023
                if b.where != "out":
                    kept += mine
                    longest = max(longest, len(mine))
                at += k
            return kept, longest

        kept, longest = left(2)
        if n and longest < least:
            kept, _ = left(2 * median(n))
        out.append(" ".join(kept))
    return out


def made_pages(rng):
    words = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(n))
    menus, notice, rows = [words(12) for _ in range(4)], words(9), []
    for i in range(120):
        host = rng.choice(["h", "h", "g", "G"])
        menu, body, quote = rng.choice(menus), [words(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 4))], words(10) if i % 3 else menus[0]
        form = rng.randrange(4)
        if form == 0:
            page = f"<div>{menu}</div>" + "".join(f"<p>{b}</p>" for b in body) + f"<div>{menus[1]} (c)</div>"
        elif form == 1:
            page = f"<nav>{menu}</nav><article><h1>t</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"<p>{quote}</p><p>{notice}</p></article>"
        elif form == 2:
            page = f"<p>{menu}</p><main>" + "".join(f"<p>{b}</p>" for b in body) + f"<p>{notice}</p></main>"
        else:
            page = rows[rng.randrange(len(rows))][2] if rows else ""
            if i % 2:
                page = page.replace(" a ", " changed ", 1)
        rows.append((i, f"http://{host}/{i}", page))
    return [*rows, (None, None, None), (200, "odd", "<p>x</p>"), rows[0]]


def test_whole_query_against_python(spark):
    rows = made_pages(random.Random(8))
    rows = [r for r in rows if r[1] != "odd"]
    want = sorted((r[0] is None, r[0] or 0, t) for r, t in zip(rows, extracted_by_hand(rows), strict=True))
    assert any(n for n in (r.n_repeated for r in html_text.extract_text(pages_of(spark, rows)).collect()))
    for parts in (1, 7):
        got = html_text.extract_text(pages_of(spark, rows).repartition(parts)).collect()
        assert sorted((r.page_id is None, r.page_id or 0, r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) for r in got)


def test_notice_of_all_articles_goes_and_copied_articles_stay(spark):
    notice = "read our newsletter every morning for more stories like this"
    quote = "a passage of ten words that just two articles quote"
    rows = [(i, "http://h/x", f"<article><p>story {i} of its own kind</p><p>{notice}</p>{f'<p>{quote}</p>' if i < 2 else ''}</article>") for i in range(12)]
    copied = "<article><p>one article that many pages of a host all copy word by word</p></article>"
    rows += [(100 + i, "http://copies/x", copied) for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract_text(pages_of(spark, rows)).collect()}
    assert got[0] == f"story 0 of its own kind {quote}" and got[5] == "story 5 of its own kind"
    assert got[100] == "one article that many pages of a host all copy word by word"


def test_menus_on_two_pages_of_a_large_host(spark):
    word = lambda rng: "".join(rng.choice("abcdefghij") for _ in range(6))
    rng = random.Random(3)
    menus = [" ".join(word(rng) for _ in range(10)) for _ in range(40)]
    rows = []
    for i in range(2000):
        own = " ".join(word(rng) for _ in range(30))
        rows.append((i, f"http://big.example/{i}", f"<div>{menus[i % 40]}</div><p>{own}</p>" if i < 80 else f"<p>{own}</p>"))
    want = None
    for parts in (1, 4, 16):
        got = {r.page_id: r.text for r in html_text.extract_text(pages_of(spark, rows).repartition(parts)).collect()}
        assert all(len(t.split()) == 30 for t in got.values())
        want = want or got
        assert got == want


def test_odd_tables(spark):
    menu = "home products about us contact imprint terms of service privacy"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><p>story number {i} with its own words {i * 7} {i * 11}</p>") for i in range(5)]
    rows += [(None, None, None), (9, "http://other.example/", f"<div>{menu}</div>"), (10, "odd", ""), (11, "http://h.example/", "<p>" + "word " * 300_000)]
    got = {r.page_id: r.text for r in html_text.extract_text(pages_of(spark, rows)).collect()}
    assert got.pop(11) == " ".join(["word"] * 300_000)
    assert got == {**{i: f"story number {i} with its own words {i * 7} {i * 11}" for i in range(5)}, None: "", 9: menu, 10: ""}
    assert html_text.extract_text(pages_of(spark, [])).count() == 0
