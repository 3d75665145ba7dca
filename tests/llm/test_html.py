import random
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tomeflow.llm import html

LONG = "words of the article go on and on in this long paragraph until the block is well filled "
BOILER = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(30))


def page(inner, holder="article", attributes=""):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='home ad-free'><header><h1>Site</h1></header><nav><ul>{BOILER}</ul></nav>"
        f"<div class='cookie-notice'>We use cookies. {LONG * 2}</div><div id='main-sidebar'>{LONG}</div>"
        f"<{holder} {attributes}>{inner}</{holder}>"
        f"<section class='comments'><p>{LONG * 3}</p></section><aside>{LONG}</aside><form>Mail <input></form><footer>&copy; {LONG}</footer></body></html>"
    )


def test_article_whole_with_short_lines():
    inner = f"<h1>Title &amp; more</h1><p>Be.</p><p>{LONG}<b>bold</b> t&eacute;xt&nbsp;here<br>and<p>{LONG}<script>var a='<p>no</p>';</script><p>End.</p>"
    want = f"Title & more\nBe.\n{LONG}bold téxt here and\n{LONG.strip()}\nEnd."
    assert html.main_text(page(inner)) == want
    assert html.main_text(page(inner, "div", "id='content'")) == want
    assert html.main_text(page(inner, "main")) == want


def test_short_article_without_surge():
    assert html.main_text(page("<p>Be.</p><p>It &lt;is&gt;.</p>")) == "Be.\nIt <is>."


def test_page_without_an_article_element():
    body = f"<body><div class='top'>My site</div><div>Menu here</div><h1>Title</h1><p>Be.</p><p>{LONG}</p><p>{LONG}</p><p>End.</p><div>Links</div><div>a</div><div>b</div><div>c</div></body>"
    text = html.main_text(body)
    assert f"Title\nBe.\n{LONG.strip()}\n{LONG.strip()}\nEnd." in text and "My site" not in text and not text.endswith("c")


def test_all_regions_of_a_page_without_an_article_element_stay():
    aside = f"<aside><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></aside>"
    sections = f"<section><h2>One</h2><p>{LONG}</p></section>{aside}<section><h2>Two</h2><p>{LONG * 2}</p><p>End.</p></section>"
    want = f"One\n{LONG.strip()}\nTwo\n{(LONG * 2).strip()}\nEnd."
    assert html.main_text(f"<body><div>{sections}</div></body>") == want
    assert html.main_text(f"<body>{sections}</body>") == want


def test_names_around_the_only_article_dont_hide_it():
    for name in ("has-sidebar", "no-header", "with-comments"):
        article = f"<article><p>{LONG}</p><div class='ad'>Buy</div></article>"
        assert html.main_text(f"<body><div class='{name}'>{article}</div></body>") == LONG.strip()
        assert html.main_text(f"<body><aside class='{name}'>{article}</aside></body>") == ""
    comments = f"<section class='comments'><article><p>{LONG * 3}</p></article></section>"
    assert html.main_text(f"<body><article><p>{LONG}</p></article>{comments}</body>") == LONG.strip()


def test_adverts_and_comments_inside_the_article_go():
    inner = f"<p>{LONG}</p><div class='ad'>Buy</div><p>{LONG}</p><div class='newsletter-signup'>Join <input name=mail></div><div id=comments><p>{LONG * 4}</p></div><p>End</p>"
    assert html.main_text(page(inner)) == f"{LONG.strip()}\n{LONG.strip()}\nEnd"


def test_references_are_decoded_once_and_space_is_one():
    assert html.main_text("<p>a&amp;lt;b &#233;\n\t c&nbsp; d</p>") == "a&lt;b é c d"


def test_odd_markup():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("plain text") == "plain text"
    assert html.main_text("<!-- never closed <p>x") == ""
    assert html.main_text("<p>a<!-- c --><p title='x>y'>b<script>unclosed <p>z") == "a\nb"
    assert html.main_text("a < b and 1 <2") == "a < b and 1 <2"
    assert html.main_text("</div></article><p>x</p>") == "x"
    assert html.main_text("<head><title>t</title><body><p>kept") == "kept"


def test_class_words_are_whole():
    inner = f"<p class='lead-in'>{LONG}</p><div class='shadow header-less'><p>x</p></div><div class='adornment'><p>y</p></div><div class='sideBar'>{LONG}</div>"
    assert html.main_text(page(inner)) == f"{LONG.strip()}\nx\ny"


def test_a_name_inside_a_class_is_no_name():
    for name in ("share-price", "ad-hoc-report", "related-work", "comment-period", "cookie-recipe", "notice-of-sale"):
        assert html.main_text(page(f"<p>{LONG}</p><div class='{name}'><p>Kept.</p></div>")) == f"{LONG.strip()}\nKept.", name
    for name in ("ad-box", "reader-comments", "cookie_notice"):
        assert html.main_text(page(f"<p>{LONG}</p><div class='{name}'><p>Gone.</p></div>")) == LONG.strip(), name
    assert html.main_text(page("<div class='page-header'><h1>T</h1></div><p data-class='ad' title='class=ad'>x</p>")) == "T\nx"


def test_furniture_inside_an_article_goes_by_what_it_holds():
    for name in ("widget", "login", "relatedLinks", "share buttons", "social", "signup", "subscribe-box", "overlay"):
        kept = f"<p>{LONG}</p><section id='{name}'><p>How to log in is explained here.</p><p>See <a href='/x'>there</a> too.</p></section><p>End.</p>"
        assert html.main_text(page(kept)) == f"{LONG.strip()}\nHow to log in is explained here.\nSee there too.\nEnd.", name
        for inner in ("<a href='/a'>Gone</a> <a href='/b'>too</a>", "Gone: <ul><li><a href='/a'>what was read most</a></li></ul>", "<p>Your address <input name=mail></p>", "<p>Go <button>now</button></p>"):
            assert html.main_text(page(f"<p>{LONG}</p><div class='{name}'>{inner}</div><p>End.</p>")) == f"{LONG.strip()}\nEnd.", (name, inner)


def test_a_form_that_is_the_page_is_no_form():
    login = "<form>Name <input> and word <input></form>"
    body = f"<div><h1>Title</h1><p>{LONG}</p><p>End.</p></div>"
    want = f"Title\n{LONG.strip()}\nEnd."
    assert html.main_text(f"<body><form action='/'>{body}</form></body>") == want
    assert html.main_text(f"<body><form action='/'><div>{login}</div>{body}</form></body>").endswith(want)
    assert html.main_text(f"<body>{login}{body}</body>") == want
    assert html.main_text(f"<body><form><article>{body}{login}</article></form></body>") == want


def test_short_lines_beside_a_surge_stay():
    assert html.main_text(f"<body><h1>Title</h1><p>Intro.</p><p>More.</p><p>Again.</p><p>{LONG}</p><p>b</p><p>c</p><p>d</p><p>End.</p></body>") == f"Title\nIntro.\nMore.\nAgain.\n{LONG.strip()}\nb\nc\nd\nEnd."
    assert html.main_text(f"<body><div>My site</div><h1>Title</h1><div><p>Intro.</p><p>{LONG}</p><p>End.</p></div><div>Imprint</div></body>") == f"Title\nIntro.\n{LONG.strip()}\nEnd."
    menu = "<a href='/'>Home</a>"
    assert html.main_text(f"<body>{menu}<p>Intro.</p><p>{LONG}</p><p>End.</p>{menu}</body>") == f"Intro.\n{LONG.strip()}\nEnd."


def test_articles_side_by_side_all_stay():
    one, two = f"<article><h2>One</h2><p>{LONG * 2}</p></article>", f"<article><h2>Two</h2><p>{LONG}</p></article>"
    want = f"One\n{(LONG * 2).strip()}\nTwo\n{LONG.strip()}"
    assert html.main_text(f"<body><div>{one}<div>Between.</div>{two}</div></body>") == want
    assert html.main_text(f"<body><main>{one}{two}</main></body>") == want
    assert html.main_text(f"<body><div>{one}</div><div>{two}</div></body>") == want.split("\nTwo")[0]


def test_what_is_text_of_an_article():
    inner = f"<p>{LONG}<button>press</button></p><math><mi>x</mi></math><svg><title>t</title><text>label</text></svg><canvas>old</canvas><object>old</object><p>End.</p>"
    assert html.main_text(page(inner)) == f"{LONG.strip()}\nx\nlabel\nEnd."


def test_surge_and_dive_find_the_text_where_nothing_is_marked():
    """Neither an article nor a name of boilerplate: only the lengths and the empty lines between."""
    top = "<div><div>My site</div><div><a href='/'>Home</a> <a href='/x'>Another link of the menu that has a very long text, longer than most lines are in menus</a></div></div>"
    body = f"<h1>Title</h1><p>Be.</p><p>{LONG}</p><div>Short.</div><p>{LONG}</p><p>End.</p>"
    foot = "<div><div>All rights reserved.</div></div>"
    assert html.main_text(f"<body>{top}<div>{body}</div>{foot}</body>") == f"Title\nBe.\n{LONG.strip()}\nShort.\n{LONG.strip()}\nEnd."
    assert html.regions([5, 0, 0, 0, 90, 1, 0, 0, 0, 1], [86] * 11) == [(4, 6)]
    assert html.regions([1, 1, 1, 1, 90], [86] * 6) == [(0, 5)] and html.regions([0, 0], [0] * 3) == html.regions([], [0]) == []


def test_a_sibling_of_an_article_stays_out():
    assert html.main_text(f"<div><article><p>{LONG}</p><p>End.</p></article><div>Short.</div></div>") == f"{LONG.strip()}\nEnd."


class Brute(HTMLParser):
    """The rule on well-formed pages, from whole paths of ancestors."""

    BOXES = ("article", "div", "section", "body", "nav", "aside", "footer")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.ids, self.rows, self.buffer, self.link = [], 0, [], "", ""
        self.full = set()  # containers that hold containers which aren't boilerplate

    def cut(self):
        if text := " ".join(self.buffer.split()):
            if not any(n in ("head", "script", "style") for n, *_ in self.path):
                self.rows.append((text, [*self.path], len(" ".join(self.link.split()))))
        self.buffer = self.link = ""

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCKS or tag in ("script", "style"):
            self.cut()
            if tag != "p":
                self.ids += 1
                name = dict(attrs).get("class", "")
                if tag in ("article", "div", "section", "body") and name != "ad":
                    self.full.update([i for n, i, _ in self.path if n in self.BOXES][-1:])
                self.path.append((tag, self.ids, name))
        elif tag == "br":
            self.buffer += " "
        elif tag == "a":
            self.path.append(("a", 0, ""))

    def handle_endtag(self, tag):
        if tag in html.BLOCKS or tag in ("script", "style"):
            self.cut()
        while tag in [n for n, *_ in self.path] and self.path.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.buffer += data
        if any(n == "a" for n, *_ in self.path):
            self.link += data

    def main_text(self, page):
        self.feed(page)
        self.close()
        self.cut()
        rows = [r for r in self.rows if not any(n in ("nav", "aside", "footer", "header") or c == "ad" for n, _, c in r[1])]
        boxes = [[(n, i) for n, i, _ in path if n in ("article", "div", "section", "body")] for _, path, _ in rows]
        boxes = [b[:-1] if len(b) > 2 and b[-1][0] != "article" and b[-1][1] not in self.full else b for b in boxes]
        within = [any(n == "article" for n, _ in b) for b in boxes]
        at = []
        for k, row in enumerate(rows):
            if k:
                same = 0
                while same < min(len(boxes[k]), len(boxes[k - 1])) and boxes[k][same] == boxes[k - 1][same]:
                    same += 1
                borders = len(boxes[k]) + len(boxes[k - 1]) - 2 * same
                if borders and not any(n == "article" for n, _ in boxes[k][:same]):
                    at += [None] * (3 if same <= 1 or within[k] or within[k - 1] else 2 * borders)
            at.append(k)
        size = lambda k: 0 if k is None else len(rows[k][0]) - (0 if within[k] else rows[k][2])
        sums = [sum(map(size, at[i : i + 3])) for i in range(len(at))]
        for least in (86, 0):
            runs, i = [], 0
            while i < len(at):
                z = i
                while z < len(at) and sums[z]:
                    z += 1
                if any(sums[x] > (0 if at[x] is not None and within[at[x]] else least) for x in range(i, z)):
                    while not size(at[i]):
                        i += 1
                    runs.append((i, z))
                i = z + 1
            if runs:
                break
        marked = [r for r in runs if within[at[r[0]]]]
        if marked:
            best = max(marked, key=lambda r: sum(size(k) for k in at[r[0] : r[1]]))

            def place(r):  # of the outermost article: itself, what holds it
                path = [(n, i) for n, i, _ in rows[at[r[0]]][1] if n in html.HOLDERS]
                k = [n for n, _ in path].index("article")
                return path[k], path[k - 1]

            runs = [r for r in marked if r == best or (place(r)[0] != place(best)[0] and place(r)[1] == place(best)[1])]
            return "\n".join(rows[k][0] for r in runs for k in at[r[0] : r[1]] if k is not None)
        if not runs:
            return ""
        keep = [k for k in at[runs[0][0] : runs[-1][1]] if k is not None]
        holder = lambda k: [i for n, i, _ in rows[k][1] if n in html.HOLDERS][-1]
        while keep[0] > 0 and holder(keep[0] - 1) == holder(keep[0]) and rows[keep[0] - 1][2] < len(rows[keep[0] - 1][0]):
            keep.insert(0, keep[0] - 1)
        while keep[-1] + 1 < len(rows) and holder(keep[-1] + 1) == holder(keep[-1]) and rows[keep[-1] + 1][2] < len(rows[keep[-1] + 1][0]):
            keep.append(keep[-1] + 1)
        return "\n".join(rows[k][0] for k in keep)


def random_page(r):
    def text():
        t = " ".join(r.choice(("word", "of", "a", "page", "longer", "&amp;")) for _ in range(r.choice((1, 2, 5, 30))))
        return f"<a href='/x'>{t}</a>" if r.random() < 0.2 else t

    def block(depth):
        kind = r.choice(("p", "p", "p", "div", "section", "ul", "ad", "nav", "aside", "article", "footer"))
        if kind == "p" or depth == 0:
            return f"<p>{text()}<br>{text()}</p>"
        inner = "".join(block(0 if kind == "ad" else depth - 1) for _ in range(r.randint(1, 4)))
        if kind == "ul":
            return f"<ul><li>{text()}</li><li>{text()}</li></ul>"
        if kind == "ad":
            return f"<div class='ad'>{inner}</div>"
        return f"<{kind}>{inner}</{kind}>"

    return "<html><head><title>t</title></head><body>" + "".join(block(4) for _ in range(r.randint(1, 5))) + "</body></html>"


def test_against_brute_force_on_all_pages_and_random_ones():
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    r = random.Random(5)
    pages += [random_page(r) for _ in range(3_000)]
    for x in pages:
        if html.main_text(x) != Brute().main_text(x):
            raise AssertionError(x)


def test_long_pages_in_linear_time():
    began = time.time()
    assert len(html.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")) > 1_000_000
    assert html.main_text("<div>" * 20_000 + "x") == "x"
    html.main_text("<a " * 20_000)
    html.main_text('<p class="' * 2_000)
    assert time.time() - began < 30


def test_table(spark):
    rows = [(1, "u", page(f"<p>{LONG}")), (2, None, None), (None, "v", ""), (1, "u", page(f"<p>{LONG}"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main", F.lit(1)).withColumn("TEXT", F.lit("clash"))
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()]
    t = LONG.strip()
    assert sorted(got, key=repr) == sorted([(1, "u", t, len(t)), (2, None, "", 0), (None, "v", "", 0), (1, "u", t, len(t))], key=repr)
    assert html.extract(df.limit(0)).count() == 0
