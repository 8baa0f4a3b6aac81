import math
import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from tidelog.llm import html
from tidelog.llm.queries import QUERIES

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a<p>b<br>c</p><div>d<b>e</b>f</div>", "a\nb c\ndef"),
    ("<article><h1>T</h1><p>x &amp; y &lt;b&gt; &#233;&nbsp;z</p></article><footer>f</footer>", "T\nx & y <b> é z"),
    ("<body><nav>n</nav><header>h</header><div id=main><h1>T</h1><p>x</p></div><aside>s</aside></body>", "T\nx"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer><div class='share-buttons'>s</div></article>", "T\nx"),
    ("<main><p>x</p><section id='comments'><article class='comment'>c</article></section><form>f<input></form></main>", "x"),
    ("<div class='content-with-sidebar'><article><p>x</p></article><div class='sidebar'>s</div></div>", "x"),
    ("<form id='aspnet'><article><p>x</p><form>f</form></article></form>", "x"),
    ("<article>a<script>var t='</p><p>';</script><style>p{}</style><!-- c <p> -->b<noscript>n</noscript></article>", "ab"),
    ("<article><p>cut off here<div cla", "cut off here"),
    ("<article><p>x</p><p title='a>b'>y</p><p title=\"", "x\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p>x<div class='ad'>buy</div><div class=cookie-notice>ok?</div><div hidden>h</div><p style='display: none'>n</p><p>y</p></article>", "x\ny"),
    ("<article><h2>Ads and menus</h2><p>Comments on adverts</p><p class='address'>road</p><p class='leads'>l</p></article>", "Ads and menus\nComments on adverts\nroad\nl"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ("<main><article><p>the article</p></article><section><p>more</p></section></main>", "the article"),
    ("<main><h1>T</h1><p>a long text of its own</p><article>teaser</article></main>", "T\na long text of its own\nteaser"),
    ("<article><div class='ADS'>a</div><div class='navBar'>b</div><div id='SiteNotice'>c</div><div class='adslot-2'>d</div>x</article>", "x"),
    ("<script>only", ""),
    ("<nav><p>only</p></nav>", ""),
    ("<title>t</title><p>x", "x"),
    ("</p></div>x</b>", "x"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert html.main_text(page) == text


SLUGS = ["ad-hoc-networks", "related-work", "search-algorithms", "social-history", "Comments_on_the_text", "menu", "copyright-law", "notice"]
NAMES = [
    *((f"<article><p>x</p><h2 id='{s}'>T</h2><p id='{s}'>y</p></article>", "x\nT\ny") for s in SLUGS),
    *((f"<main><section id='{s}'><h2>T</h2><p>y</p></section></main>", "T\ny") for s in SLUGS),
    *((f"<main><div class='section' id='{s}'><h2>{re.sub('[-_]', ' ', s).title()}</h2><p>y</p></div></main>", f"{re.sub('[-_]', ' ', s).title()}\ny") for s in SLUGS),
    ("<article><h2 class='notice related'>T</h2><table class='search-results' id='menu'><tr><td>y</table><blockquote class='social'>z</blockquote></article>", "T\ny\nz"),
    ("<body><h2 id='related-work'>T</h2><p>y</p></body>", "T\ny"),
    ("<article id='commentary-on-rome'><p>x</p></article>", "x"),
    ("<article><p>x</p><div id='social-share'><h3>Tell others</h3></div><section class='related'>r</section><ul class='menu'><li>m</ul></article>", "x"),
    ("<article><p>x</p><p class='advertisement'>a</p><h2 id='search' hidden>h</h2><div id='ad-slot'>b</div></article>", "x"),
    ("<main><p>x</p><article id='comment-12'>c</article></main>", "x"),
    ("<article><div class='entry-header' id='header'><h1>T</h1></div><p>x</p></article>", "T\nx"),
]


@pytest.mark.parametrize(("page", "text"), NAMES)
def test_names_in_an_article(page, text):
    assert html.main_text(page) == text


FORMULAS = [
    ("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><p>c</p></article>", "a x=2 b\nc"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></p><p>c</p></article>", "so x=2\nc"),
    ("<article><p><math><semantics><mi>x</mi><annotation encoding='TeX'>\\x</annotation><annotation-xml><p>X</p></annotation-xml></semantics></math> b</p></article>", "x b"),
    ("<article><p><math><mi>x</mi><annotation>t</math> b</p><p>c</p></article>", "xt b\nc"),
]


@pytest.mark.parametrize(("page", "text"), FORMULAS)
def test_formulas(page, text):
    assert html.main_text(page) == text


def test_deep_and_long_pages_end():
    assert html.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html.main_text("<p>word</p>" * 50_000)) == 50_000 * 5 - 1
    assert html.main_text("<" * 20_000) == "<" * 20_000
    assert html.main_text("<a " + '"' * 5001 + "x") is not None


KIND = "page_id long, url string, html string"


def site(n, host="h.example"):
    """Pages whose boilerplate has no telling name."""
    return [(i, f"http://{host}/{i}", f"<body><div class=top>Our site, est. 1990</div><div class=mid><h1>Title {i}</h1><p>Text number {i} of many.</p></div><div class=end><p>Read more here</p></div></body>") for i in range(n)]


def test_the_tree_finds_what_all_pages_repeat(spark):
    rows = [*site(12), (100, "http://few.example/", "<body><div class=top>Our site, est. 1990</div><p>x</p></body>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, KIND)).collect()}
    assert got[3] == "Title 3\nText number 3 of many."
    assert got[100] == "Our site, est. 1990\nx"
    plain = {i: html.main_text(h) for i, _, h in rows}
    assert all(plain[i].startswith("Our site") for i in range(12))  # no name says so


def article(i, paragraphs, lang="x"):
    """A page without a telling name: menu, advert, text and foot are all div elements, and no word comes twice."""
    menu = "".join(f"<div><b>m{i}w{k}</b></div>" for k in range(4 + (i % 7 == 0)))
    text = "".join(f"<p>text {i} {k}</p>" for k in range(paragraphs))
    return f"<body><div class=a>{menu}</div><div class=b>buy {i}</div><div class=c><h1>title {i}</h1>{text}</div><div class=d>foot {i}</div></body>", "\n".join([f"title {i}", *(f"text {i} {k}" for k in range(paragraphs))])


def test_the_tree_alone_tells_articles_from_templates(spark):
    rnd = random.Random(3)
    made = {i: article(i, rnd.randrange(1, 30)) for i in range(90)}
    host = lambda i: "big.example" if i < 60 else f"small{i}.example"
    pages = spark.createDataFrame([(i, f"http://{host(i)}/{i}", h) for i, (h, _) in made.items()], KIND)
    for names in (False, True):
        got = {r["page_id"]: r["text"] for r in html.extract(pages, names=names).collect()}
        assert got == {i: t for i, (_, t) in made.items()}
    # Without trees nothing is cut from these.
    assert all(html.main_text(h) != t and html.main_text(h).startswith("m") for h, t in made.values())


def test_importance_by_brute_force(spark):
    rnd = random.Random(4)
    pages = [f"<body><div class=a>{''.join(f'<p>{rnd.choice(words)}</p>' for _ in range(rnd.randrange(4)))}</div><i>same</i></body>" for words in [["u", "v", "w", "x"]] * 25]
    pages += pages[:3]  # copies count once
    rows = [(i, "http://h.example/", h) for i, h in enumerate(pages)]
    different = sorted(set(pages))
    sequences, blocks, nodes = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for n, h in enumerate(different):
        parsed, said = html.parse(h)
        for key in {(x.path, tuple(x.kids)) for x in parsed}:
            sequences[key[0]][key[1]] += 1
            nodes[key[0]].add(n)
        for key in {(y, b) for x, b in said for y in {x.path, x.top.path if x.top else x.path}}:
            blocks[key[0]][key[1]] += 1
    got = {r["path"]: r for r in html.style_tree(spark.createDataFrame(rows, KIND)).where(F.col("h") != html.EVERYWHERE).collect()}
    assert set(got) == set(sequences)
    for path, counts in sequences.items():
        n = sum(counts.values())
        entropy = -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(n) if n > 1 else 0.0
        assert got[path]["pages"] == len(nodes[path]) and got[path]["different"] == len(different)
        assert abs(got[path]["presentation"] - entropy) < 1e-9
        if path in blocks and len(nodes[path]) > 1:
            mean = sum(math.log(k) for k in blocks[path].values()) / len(blocks[path])
            assert abs(got[path]["content"] - (1 - min(1, mean / math.log(len(nodes[path]))))) < 1e-9
    assert max(r["presentation"] for r in got.values()) > 0.3 and min(r["content"] for r in got.values() if r["content"] is not None) == 0


def test_time_grows_with_length_alone():
    for piece, close in (("<div>", "</div>"), ("<div id='related'>", ""), ("<b>", ""), ("<article>", ""), ("<ul><li>", ""), ("<span><p>", "</section>")):
        start = time.process_time()
        html.main_text(piece * 30_000 + "x" + close * 30_000)
        assert time.process_time() - start < 8, piece


def test_hosts_that_share_a_name_of_salts(spark):
    pages = spark.createDataFrame([*site(12), *site(12, "OTHER.example:80")], KIND)
    broad = sorted(map(tuple, html.extract(pages).collect()))
    assert broad == sorted(map(tuple, html.extract(pages, broadcast_rows=0, salts=3).collect()))


def test_copies_of_one_article_stay(spark):
    copies = [(i, "http://c.example/", "<article><h1>One</h1><p>Same text</p></article>") for i in range(30)]
    near = [(100 + i, "http://n.example/", f"<div class=x>{i}</div><article><h1>One</h1><p>Same text</p></article>") for i in range(30)]
    assert {r["text"] for r in html.extract(spark.createDataFrame([*copies, *near], KIND)).collect()} == {"One\nSame text"}


def test_copies_of_a_page_count_once(spark):
    def page(i, items):
        mid = f"<h1>List {i}</h1><ul>{''.join(f'<li>item {i} {k}' for k in range(items))}</ul><p>Text of list {i}.</p>"
        return f"<body><div class=top>Our site, est. 1990</div><div class=mid>{mid}</div><div class=end><p>Read more here</p></div></body>"

    def text(i, items):
        return "\n".join([f"List {i}", *(f"item {i} {k}" for k in range(items)), f"Text of list {i}."])

    alone = [*site(10), *((100 + i, f"http://h.example/{i}", page(1, 2)) for i in range(20))]
    with_another = [*site(10, "i.example"), (300, "http://i.example/", page(3, 1)), *((200 + i, f"http://i.example/{i}", page(2, 10)) for i in range(50))]
    table = spark.createDataFrame([*alone, *with_another], KIND)
    got = [(r["page_id"], r["text"]) for r in html.extract(table).collect()]
    assert {t for i, t in got if 100 <= i < 120} == {text(1, 2)}
    assert {t for i, t in got if 200 <= i < 250} == {text(2, 10)}
    assert dict(got)[300] == text(3, 1) and (3, "Title 3\nText number 3 of many.") in got
    tree = html.style_tree(table).where(F.col("h") != html.EVERYWHERE)
    assert sorted(r[0] for r in tree.select("h", "different").distinct().select("different").collect()) == [11, 12]


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (2, "no url", "<p>x"), (None, "http://h/", ""), (3, "http://h/", "<p>" + "long " * 100_000)]
    table = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("host", "noise", "text", "n", "salt", "path")})
    got = sorted(map(tuple, html.extract(table).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (2, "no url", "x", 1), (None, "http://h/", "", 0), (3, "http://h/", ("long " * 100_000).strip(), 499_999)], key=repr)
    assert html.extract(table.limit(0)).count() == 0


def test_every_page_of_the_table(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op8_site_style_tree"](spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d)>", article)]
        text = "\n".join(b for b in blocks if b)
        assert (got[page["page_id"]]["text"], got[page["page_id"]]["n_chars"]) == (text, len(text))
