"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: pages meet in a node if they have an element of the same name and class
under the same ancestors. A node has two kinds of importance, both from entropies over the host's pages: that of its
presentations (the sequences of its children: an article is written anew on each page, a template is not) and that of its
contents (a content that most pages repeat tells nothing). What is neither of varied presentation nor inside or around such
a node is template, and is cut from each page; so is what most pages repeat. Hosts of few pages are judged by the tree of all
hosts together.

Names (nav, footer, a class of `advert`, an article element) are a prior on top of that, for what varies as an article does
without being part of it: reader comments, adverts between paragraphs. extract(names=False) goes without it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_arrow, staged

# Fixed values of the format: elements without content, with raw text, that begin a block, that show no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head script style title noscript template textarea iframe noembed noframes xmp svg canvas object audio video select option button datalist".split())
#: Elements and roles that aren't the article, wherever they stand; `header` only where it isn't inside an article.
ASIDE = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that say the same, and beginnings of such words.
SAYS = frozenset("ad ads adv advert promo promos promotion menu menus nav breadcrumb breadcrumbs banner banners notice notices alert alerts paywall popup modal overlay cookie cookies consent gdpr toolbar pagination pager widget widgets related recommended subscribe signup login search form copyright disclaimer masthead respond reply replies skip topbar".split())
BEGINS = re.compile(r"(?:advert|adsby|adbanner|adbox|adslot|adunit|sponsor|comment|disqus|sidebar|navbar|navigation|footer|newsletter|social|sharing|cookie|breadcrumb)|share(?:d|s)?$|header$|aside$")
#: Inside an article a name tells only of elements that hold others; of the rest only by words that an article has no use
#: for, in a class. Headings are never cut by their names, and an id that is made from a heading's text says nothing.
HOLDERS = frozenset("article main aside div ol section ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLEAR = re.compile(r"(?:ads|adv|paywall|popup|gdpr|pagination|pager|signup|masthead|topbar)$|advert|adsby|adbanner|adbox|adslot|adunit|sponsor|disqus|navbar|newsletter|breadcrumb")
COMMENT = re.compile(r"comments?(?:[-_]?\d+)?", re.I)
LETTERS = re.compile(r"[\W\d_]+")
#: Open elements that a start tag closes: itself or its kin, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What holds the whole page; varied children of these don't make all of them important.
ROOTS = frozenset(("#", "html", "body"))
BOUNDS = frozenset("html body article main section div table td th button object".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|[\"'][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("cut", "gone", "good", "heading", "holds", "id", "inside", "kids", "name", "named", "parent", "path", "shown", "top")

    def __init__(self, name, parent, label, cut, shown):
        self.name, self.parent, self.cut, self.shown, self.kids = name, parent, cut, shown, []
        self.gone = self.good = self.holds = False
        #: Hash of the labels from the root on: the node of the style tree.
        self.path = xxhash.xxh3_64_intdigest(label, seed=parent.path if parent else 0) >> 1
        #: The article or main element that this is or is in.
        self.inside = self if name in ("article", "main") else parent.inside if parent else None
        #: The element right under the body that this is or is in, and whether a heading is it or holds it.
        self.top = None if name in ROOTS else self if parent.name in ROOTS else parent.top
        self.heading = name in HEADINGS or parent is not None and parent.heading
        #: The nearest element, this or above, that is cut for its id only.
        self.named = parent.named if parent else None
        if parent:
            parent.kids.append(self.path)


def says(text: str, in_article: bool) -> bool:
    """Whether a class or an id has a word that names what is not the article; an article may have a header."""
    return any(w in SAYS or BEGINS.match(w) and not (w == "header" and in_article) for w in map(str.lower, WORDS.findall(text)))


def looks(name: str, text: str, in_article: bool) -> tuple[str, bool, str]:
    """What a start tag's attributes say: the label of its node, whether it can't be part of the article, and the id if
    that is all that says so and may be made from a heading."""
    cut = name in ASIDE or name == "header" and not in_article
    if "=" not in text and "hidden" not in text:
        return name, cut, ""
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}
    class_, id_ = at.get("class", ""), at.get("id", "")
    label = f"{name} {DIGITS.sub('0', class_)} {DIGITS.sub('0', id_)}"
    if name in ("html", "body", "article", "main"):
        if "comment" not in label:
            return label, cut, ""
        id_ = id_ if COMMENT.fullmatch(id_) else ""  # else the page's own title or the like
    style = at.get("style", "").replace(" ", "").lower()
    cut = cut or "hidden" in at or at.get("role", "").lower() in ROLES or "display:none" in style or at.get("aria-hidden") == "true"
    if cut or name in HEADINGS:
        return label, cut, ""
    if in_article and name not in HOLDERS:
        return label, any(CLEAR.match(w.lower()) for w in WORDS.findall(class_)), ""
    if says(class_, in_article):
        return label, True, ""
    if says(id_, in_article) and not (in_article and name == "section"):
        return label, True, id_ if in_article else ""
    return label, False, ""


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements, and the blocks of text with the element that each stands in, in page order. Unclosed tags are closed."""
    root = Node("#", None, "#", False, True)
    nodes, stack, blocks, text, at, n = [root], [root], [], [], 0, len(html)
    named: list[Node] = []
    standing: dict[str, int] = {}  # how many elements of a name are open: no search for one that isn't

    def flush():
        if text:
            if block := " ".join(unescape("".join(text)).split()):
                blocks.append((stack[-1], block))
            text.clear()

    def pop_to(names, bounds):
        if not any(standing.get(name) for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                if any(s.name in BLOCK for s in stack[i:]):
                    flush()
                for s in stack[i:]:
                    standing[s.name] -= 1
                del stack[i:]
                return
            if stack[i].name in bounds:
                return

    while at < n:
        m = TAG.search(html, at)
        if not m:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                text.append(" ")
            elif name in BLOCK:
                flush()
                pop_to({name}, {"html"} if name in ("article", "main", "body") else {"article", "main", "body"})
            else:
                pop_to({name}, BLOCK)
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            flush()
            pop_to({"p"}, BOUNDS)
            if name in CLOSES:
                pop_to(*CLOSES[name])
        if name in VOID:
            continue
        parent = stack[-1]
        label, cut, id_ = looks(name, m[3], parent.inside is not None)
        node = Node(name, parent, label, cut, parent.shown and name not in HIDDEN)
        nodes.append(node)
        if id_:
            node.id, node.named = id_, node
            named.append(node)
        if name in ("article", "main") and not cut:
            for above in reversed(stack):  # what holds the article is no aside, whatever its class says
                if above.holds:
                    break
                above.holds = True
                above.cut = above.cut and (above.name in ASIDE and above.name != "form" or above.inside is not None)
        if name in ("annotation", "annotation-xml") and not m[3].endswith("/") and standing.get("math"):
            close = re.compile(f"</({name}|math)(?=[\\s/>]|\\Z)", re.I).search(html, at)
            if close and close[1].lower() == name and (end := html.find(">", close.end())) >= 0:
                at = end + 1  # a formula's source, not its text
        elif name in RAW:
            close = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(html, at)
            at = close.start() if close else n
            if close and (end := html.find(">", at)) >= 0:
                at = end + 1
            elif close:
                at = n
        elif not m[3].endswith("/") or name in BLOCK:
            stack.append(node)
            standing[name] = standing.get(name, 0) + 1
    flush()
    if named:
        spare(named, blocks)
    return nodes, blocks


def spare(named: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Let be what is cut for an id only, if its first heading's text makes that id."""
    left = set(map(id, named))
    for at, block in blocks:
        if at.heading and at.named:
            slug, x = LETTERS.sub("", block.lower()), at.named
            while x and id(x) in left:  # what is above one that has had its first heading has had its own
                left.discard(id(x))
                if LETTERS.sub("", x.id.lower()) == slug:
                    x.cut = False
                x = x.parent.named


def visible(nodes: list[Node], blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Blocks that no name rules out; if the page marks its article, those inside it.

    Inside a main element articles are the article only if they hold half of its text or more: they may be teasers.
    """
    for x in nodes:  # parents come first
        x.gone = x.cut or x.parent is not None and x.parent.gone
    kept = [(node, block) for node, block in blocks if node.shown and not node.gone]
    inside = [x for x in kept if x[0].inside]
    articles = [x for x in inside if x[0].inside.name == "article"]
    length = lambda some: sum(len(block) for _, block in some)
    return (articles if articles and 2 * length(articles) >= length(inside) else inside) or kept


#: What a tree says of a node: its presentation is a template's, or varied; its contents are those of most pages.
FIXED, VARIED, REPEATED = 1, 2, 3


def by_tree(nodes: list[Node], blocks: list[tuple[Node, str]], own: dict[int, int], common: dict[int, int]) -> list[tuple[Node, str]]:
    """Blocks that the host's own tree leaves, or where it says nothing that of all hosts: what is FIXED goes unless a VARIED node is in it or around it, what is REPEATED goes.

    A node that no tree knows goes with what it is in. The roots stay, and so does a heading beside what is VARIED.
    """
    said = [0 if x.name in ROOTS else own.get(x.path) or common.get(x.path, 0) for x in nodes]
    for x, sign in zip(reversed(nodes), reversed(said), strict=True):
        x.good = x.good or sign == VARIED
        if x.good and x.parent:
            x.parent.good = True
    around = {}
    for x, sign in zip(nodes, said, strict=True):
        above = x.parent is not None and around[id(x.parent)]
        around[id(x)] = above or sign == VARIED
        spared = above or x.good or x.name in HEADINGS and x.parent.good
        x.gone = x.parent is not None and x.parent.gone or sign == REPEATED or sign == FIXED and not spared
    return [(node, block) for node, block in blocks if node.shown and not node.gone]


def main_text(html: str, own: dict[int, int] | None = None, common: dict[int, int] | None = None, names: bool = True) -> str:
    """The article of a page: its blocks, less what the style trees say is template, less what names rule out.

    A tree that would leave nothing has nothing to tell the article from (all pages repeat it) and is ignored.
    """
    nodes, blocks = parse(html)
    kept = by_tree(nodes, blocks, own or {}, common or {}) or blocks
    if names:
        kept = visible(nodes, kept) or visible(nodes, blocks)
    return "\n".join(block for node, block in kept if node.shown)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


#: The tree of all hosts together has a host of this hash, and the nodes that are on this share of all pages.
EVERYWHERE, SHARE = 0, 0.001


def host_hash(url: Column) -> Column:
    h = F.xxhash64(host_of(url))
    return F.when(h == EVERYWHERE, 1).otherwise(h)


def style_tree(pages: DataFrame) -> DataFrame:
    """(h, path, pages, different, presentation, content) of the nodes of each host's tree (h is the host's hash), from all pages.

    pages counts the host's different pages that have the node, different all of its different pages. presentation is the
    entropy of the node's sequences of children, a sequence counting once a page, over the log of their number: 0 if all pages
    have the same one, 1 if each has its own. Right under a root, how often a page has the node counts too, if that is more.
    content is one less the mean log of the number of pages that have a block, over the log of pages: 1 if no block of the node
    (right under a root: of its branches too) comes twice, 0 if all pages have them all; null for nodes without blocks.
    Equal pages of a host count once, however often they come. The tree of all hosts (h is EVERYWHERE) has no content.
    """

    def run(batches):
        for b in batches:
            rows = []
            for h, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes, blocks = parse(html or "")
                page, met, seen = xxhash.xxh3_64_intdigest(html or "") >> 1, set(), {(0, 0, 0): 1}
                for x in nodes:
                    if x.shown:
                        seen.setdefault((x.path, 1, hash(tuple(x.kids))), int(x.path not in met))
                        met.add(x.path)
                for x in nodes:
                    if x.name in ROOTS:
                        for path, n in Counter(x.kids).items():
                            if path in met:
                                seen[path, 3, n] = 0
                for x, block in blocks:
                    if x.shown:
                        value = xxhash.xxh3_64_intdigest(block) >> 1
                        seen[x.path, 2, value] = 0
                        if x.top:
                            seen[x.top.path, 2, value] = 0
                rows += [(h, page, *x, first) for x, first in seen.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "page", "path", "kind", "value", "first"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int8()]
    told = map_arrow(pages.select(host_hash(F.col("url")).alias("h"), "html"), run, "h long, page long, path long, kind byte, value long, first byte")
    once = told.groupBy("h", "path", "kind", "value", "page").agg(F.max("first").alias("first"))
    by_value = once.groupBy("h", "path", "kind", "value").agg(F.count("*").alias("k"), F.sum("first").alias("first"))
    by_value = staged(by_value)  # each page is parsed once for the trees, once for its text
    everywhere = by_value.where("kind != 2").groupBy("path", "kind", "value").agg(F.sum("k").alias("k"), F.sum("first").alias("first")).select(F.lit(EVERYWHERE).cast("long").alias("h"), "path", "kind", "value", "k", "first")
    logs = F.col("k") * F.log("k")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    by_node = (
        by_value.unionByName(everywhere)
        .groupBy("h", "path")
        .agg(F.sum(of(1, F.col("first"))).alias("pages"), *[F.sum(of(kind, x)).alias(f"{name}_{kind}") for kind in (1, 3) for name, x in (("n", F.col("k")), ("logs", logs))], F.avg(of(2, F.log("k"))).alias("content_logs"), F.sum(of(0, F.col("k"))).alias("different"))
    )
    hosts = by_node.where("path = 0").select("h", "different")
    entropy = lambda kind: F.when(F.col(f"n_{kind}") > 1, 1 - F.col(f"logs_{kind}") / F.col(f"n_{kind}") / F.log(f"n_{kind}")).otherwise(0.0)
    content = F.when(F.col("content_logs").isNotNull(), F.when(F.col("pages") > 1, 1 - F.least(F.lit(1.0), F.col("content_logs") / F.log("pages"))).otherwise(1.0))
    return by_node.where("path != 0 AND pages > 0").drop("different").join(hosts, "h").select("h", "path", "pages", "different", F.greatest(F.lit(0.0), entropy(1), entropy(3)).alias("presentation"), content.alias("content"))


def signs_of(tree: DataFrame, varied: float, repeated: float, least_pages: int, enough_pages: int) -> DataFrame:
    """(h, path, sign) of the nodes of which their host's tree says anything.

    On least_pages pages or more a content under `repeated` is REPEATED. On enough_pages or more a presentation of `varied` of
    the host's most varied one is VARIED, and less is FIXED; nothing is where all of them are 0. Of all hosts together only nodes
    on SHARE of all pages count: no more than the mean number of a page's nodes, divided by SHARE.
    """
    least = F.when(F.col("h") == EVERYWHERE, F.greatest(F.lit(least_pages), SHARE * F.col("different"))).otherwise(least_pages)
    rows = tree.where((F.col("different") >= least_pages) & (F.col("pages") >= least))
    many = F.col("pages") >= enough_pages
    most = rows.where(many).groupBy("h").agg(F.max("presentation").alias("most")).where("most > 0")
    sign = F.when(F.col("content") < repeated, REPEATED).when(many & (F.col("presentation") >= varied * F.col("most")), VARIED).when(many & F.col("most").isNotNull(), FIXED)
    return rows.join(most, "h", "left").select("h", "path", sign.cast("byte").alias("sign")).where("sign IS NOT NULL")


def extract(pages: DataFrame, varied: float = 0.5, repeated: float = 0.15, least_pages: int = 8, enough_pages: int = 20, names: bool = True, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its main text, empty if it has none.

    Where a host's own tree says nothing of a node (it needs least_pages different pages for contents and enough_pages for
    presentations) the tree of all hosts does; where that says nothing either, names alone decide. A null html is empty, a null url is a host of its own; repeated rows give equal rows; other columns are
    ignored; an empty table gives no rows. What the hosts' trees say is broadcast once if it has at most broadcast_rows rows;
    beyond that it meets the pages by host and salt, so that a large host is many tasks, and a task holds one host's at a time.
    """
    signs = staged(signs_of(style_tree(pages), varied, repeated, least_pages, enough_pages))
    common = dict(signs.where(F.col("h") == EVERYWHERE).select("path", "sign").collect())
    own = signs.where(F.col("h") != EVERYWHERE)
    rows = pages.select(host_hash(F.col("url")).alias("h"), "page_id", "url", "html")
    session = pages.sparkSession.sparkContext
    out = ["page_id", "url", "text", "n_chars"]
    kind = "page_id long, url string, text string, n_chars long"

    if own.count() <= broadcast_rows:
        by_host: dict[int, dict[int, int]] = {}
        for h, path, sign in own.collect():
            by_host.setdefault(h, {})[path] = sign
        held = session.broadcast((by_host, common))

        def run(batches):
            own, common = held.value
            for b in batches:
                text = [main_text(html or "", own.get(h), common, names) for h, html in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], out)

        return map_arrow(rows, run, kind)

    held = session.broadcast(common)
    salted = rows.select("h", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).alias("salt"), F.lit(None).cast("long").alias("path"), F.lit(None).cast("byte").alias("sign"), "page_id", "url", "html")
    beside = own.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "path", "sign", *[F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))])
    dealt = salted.unionByName(beside).repartition("h", "salt").sortWithinPartitions("h", "salt", F.col("path").isNull())

    def run_dealt(batches):
        at, known = None, {}
        for b in batches:
            found = []
            for h, path, sign, page_id, url, html in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)], strict=True):
                if h != at:
                    at, known = h, {}
                if path is None:
                    text = main_text(html or "", known, held.value, names)
                    found.append((page_id, url, text, len(text)))
                else:
                    known[path] = sign
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], out)

    return map_arrow(dealt, run_dealt, kind)
