"""Main text of HTML pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, in full to the parent and to the
nearest ``article`` or ``main``, and less further up; a container's points are discounted by its link
density. The best container is kept, with the siblings that score well beside it, and its blocks become
the text, without those that hold nothing but links. Each page is a row of its own, so a task holds one
Arrow batch of pages; nothing is shuffled.

A ``header`` is boilerplate outside an ``article``, but for one in ``main`` that holds the ``h1``. A
``form`` is boilerplate unless it frames the page: it stands right under ``body`` and holds an
``article``, a ``main`` or paragraphs of ``FRAME_CHARS`` characters.

Defined results: a null or empty page, and one without text outside boilerplate, gives the empty text.
Markup may be unclosed, nested wrongly, upper case or cut off at any place. Character references are
decoded; white space inside a block becomes one space; blocks are joined in page order by one space.
Repeated rows give equal results, an empty table none. Columns other than those named stay unseen.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text of the page; it ends at its own end tag only.
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes object canvas audio video select datalist".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
BOILERPLATE = frozenset("nav aside form menu footer dialog button fieldset head".split())
#: An opening tag of the key's group closes an open one of its values, up to a boundary.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table body html article section main".split())
CLOSES_P = BLOCKS - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: Words of class, id and role that mark boilerplate, and those that mark content.
BAD = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|sidebar|side|aside|footer|foot|masthead|breadcrumbs?|comments?|disqus|respond|cookies?|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|search|alert|contentinfo|complementary|skip)(?:$|[^a-z])")
HEADER = re.compile(r"(?:^|[^a-z])(?:site|page|top|global|main)[-_]?header(?:$|[^a-z])|(?:^|\s)header(?:$|\s)")
GOOD = re.compile(r"(?:^|[^a-z])(?:article|post|entry|content|story|main|body|text|blog)(?:$|[^a-z])")
#: Words that begin so mark readers' comments: comments, commentlist, comment-form; a commentary is an article's.
COMMENTS = re.compile(r"(?:^|[^a-z])comment(?!ar|at)")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
LOOSE_TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: Points: at least so long, one for each so many characters up to a most, siblings from a share of the best.
MIN_CHARS, CHARS_A_POINT, MOST_POINTS, SIBLING_SHARE = 25, 100, 3, 0.2
MEANT = {"article": 25.0, "main": 20.0}
#: Characters in paragraphs that make a form the frame of its page.
FRAME_CHARS = 140
#: Blocks that go when they hold so many links or more, and outside headings so large a share of their text is links.
LINK_BLOCKS, LINK_COUNT, LINK_SHARE = frozenset("div section ul ol dl table".split()), 2, 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("name", "parent", "children", "bad", "bonus", "score", "chars", "link_chars", "head_chars", "links")

    def __init__(self, name: str, parent: Node | None, bad: bool = False, bonus: float = 0.0):
        self.name, self.parent, self.children, self.bad, self.bonus = name, parent, [], bad, bonus
        self.score = self.chars = self.link_chars = self.head_chars = self.links = 0
        if parent is not None:
            parent.children.append(self)


def _judged(name: str, attrs: str, inside_article: bool) -> tuple[bool, float]:
    """Whether an element is boilerplate, and what its name and attributes add to its score."""
    bonus = MEANT.get(name, 0.0)
    if name in BOILERPLATE or name == "header" and not inside_article:
        return True, 0.0
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, bonus
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "").lower()):
        return True, 0.0
    says = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    if says.strip():
        if name not in ("html", "body", "article", "main") and not GOOD.search(says) and (BAD.search(says) or HEADER.search(says) and not inside_article):
            return True, 0.0
        if COMMENTS.search(says) and name not in ("html", "body"):
            return True, 0.0
        if GOOD.search(says):
            bonus += 10.0
    return False, bonus


def parse(page: str) -> Node:
    """The page's tree; children are nodes and undecoded strings."""
    root = Node("html", None)
    at, here, open_names, articles = 0, root, {"html": 1}, 0
    headers: list[Node] = []  # open ones in main
    forms: list[Node] = []  # right under body
    n = len(page)

    def leave(node: Node) -> None:
        nonlocal here, articles
        while True:
            open_names[here.name] -= 1
            articles -= here.name == "article"
            if headers and headers[-1] is here:
                headers.pop()
            done = here is node
            here = here.parent
            if done:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(page[at:])
            break
        if lt > at:
            here.children.append(page[at:lt])
        m = MARK.match(page, lt) or LOOSE_TAG.match(page, lt)
        if m is None:  # a bare "<" is text
            here.children.append("<")
            at = lt + 1
            continue
        at = m.end()
        groups = m.groupdict()
        if groups.get("cdata") is not None:
            here.children.append(groups["cdata"])
        name = (groups["name"] or "").lower()
        if not name:
            continue
        if groups["close"]:
            if name == "p" and not open_names.get("p"):
                continue
            if open_names.get(name) and name not in ("html", "body"):
                node = here
                while node.name != name and not (node.name in ("article", "main") and name not in BLOCKS):
                    node = node.parent
                if node.name == name and node is not root:
                    leave(node)
            continue
        if name in RAW:
            if not groups["attrs"].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in ("html", "body") and open_names.get(name):
            continue
        if name in CLOSES_P and open_names.get("p"):
            node = here
            while node.name != "p" and node.name not in BOUNDARY:
                node = node.parent
            if node.name == "p":
                leave(node)
        if name in CLOSED_BY:
            node = here
            while node is not root and node.name not in CLOSED_BY[name] and node.name not in BOUNDARY:
                node = node.parent
            if node.name in CLOSED_BY[name]:
                if name == "tr":
                    while node.name != "tr" and node.parent.name not in BOUNDARY:
                        node = node.parent
                leave(node)
        bad, bonus = _judged(name, groups["attrs"], articles > 0)
        node = Node(name, here, bad, bonus)
        if name == "h1":
            for x in headers:
                x.bad = False
            headers.clear()
        elif name == "form" and here.name in ("html", "body"):
            forms.append(node)
        if name not in VOID and not groups["attrs"].endswith("/"):
            here = node
            open_names[name] = open_names.get(name, 0) + 1
            articles += name == "article"
            if name == "header" and open_names.get("main") and not articles:
                headers.append(node)
    for form in forms:
        if form.bad and _frames(form):
            form.bad = False
    return root


def _frames(form: Node) -> bool:
    """Whether a form holds the page's content."""
    chars, stack = 0, [(form, False)]
    while stack:
        node, paragraph = stack.pop()
        for x in node.children:
            if isinstance(x, str):
                chars += len(x.strip()) if paragraph else 0
            elif x.name in MEANT and not x.bad:
                return True
            elif not x.bad and x.name != "a":
                stack.append((x, paragraph or x.name == "p"))
        if chars >= FRAME_CHARS:
            return True
    return False


def _in_order(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Strings and nodes outside boilerplate in page order; nodes twice, the second time (True) when they end."""
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        x, ends = stack.pop()
        yield x, ends
        if isinstance(x, Node) and not ends and not x.bad:
            stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))


def score(root: Node) -> list[Node]:
    """Give each node its points; the nodes that have any, in page order."""
    links = 0
    scored: dict[int, Node] = {}
    text: dict[int, list] = {}  # a paragraph's characters and commas
    open_nodes: list[Node] = []
    open_meant: list[Node] = []
    for x, ends in _in_order(root):
        if isinstance(x, str):
            size = len(x.strip())
            if size:
                for p in open_nodes[-1:]:
                    p.chars += size
                    p.link_chars += size if links else 0
                    t = text.setdefault(id(p), [0, 0])
                    t[0], t[1] = t[0] + size, t[1] + x.count(",") + x.count("，") + x.count("、")
        elif x.bad:
            continue
        elif not ends:
            links += x.name == "a"
            if x.bonus:
                x.score += x.bonus
                scored[id(x)] = x
            open_nodes.append(x)
            if x.name in MEANT:
                open_meant.append(x)
        else:
            links -= x.name == "a"
            open_nodes.pop()
            parent = x.parent
            t = text.pop(id(x), None)
            if parent is not None:
                parent.chars += x.chars
                parent.link_chars += x.link_chars
                parent.links += x.links + (x.name == "a")
                parent.head_chars += x.chars if x.name in HEADINGS else x.head_chars
            if t and x.name not in BLOCKS and parent is not None:  # inline: its text is its block's
                u = text.setdefault(id(parent), [0, 0])
                u[0], u[1] = u[0] + t[0], u[1] + t[1]
            elif t and t[0] >= MIN_CHARS and (x.name in PARAGRAPHS or x.name in ("div", "section", "article", "main")):
                points = 1 + t[1] + min(t[0] / CHARS_A_POINT, MOST_POINTS)
                up, level, meant = (parent if x.name in PARAGRAPHS else x), 0, open_meant[-1] if open_meant else None
                while up is not None and level < 4:
                    if up is not meant:
                        up.score += points / (1, 2, 6, 9)[level]
                        scored[id(up)] = up
                    up, level = up.parent, level + 1
                if meant is not None:
                    meant.score += points
                    scored[id(meant)] = meant
            if x.name in MEANT:
                open_meant.pop()
    return list(scored.values())


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def kept_nodes(root: Node) -> list[Node]:
    """The best container and what is kept beside it, in page order."""
    found = score(root)
    if not found:
        return [root]
    worth = {id(x): x.score * (1 - _density(x)) for x in found}
    best = max(found, key=lambda x: worth[id(x)])
    if best.parent is None:
        return [best]
    least = worth[id(best)] * SIBLING_SHARE

    def stays(x: Node) -> bool:
        if x is best or x.bad:
            return x is best
        if worth.get(id(x), 0.0) >= least or best.name in MEANT and x.name == best.name:
            return True
        if best.name in MEANT:  # what stands outside it needs points of its own
            return False
        return x.name in PARAGRAPHS | {"h1", "h2", "h3"} and x.chars > 0 and _density(x) < 0.25 and (x.chars >= 80 or x.name in HEADINGS)

    kept = [x for x in best.parent.children if isinstance(x, Node) and stays(x)]
    title = _title_before(root, kept)
    return [title, *kept] if title else kept


def _title_before(root: Node, kept: list[Node]) -> Node | None:
    """The page's only h1 outside boilerplate, if it stands before what is kept."""
    first, before, all_of = kept[0], [], 0
    met = False
    for x, ends in _in_order(root):
        met |= x is first
        if isinstance(x, Node) and x.name == "h1" and not ends and not x.bad:
            all_of += 1
            if not met:
                before.append(x)
    return before[0] if all_of == 1 and before else None


def _only_links(x: Node) -> bool:
    return x.name in LINK_BLOCKS and x.links >= LINK_COUNT and x.link_chars >= LINK_SHARE * (x.chars - x.head_chars)


def text_of(nodes: list[Node]) -> str:
    blocks, inline = [], []

    def end_block() -> None:
        if inline:
            blocks.extend(html.unescape("".join(inline)).split())
            inline.clear()

    for root in nodes:
        end_block()
        for x, _ in _in_order(root):
            if isinstance(x, str):
                inline.append(x)
                continue
            if x is not root and _only_links(x):
                x.bad = True  # its inside isn't met
            if x.name in BLOCKS or x.bad:
                end_block()
    end_block()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(kept_nodes(parse(page))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
