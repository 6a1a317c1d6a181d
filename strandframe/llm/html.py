"""HTML main-text extraction by tree scoring.

The page is parsed leniently into a tree. Paragraphs pass points to their ancestors - one, one
more for each comma, and up to three for length - in full to the parent, half to the next, then
less; a container's score is discounted by its link density. The best container is kept with
those siblings that score near it, or that are text with few links. Menus, headers, footers,
asides, forms, scripts, styles, notices, adverts and reader comments are taken out first, by
element and by the words in class, id and role.

Text: character references are decoded in each stretch between tags, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline. A quote opens a value only after `=`; a tag that
the page's end cuts off has no text. Null, empty and text-less pages give an empty
text. Broken and truncated markup is closed at the end of the page; nesting of any depth is
walked without recursion. Repeated rows give the same text. The whole page is read.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import small

#: An attribute: a name, and after `=` a quoted value or one that white space or `>` ends. A quote elsewhere opens nothing.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+))?+)?+""")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85   -     　]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption br".split()
)
_CLOSES_P = _BLOCK - {"br", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
_OUT = frozenset("nav header footer aside form script style noscript iframe button select input option textarea template svg canvas object embed head title dialog menu label fieldset audio video map math search".split())
_SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|menu\w*|nav|navbar|navigation|breadcrumb\w*|topbar|toolbar|foot\w*|copyright|masthead|site-?header|page-?header|cookie\w*|consent|gdpr|notice\w*|alert|popup\w*|modal|overlay|newsletter|subscri\w*|signup|login|comment\w*|disqus\w*|respond|replies|reply|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|more-?links|widget\w*|pagination|pager|skip\w*|hidden|form|search\w*|tags?|tagcloud|teaser\w*|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main|page|post\w*|story|text|blog|hentry)(?=$|[\s_-])", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_KEEPS = frozenset(("article", "main", "body", "html"))


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "bonus", "score", "size", "links", "commas")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, bonus: float = 0.0):
        self.tag, self.parent, self.out, self.bonus = tag, parent, out, bonus
        self.kids: list = []
        self.score = 0.0
        self.size = self.links = self.commas = 0


def _judge(tag: str, attrs: str) -> tuple[bool, float]:
    """Whether an element is taken out, and its bonus."""
    out, bonus = tag in _OUT, {"article": 25.0, "main": 20.0, "section": 2.0, "div": 2.0, "td": 1.0}.get(tag, 0.0)
    if attrs and not attrs.isspace():
        seen = set()
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), entities.unescape(a or b or c)
            if name in seen:
                continue  # the first of a name counts
            seen.add(name)
            if name == "role":
                out |= value.strip().lower() in _BAD_ROLE
                bonus += 20 * (value.strip().lower() in ("main", "article"))
            elif name == "style":
                out |= bool(_HIDES.search(value))
            elif name == "hidden":
                out = True
            elif name == "aria-hidden":
                out |= value.strip().lower() == "true"
            elif name in ("class", "id"):
                if _BAD.search(value) and tag not in _KEEPS:
                    out = True
                elif _GOOD.search(value):
                    bonus += 10
            elif name == "itemprop" and "articlebody" in value.lower():
                bonus += 25
    return out, bonus


def parse(page: str) -> Node:
    """A tree of nodes and strings; what has no end tag ends where its container does."""
    root = at = Node("html", None)
    pos, end = 0, len(page)
    find = _TOKEN.search
    while pos < end:
        m = find(page, pos)
        if m is None:
            at.kids.append(entities.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.kids.append(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                at.kids.append(Node("br", at))
                continue
            node = at
            while node is not None and node.tag != tag:
                # an inline end tag does not close blocks around it
                node = None if node.tag in _BLOCK and tag not in _BLOCK else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in ("html", "body") and at is root or tag == "html":
            if tag == "body":
                at = Node("body", root, False, 0.0)
                root.kids.append(at)
            continue
        if tag in _CLOSES_P:
            node = at
            while node is not None and node.tag != "p":
                node = node.parent if node.tag not in _BLOCK else None
            if node is not None:
                at = node.parent
        if tag in _SIBLING_ENDS:
            node, ends, scope = at, _SIBLING_ENDS[tag], _SCOPE[tag]
            while node is not None and node.tag not in ends:
                node = None if node.tag in scope else node.parent
            if node is not None:
                at = node.parent
                if tag == "tr" and node.tag in ("td", "th"):
                    up = node.parent
                    while up is not None and up.tag not in ("tr", "table"):
                        up = up.parent
                    if up is not None and up.tag == "tr":
                        at = up.parent
        out, bonus = _judge(tag, m[3])
        if tag in ("article", "main") and not out:
            up = at  # a wrapper named after its sidebar or its menu is no such thing
            while up is not None:
                up.out &= up.tag in _OUT
                up = up.parent
        node = Node(tag, at, out, bonus)
        at.kids.append(node)
        if tag in _RAW:
            low = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            if tag == "textarea" or tag == "title":
                node.kids.append(page[pos : low.start() if low else end])
            pos = low.end() if low else end
        elif tag not in _VOID and not (m[3].endswith("/") and tag in ("path", "g")):
            at = node
    return root


def _walk(root: Node):
    """Nodes that are kept, each after its container."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if type(k) is not str and not k.out)


def _measure(root: Node) -> list[Node]:
    """Text length, length within links and commas of each kept node, own and below."""
    order = list(_walk(root))
    for node in order:
        for k in node.kids:
            if type(k) is str:
                text = k.strip()
                node.size += len(text)
                node.commas += text.count(",") + text.count("、") + text.count("，")
    for node in reversed(order):
        if node.tag == "a":
            node.links = node.size
        if (up := node.parent) is not None:
            up.size += node.size
            up.commas += node.commas
            up.links += node.links
    return order


_PARAGRAPH = frozenset(("p", "pre", "blockquote", "td", "li", "dd", "h2", "h3"))


def _points(node: Node) -> float:
    return 1 + node.commas + min(node.size / 100, 3)


def best_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that go with it, in page order."""
    order = _measure(root)
    for node in order:
        own = sum(len(k.strip()) for k in node.kids if type(k) is str)
        if node.tag in _PARAGRAPH and node.size or (node.tag in ("div", "section", "article", "main", "body") and own >= 25):
            points, share = _points(node), 1.0
            up = node.parent if node.tag in _PARAGRAPH else node
            for share in (1.0, 0.5, 1 / 6, 1 / 9):
                if up is None:
                    break
                up.score += points * share
                up = up.parent
    live = [n for n in order if n.score]
    if not live:
        return [root] if root.size else []
    value = {id(n): (n.score + n.bonus) * (1 - n.links / n.size if n.size else 0) for n in live}
    top = max(live, key=lambda n: value[id(n)])
    # a list, row or paragraph container stands for the block around it
    while top.parent is not None and top.tag in ("p", "ul", "ol", "tr", "tbody", "li", "td", "blockquote", "dl", "hgroup"):
        top = top.parent
    limit = max(10.0, 0.2 * value.get(id(top), 0.0))
    if top.parent is None:
        return [top]
    kept = []
    for k in top.parent.kids:
        if type(k) is str or k.out:
            continue
        density = k.links / k.size if k.size else 1.0
        if k is top or value.get(id(k), 0.0) >= limit or (k.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol") and k.size and density < 0.25 and (k.size > 80 or k.tag in ("h1", "h2", "h3"))):
            kept.append(k)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block below the nodes, in page order."""
    found: list[str] = []
    run: list[str] = []

    def cut():
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            found.append(text)

    for top in nodes:
        todo: list = [top]
        while todo:
            k = todo.pop()
            if type(k) is str:
                run.append(k)
            elif k is None:
                cut()
            elif not k.out:
                if k.tag in _BLOCK:
                    cut()
                    todo.append(None)
                todo.extend(reversed(k.kids))
        cut()
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(best_nodes(parse(page))))


def extract(df: DataFrame, key: str, html: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry, text, n_chars of each row."""
    cols = df.select(F.col(key).alias("key"), F.col(html).alias("html"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    schema = ", ".join(["key " + df.schema[key].dataType.simpleString(), *[f"carry_{c} {df.schema[c].dataType.simpleString()}" for c in carry], "text string", "n_chars long"])

    def run(batches):
        for batch in small(batches):
            texts = [main_text(h) for h in batch.column(1).to_pylist()]
            rest = [batch.column(i + 2) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", *[f"carry_{c}" for c in carry], "text", "n_chars"])

    out = cols.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), *[F.col(f"carry_{c}").alias(c) for c in carry], "text", "n_chars")
