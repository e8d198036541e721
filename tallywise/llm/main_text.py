"""Main text of web pages by tree scoring.

The markup is read into a tree of block elements; inline elements only mark text as
link text. Every paragraph, and text directly in the body or a like container, passes points to its ancestors: one, one per comma and up to
three for its length, in full to the parent, half to the grandparent, a third of that
and so on further up. Points of a container are discounted by its link density. The best
container stands for its enclosing article or main element, if it has one, which is kept
whole: headings, quotes, tables and short sections included. It is kept with those siblings
that score at least a fifth of it or are paragraphs, headings, quotes, lists, tables, figures
or like sections with few links; the text comes out block by block in page order.

Parts that are never main text are left out whole: scripts, styles, forms, menus, page
headers and footers, sidebars, notices, adverts, reader comments, by element or by the
words of class, id and role. A form, or an element left out by such a word, that holds most
of the page's article text (without any article: of its paragraphs) is the frame of
the page and stays. One named for comments or related texts stays only if no article and hardly
any other text is outside of it.

Null and empty pages, and pages without a paragraph, give the empty text. Broken markup
is read leniently: unclosed elements end with their parents, an unclosed tag or
comment ends the page. Character references are decoded, white space inside a block
becomes one space. Repeated rows are read one by one. Empty input gives an empty
result. Each page is handled alone and in linear time, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

#: HTML elements by their role.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog svg template object canvas".split())
BLOCKS = frozenset(
    "html body article main section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption figure figcaption h1 h2 h3 h4 h5 h6 header address details summary center hr fieldset".split()
)
PARAGRAPHS = frozenset("p pre blockquote td dd li div section article main h1 h2 h3 h4 h5 h6".split())
#: Containers whose own text counts as a paragraph, too.
LOOSE = frozenset("html body center fieldset details".split())
#: Those of them that hold texts of others, which may be longer than the main text.
OTHERS = frozenset("comment comments disqus respond replies related recommended".split())
#: Never left out for their names.
WHOLE = frozenset("html body article main".split())
#: Kept beside the best container, if they have few links.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure ul ol dl".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements whose start ends an open element of the same group.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th")}
#: Where the search for an open element of the group stops.
SCOPE = frozenset("ul ol dl table article main section div body html blockquote".split())
#: Words of class, id or role that name a part around the main text.
AROUND = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo sidebar rail widget menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments disqus respond replies cookie cookies consent notice "
    "notices alert popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended pagination pager toolbar search form contentinfo complementary".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<""",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tree:
    """Block elements by number: parent, element, whether left out, lengths of text and of link text, points.

    ``mark``: 1 if left out unless it proves to be the frame of the page, 2 if left out for sure;
    ``named``: what its words name, see ``_around``.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.out = [-1], ["html"], [False]
        self.mark, self.named = [0], [0]
        self.length, self.links, self.points = [0], [0], [0.0]
        self.blocks: list[tuple[int, str]] = []

    def add(self, parent: int, tag: str, mark: int, named: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.out.append(False)
        self.mark.append(mark)
        self.named.append(named)
        self.length.append(0)
        self.links.append(0)
        self.points.append(0.0)
        return len(self.tag) - 1


def _around(attributes: str) -> int:
    """1 if a word names a part around the main text, 2 if one for texts of others."""
    words = {
        w.lower() for found in _NAMED.finditer(attributes) for w in _WORD.findall(found[1] or found[2] or found[3] or "")
    }
    return 2 if words & OTHERS else 1 if words & AROUND else 0


def read(page: str) -> Tree:
    tree = Tree()
    open_nodes = [0]
    # Open elements by name: all of them, and from each open scope on up to the next.
    total, scopes = Counter(["html"]), [Counter(["html"])]
    text: list[str] = []
    state = {"links": 0, "in_link": 0}

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            node = open_nodes[-1]
            if block:
                tree.blocks.append((node, block))
                tree.length[node] += len(block)
                tree.links[node] += min(state["links"], len(block))
        state["links"] = 0

    def close(depth: int) -> None:
        flush()
        for node in reversed(open_nodes[depth:]):
            gone = tree.tag[node]
            total[gone] -= 1
            scopes[-1][gone] -= 1
            if gone in SCOPE or gone in DROPPED:
                scopes.pop()
        del open_nodes[depth:]

    position, size = 0, len(page)
    while position < size:
        found = _TOKEN.match(page, position)
        position = found.end()
        tag = found[2] or found[5]
        if tag is None:
            piece = found[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if state["in_link"]:
                    state["links"] += len(piece.strip())
            continue
        tag, ending = tag.lower(), bool(found[1] or found[4])
        if tag in RAW and not ending:
            end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if tag == "a":
            state["in_link"] = 0 if ending else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS or tag in DROPPED:
            if ending:
                if not total[tag] or tag == "html":
                    continue
                for depth in range(len(open_nodes) - 1, 0, -1):
                    if tree.tag[open_nodes[depth]] == tag:
                        close(depth)
                        break
                continue
            flush()
            if tag in VOID:
                continue
            ends = any(scopes[-1][x] for x in ("p", *ENDS.get(tag, ())))  # else nothing to look for
            if ends and (tag in BLOCKS and tag not in ("li", "td", "th", "tr", "dt", "dd") or tag in ENDS):
                # A block ends an open paragraph; list items and cells end their like.
                for depth in range(len(open_nodes) - 1, 0, -1):
                    now = tree.tag[open_nodes[depth]]
                    if now in ENDS.get(tag, ("p",)) or now == "p":
                        close(depth)
                        if now != "p" or tag not in ENDS or tag == "p":
                            break
                    elif now in SCOPE or now in DROPPED:
                        break
            parent = open_nodes[-1]
            inside = total["article"] or total["main"]
            named = _around(found[3] or found[6] or "")
            mark = 2 if tag in DROPPED and tag != "form" or tag == "header" and not inside else 0
            if not mark and (tag == "form" or named and tag not in WHOLE):
                mark = 1
            open_nodes.append(tree.add(parent, tag, mark, named))
            total[tag] += 1
            if tag in SCOPE or tag in DROPPED:
                scopes.append(Counter())
            scopes[-1][tag] += 1
    flush()
    settle(tree)
    return tree


def _gain(tree: Tree, node: int, block: str) -> float:
    if tree.tag[node] not in PARAGRAPHS and tree.tag[node] not in LOOSE:
        return 0.0
    return (1 + block.count(",") + min(len(block) / 100, 3)) * (1 - tree.links[node] / max(tree.length[node], 1))


def settle(tree: Tree) -> None:
    """Decide what is left out, now that it is known what every element holds."""
    n = len(tree.tag)
    sure, article = [False] * n, [False] * n
    for node in range(1, n):  # parents have smaller numbers
        up = tree.parent[node]
        sure[node] = sure[up] or tree.mark[node] == 2
        article[node] = article[up] or (tree.tag[node] in ("article", "main") and not tree.named[node])
    text, told = [0.0] * n, [0.0] * n
    for node, block in tree.blocks:
        if not sure[node]:
            gain = _gain(tree, node, block)
            text[node] += gain
            told[node] += gain * article[node]
    for node in range(n - 1, 0, -1):
        text[tree.parent[node]] += text[node]
        told[tree.parent[node]] += told[node]
    for node in range(1, n):
        mark = tree.mark[node]
        if tree.named[node] == 2:
            frame = told[node] == told[0] and text[node] > text[0] * 0.9
        elif told[0]:
            frame = told[node] > told[0] / 2 and text[node] > text[0] / 4
        else:
            frame = text[node] > text[0] / 2
        if mark == 1 and frame:
            mark = 0
        tree.out[node] = tree.out[tree.parent[node]] or mark > 0
        if tree.out[node]:
            tree.length[node] = tree.links[node] = 0
    tree.blocks = [(node, block) for node, block in tree.blocks if not tree.out[node]]


def choose(tree: Tree) -> set[int]:
    """The kept containers: the best one and its like siblings."""
    n = len(tree.tag)
    length, links = tree.length[:], tree.links[:]
    for node in range(n - 1, 0, -1):  # children have larger numbers
        length[tree.parent[node]] += length[node]
        links[tree.parent[node]] += links[node]
    for node, block in tree.blocks:
        gain = _gain(tree, node, block)
        if gain:
            # The block's own element if it holds others too, else its parent, gets the full points.
            holds = tree.tag[node] in LOOSE or tree.tag[node] in ("div", "section", "article", "main")
            up, share = (node, 1.0) if holds else (tree.parent[node], 1.0)
            level = 1
            while up >= 0 and share > 0.01:
                tree.points[up] += gain * share
                level += 1
                share = 0.5 if level == 2 else share / 3
                up = tree.parent[up]
    bonus = {"article": 25.0, "main": 15.0, "div": 2.0, "section": 2.0, "pre": 1.0, "blockquote": 1.0}
    best, most = -1, 0.0
    for node in range(n):
        if tree.points[node] > 0 and not tree.out[node]:
            tree.points[node] = (tree.points[node] + bonus.get(tree.tag[node], 0.0)) * (1 - links[node] / max(length[node], 1))
            if tree.points[node] > most:
                best, most = node, tree.points[node]
    if best < 0:
        return set()
    up = best
    while up >= 0 and tree.tag[up] not in ("article", "main"):
        up = tree.parent[up]
    same = tree.tag[best]
    if up >= 0:
        best, most, same = up, max(tree.points[up], 0.0), tree.tag[up]
    kept = {best}
    if tree.parent[best] >= 0:
        for node in range(n):
            if tree.parent[node] == tree.parent[best] and not tree.out[node] and length[node]:
                few = links[node] / length[node]
                plain = tree.tag[node] in PLAIN or tree.tag[node] == same == "section"
                plain = plain and (few < 0.25 if length[node] > 80 else few == 0)
                if tree.points[node] >= most / 5 and tree.points[node] > 0 or plain:
                    kept.add(node)
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = read(page)
    kept = choose(tree)
    inside = [False] * len(tree.tag)
    for node in range(len(tree.tag)):
        inside[node] = node in kept or (tree.parent[node] >= 0 and inside[tree.parent[node]])
    return "\n".join(block for node, block in tree.blocks if inside[node])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pick(pages, {"page_id": "long", "url": "string", "html": "string"}).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
