"""Main text of web pages by a graphical model on the DOM tree.

Every element that can hold blocks, and every run of inline text in one, is a
node with a hidden label: content or not.  A node's potential is a logistic
function of its tag, names and text; an edge's potential compares how often
parent and child have their labels together with how often each has its own.
Sum-product messages upward and downward give each node's marginal, and text
whose marginal for content is at least one half is kept in page order.  The
potentials are fitted on the labelled pages of ``labelled_pages``.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common
from tessera.llm.labelled_pages import NAMES, pages

# Elements of HTML by how they take part in the tree.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title iframe noembed noframes select textarea button option datalist".split())
BLOCK = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag closes an open element of these kinds, unless one of the others lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"ins", "html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
#: Start tags that leave an open head open; any other one ends it, as text does.
IN_HEAD = set("html head title style script noscript template meta link base".split())
#: Without names and around one other block only, these say nothing about the text inside.
WRAPPERS = {"div", "section", "center"}
TRAIN_PAGES, TRAIN_ROUNDS, RIDGE = 400, 12, 5e-5


class Node:
    __slots__ = ("children", "linked", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node] = []
        self.text: list[str] = []
        self.linked = 0  # characters of its text inside links


COMMENT_END, SHORT_COMMENT, OPEN_TAG = re.compile("--!?>"), re.compile("<!--(?:-?>)"), re.compile("</?[a-zA-Z]")


class TreeBuilder(HTMLParser):
    """Blocks and their inline text; what browsers do not show is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]  # each open element and the block it lies in
        self.counts = Counter(["html"])  # of open elements by tag
        self.hidden: list[str] = []
        self.links = 0

    # The whole page is fed at once, so what is open at its end stays open, and is left
    # out as a browser leaves it out.  Looking for its end again from each later bracket
    # would take the square of the page's length.

    def parse_comment(self, i, report=1):
        short = SHORT_COMMENT.match(self.rawdata, i)
        end = short or COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def past_bracket(self, i, report=1):
        """Declarations, instructions and sections of other document types are comments to a browser."""
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    parse_html_declaration = parse_marked_section = parse_bogus_comment = parse_pi = past_bracket

    def goahead(self, end):
        # an open tag at the end of the page begins behind the last closing bracket
        last = self.rawdata.rfind(">")
        open_tag = OPEN_TAG.search(self.rawdata, last + 1)
        if open_tag:
            self.rawdata = self.rawdata[: open_tag.start()]
        super().goahead(end)

    def handle_starttag(self, tag, attrs):
        if self.hidden == ["head"] and tag not in IN_HEAD:
            self.hidden.clear()
        if self.hidden:
            if tag not in VOID and tag in HIDDEN:
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            if tag == "head" and len(self.open) > 1:
                return
            self.hidden.append(tag)
            return
        if tag == "br":
            self.put(" ")
        if tag == "body" and len(self.open) == 1:
            self.root.names = names_of(attrs)
        if tag in ("html", "body") or (tag in VOID and tag != "hr"):
            return
        if tag in ENDS_P:
            self.close_open({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        if tag == "hr":
            self.open[-1][1].children.append(Node("hr", self.open[-1][1]))
            return
        block = self.open[-1][1]
        if tag in BLOCK:
            block.children.append(node := Node(tag, block, names_of(attrs)))
            block = node
        self.links += tag == "a"
        self.open.append((tag, block))
        self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        above = [] if self.hidden == ["head"] and tag not in IN_HEAD else list(self.hidden)
        self.handle_starttag(tag, attrs)
        if len(self.hidden) > len(above):
            self.hidden.pop()
        elif tag not in VOID and tag in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.hidden.clear()
            return
        if tag not in ("html", "body", "br"):
            self.close_open({tag}, {"article", "table", "body"} - {tag} if tag not in BLOCK else set())

    def close_open(self, tags: set, stop: set) -> None:
        if not any(self.counts[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][0]
            if tag in tags:
                for t, _ in self.open[i:]:
                    self.links -= t == "a"
                    self.counts[t] -= 1
                del self.open[i:]
                return
            if tag in stop:
                return

    def handle_data(self, data):
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            self.put(data)

    def put(self, data: str) -> None:
        block = self.open[-1][1]
        if not block.children or block.children[-1].tag != "#text":
            block.children.append(Node("#text", block))
        leaf = block.children[-1]
        leaf.text.append(data)
        if self.links > 0:
            leaf.linked += len(data)


def names_of(attrs) -> str:
    known = dict(attrs)
    hidden = " hidden" if "hidden" in known or known.get("aria-hidden") == "true" or re.search(r"display:\s*none", known.get("style") or "") else ""
    return " ".join(known.get(k) or "" for k in ("class", "id", "role")).lower() + hidden


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def is_wrapper(node: Node) -> bool:
    return node.tag in WRAPPERS and not node.names.strip() and len(node.children) == 1 and node.children[0].tag != "#text"


def preorder(root: Node) -> list[Node]:
    """Parents before children, in page order; without text nodes of white space only, and without wrappers."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if c.tag != "#text" or any(map(str.strip, c.text))]
        if is_wrapper(node):
            node.children[0].parent = node.parent
        else:
            out.append(node)
        stack.extend(reversed(node.children))
    return out


@cache
def name_words() -> dict[str, str]:
    return {w: kind for kind, names in NAMES.items() for n in names for w in n.split("-")}


def features(node: Node) -> list[str]:
    """Names of the node's binary features."""
    if node.tag == "#text":
        text = "".join(node.text)
        size, parent = len(text.strip()), node.parent.tag
        share = node.linked / max(1, len(text))
        out = ["text", f"in:{parent}", f"size:{min(6, size.bit_length() // 2)}", f"linked:{int(share * 2.999)}"]
        if re.search(r"[.!?]\s|[.!?]$", text.strip()):
            out.append("sentence")
        if "©" in text:
            out.append("copyright")
        return out
    out = [f"tag:{node.tag}"]
    words = set(re.split(r"[^a-z]+", node.names)) - {""}
    out += sorted({f"name:{name_words()[w]}" for w in words if w in name_words()})
    if "hidden" in words:
        out.append("hidden")
    if words:
        out.append("named")
    return out


class ContentModel:
    def __init__(self, weights: dict[str, float], bias: float, edges: np.ndarray):
        self.weights, self.bias = weights, bias
        self.edges = edges.tolist()  # by the parent's and the child's label

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node of a tree in preorder, by messages upward and downward."""
        place = {id(n): i for i, n in enumerate(nodes)}
        parent = [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        e = self.edges
        own, get = [], self.weights.get
        for n in nodes:
            m = self.bias + sum(get(f, 0.0) for f in features(n))
            p = 1 / (1 + np.exp(-max(-12.0, min(12.0, m))))
            own.append((1 - p, p))
        low, high = [x for x, _ in own], [y for _, y in own]
        up = [(1.0, 1.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a = e[0][0] * low[i] + e[0][1] * high[i]
            b = e[1][0] * low[i] + e[1][1] * high[i]
            up[i] = (a / (a + b), b / (a + b))
            j = parent[i]
            x, y = low[j] * up[i][0], high[j] * up[i][1]
            low[j], high[j] = x / (x + y), y / (x + y)
        out = [high[0] / (low[0] + high[0])] + [0.0] * (len(nodes) - 1)
        belief = [(1 - out[0], out[0])] + [(0.0, 0.0)] * (len(nodes) - 1)
        for i in range(1, len(nodes)):
            p, u = belief[parent[i]], up[i]
            x, y = p[0] / max(u[0], 1e-300), p[1] / max(u[1], 1e-300)  # the parent without this child's message
            a = (x * e[0][0] + y * e[1][0]) * low[i]
            b = (x * e[0][1] + y * e[1][1]) * high[i]
            out[i] = b / (a + b)
            belief[i] = (1 - out[i], out[i])
        return out

    def extract(self, html: str) -> str:
        nodes = preorder(parse(html))
        kept = [" ".join("".join(n.text).split()) for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.tag == "#text" and p >= 0.5]
        return "\n\n".join(x for x in kept if x)


def labelled_tree(page: tuple) -> list[tuple[Node, int]]:
    """Nodes of a labelled page in preorder with their labels."""
    out: list[tuple[Node, int]] = []

    def add(item, parent: Node | None, label: int, linked: bool) -> None:
        if isinstance(item, str):
            if not parent.children or parent.children[-1].tag != "#text":
                parent.children.append(Node("#text", parent))
                out.append((parent.children[-1], label))
            parent.children[-1].text.append(item + " ")
            parent.children[-1].linked += len(item) * linked
            return
        if item[0] in ("content", "boilerplate"):
            add(item[1], parent, int(item[0] == "content"), False)
            return
        tag, attrs, children = item
        if tag in HIDDEN or tag in VOID:
            return
        if tag in BLOCK:
            if tag == "body":
                node = Node("html", None)
            else:
                node = Node(tag, parent, names_of(attrs.items()))
                parent.children.append(node)
            out.append((node, label))
        else:
            node = parent
        for x in children:
            add(x, node, label, linked or tag == "a")

    add(page, None, 0, False)
    label = {id(n): x for n, x in out}
    return [(n, label[id(n)]) for n in preorder(out[0][0])]


@cache
def trained(count: int = TRAIN_PAGES) -> ContentModel:
    """The model fitted on ``count`` labelled pages; the same for the same count."""
    trees = [labelled_tree(p) for p in pages(count)]
    joint = np.ones((2, 2))
    rows = []
    for tree in trees:
        label = {id(n): x for n, x in tree}
        for node, x in tree:
            rows.append((features(node), x))
            if node.parent is not None:
                joint[label[id(node.parent)], x] += 1
    names = sorted({f for fs, _ in rows for f in fs})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1  # the bias
    x[np.repeat(np.arange(len(rows)), [len(fs) for fs, _ in rows]), [place[f] for fs, _ in rows for f in fs]] = 1
    y = np.array([label for _, label in rows], float)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-9
    for _ in range(TRAIN_ROUNDS):  # Newton's method
        odds = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (odds * (1 - odds))[:, None]).T @ x / len(y) + np.diag(ridge)
        w -= np.linalg.solve(slope, x.T @ (odds - y) / len(y) + ridge * w)
    w, bias = w[:-1], float(w[-1])
    p = joint / joint.sum()
    edges = p / p.sum(axis=1, keepdims=True) / p.sum(axis=0, keepdims=True)
    return ContentModel(dict(zip(names, w.tolist(), strict=True)), bias, edges)


def extract(pages_table: DataFrame, model: ContentModel) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` for each row; null and empty html give the empty text.

    Pages of any length and depth are read whole, in time in proportion to their
    length.  A block whose marginal is one half exactly is kept.  Repeated rows
    give equal texts, an empty table an empty result; other columns, whatever
    their names, are ignored.
    """

    def run(batches):
        for b in batches:
            found = [model.extract(x) if x else "" for x in common.as_texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.map_batches(pages_table.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op5_dom_content(spark, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"), trained())
