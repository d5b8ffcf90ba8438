"""Main text of web pages by minimum cut.

A page is read into text blocks with their place in the DOM. A linear classifier scores each block from its
tag, its ancestors, their class, id and role cues, its words and its links; the costs of either label are
terminal capacities. Smoothness edges join blocks that are adjacent on the page, the stronger the closer
they are in the DOM, and blocks of the same parent. A maximum flow gives the cheapest labelling; blocks
that stay on the source's side are content. Before the flow, blocks whose own evidence outweighs all their
edges are fixed, which changes no labelling and leaves few nodes.

A cue of boilerplate in an element's name is evidence, and no verdict: it counts the less, the larger the share of the
page's prose that the element holds, if the page's first heading or article lies in it too, and less where a word
of the same name speaks for content. So a layout wrapper does not lose its article. Evidence and edges have one
scale: the neighbours of a short block without cues outvote it, those of a block with a cue of its own do not.

Text inside a block: character references decoded, white space turned into one space, trimmed. ``<br>`` is
white space. Scripts, styles, comments and other text that pages do not show are no blocks.

Defined results: null and empty pages give an empty text; a tag, comment or script that the page breaks off
in is dropped; at equal costs a block is boilerplate; repeated rows give repeated results; an empty table gives an empty result; only the named
columns are read, so others cannot clash; pages of any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusloom.llm.arrow import map_rows

#: Kinds of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title textarea noscript template iframe svg math object canvas audio video noembed noframes xmp head".split())
RAW = UNSEEN - {"head", "svg", "math", "template", "object", "canvas", "audio", "video"}
CLOSES_P = BLOCKS - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
#: What an opening tag closes, and where the search for it ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Cues of boilerplate and of content.
OFF_TAGS = frozenset("nav footer aside form menu dialog select button fieldset datalist search".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos "
    "promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login signin search comment comments commentlist disqus discussion reply replies "
    "respond share sharing social related recommended recommendations trending popular pagination pager copyright legal "
    "disclaimer skip hidden".split()
)
HEAD_WORDS = frozenset("header head sitehead".split())
SOFTENERS = frozenset("with has no without".split())
ON_WORDS = frozenset("content article post entry story main body text prose".split())

MARKUP = re.compile(
    r"<(?:(!--)|([!?]|/(?![A-Za-z]))|(/?)([A-Za-z][^\s/>]*)((?>[^>\"'=]++|=\s*\"[^\"]*+\"|=\s*'[^']*+'|[=\"'])*+)>)"
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CUE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    path: tuple[int, ...]  # ids of the open elements, the outermost first
    linked: int  # characters inside links
    off: tuple[int, ...]  # ids of open elements that say boilerplate, the outermost first
    head: bool  # in a header
    article: bool
    hint: bool  # an ancestor's name says content


class _Open:
    __slots__ = ("tag", "key", "off", "weight", "head", "article", "hint", "link")

    def __init__(self, tag: str, key: int, up: _Open | None, attributes: str):
        self.tag, self.key = tag, key
        self.off, self.head, self.article, self.hint, self.link = (
            (up.off, up.head, up.article, up.hint, up.link) if up else ((), False, False, False, False)
        )
        self.weight = 0.0  # of what it says itself
        if tag in OFF_TAGS:
            self.weight = OFF
        elif tag == "header":
            self.head = True
        elif tag in ("article", "main"):
            self.article = True
        elif tag == "a":
            self.link = True
        if attributes and tag not in ("html", "body"):
            self._cues(attributes)
        if self.weight:
            self.off = (*self.off, key)

    def _cues(self, attributes: str) -> None:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                for one in value.split():
                    words = {w.lower() for w in CUE.findall(one)}
                    if words & OFF_WORDS and not words & SOFTENERS and self.tag not in ("main",):
                        self.weight = min(self.weight, MIXED if words & ON_WORDS else OFF)
                    elif words & HEAD_WORDS:
                        self.head = True
                    elif words & ON_WORDS:
                        self.hint = True
            elif name == "role":
                if value.lower() in OFF_ROLES:
                    self.weight = min(self.weight, OFF)
                elif value.lower() in ("main", "article"):
                    self.article = True
            elif name == "itemprop":
                if value == "articleBody":
                    self.article = True
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.weight = UNSHOWN
            elif name == "hidden" or value.lower() == "true":
                self.weight = UNSHOWN


def blocks_of(page: str) -> tuple[list[Block], dict[int, float], set[int]]:
    """The text blocks of a page, in page order; what elements with a cue of boilerplate weigh, by id; and the ids of the
    elements that hold the first heading or the first article."""
    out: list[Block] = []
    weights: dict[int, float] = {}
    leads: dict[str, list[int]] = {}
    stack = [_Open("#page", 0, None, "")]
    n_keys, unseen, at, size = 1, 0, 0, len(page)
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                here = next((o for o in reversed(stack) if o.tag in BLOCKS or o.tag == "#page"), stack[0])
                out.append(
                    Block(text, here.tag, tuple(o.key for o in stack if o.tag in BLOCKS or o.tag == "#page"), linked,
                          here.off, here.head, here.article, here.hint)
                )
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        """Closes stack[k] and what is open inside it."""
        nonlocal unseen
        if any(o.tag in BLOCKS for o in stack[k:]):
            flush()
        unseen -= sum(o.tag in UNSEEN for o in stack[k:])
        del stack[k:]

    def say(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = MARKUP.match(page, lt)
        if m is None:
            if lt + 1 < size and (page[lt + 1].isascii() and page[lt + 1].isalpha() or page[lt + 1] == "/" and page[lt + 2 : lt + 3].isalpha()):
                say(page[at:lt])
                gt = page.find(">", lt)
                if gt < 0:
                    break  # the page ends inside a tag
                at = gt + 1
                continue
            if page.startswith(("<!", "<?", "</"), lt):
                say(page[at:lt])
            else:
                say(page[at : lt + 1])
                at = lt + 1
                continue
        else:
            say(page[at:lt])
        if m is None or m[1] or m[2]:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4 - 2 * page.startswith(("<!-->", "<!--->"), lt))
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        at = m.end()
        tag = m[4].lower()
        if m[3]:
            if tag == "br":
                say(" ")
                continue
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            say(" " * (tag == "br"))
            continue
        if tag in BLOCKS:
            flush()
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)
            if k and not any(o.tag in ("button", "td", "th", "caption") for o in stack[k:]):
                close(k)
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            k = len(stack) - 1
            found = 0
            while k and stack[k].tag not in stop:
                if stack[k].tag in ends:
                    found = k
                k -= 1
            if found:
                close(found)
        elif tag == "body":
            k = next((k for k, o in enumerate(stack) if o.tag == "head"), 0)
            if k:
                close(k)
        if tag in VOID or m[5].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = size if gt < 0 else gt + 1
            continue
        if tag in ("h1", "article", "main"):
            leads.setdefault("h1" if tag == "h1" else "article", [o.key for o in stack])
        stack.append(_Open(tag, n_keys, stack[-1], m[5]))
        if stack[-1].weight:
            weights[n_keys] = stack[-1].weight
        unseen += tag in UNSEEN
        n_keys += 1
    flush()
    return out, weights, {k for keys in leads.values() for k in keys}


#: Weights of the classifier, in units of log odds. A cue of the page's own names (OFF, HEAD, ARTICLE) outweighs what
#: a block's length and tag can say, and the edges of two neighbours; what hides an element outweighs all.
BIAS, PER_LOG_WORD, SENTENCE, LINKS, HEAD_IN_ARTICLE, ARTICLE, HINT, RIGHTS = -1.2, 0.6, 0.5, -3.0, -1.0, 5.0, 2.0, -4.0
OFF, MIXED, HEAD, UNSHOWN = -7.0, -3.0, -7.0, -20.0
TAG = {"p": 0.8, "h1": 0.8, "h2": 0.3, "h3": 0.3, "h4": 0.3, "blockquote": 0.5, "pre": 0.5, "li": -0.3, "td": -0.2, "th": -0.2}
#: Words from which on a block counts as prose.
PROSE = 8


def belief_of(blocks: list[Block], weights: dict[int, float], leads: set[int]) -> dict[int, float]:
    """How far, from 0 to 1, the cue of each element with one is believed: fully, unless it holds the page's first heading
    or article; then by the share of the page's prose outside it."""
    inside, total = dict.fromkeys(weights, 0), 0
    for b in blocks:
        if b.text.count(" ") + 1 >= PROSE:
            plain = len(b.text) - min(b.linked, len(b.text))
            total += plain
            for k in b.off:
                inside[k] += plain
    return {k: 1 - inside[k] / total if k in leads and total and w > UNSHOWN else 1.0 for k, w in weights.items()}


def score(b: Block, weights: dict[int, float], belief: dict[int, float]) -> float:
    """Log odds that a block is content."""
    words = b.text.count(" ") + 1
    x = BIAS + PER_LOG_WORD * math.log1p(words) + TAG.get(b.tag, 0.0)
    x += LINKS * min(1.0, b.linked / len(b.text))
    if b.text[-1] in ".!?…。":
        x += SENTENCE
    if words < 40 and (b.text[0] == "©" or "all rights reserved" in b.text.lower() or b.text.lower().startswith("copyright")):
        x += RIGHTS
    place = ARTICLE * b.article + HINT * b.hint + (HEAD_IN_ARTICLE if b.article else HEAD) * b.head
    for k in b.off:  # the inner element's cue replaces what is known so far, as far as it is believed
        place = min(place, place * (1 - belief[k]) + weights[k] * belief[k])
    return x + place


ADJACENT, SIBLING, UNIT = 2.0, 0.5, 1000


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity): adjacent blocks, weaker by DOM distance, and the last block before with the same parent."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1]
            shared = 0
            for x, y in zip(a.path, b.path):
                if x != y:
                    break
                shared += 1
            apart = len(a.path) + len(b.path) - 2 * shared
            out.append((j - 1, j, int(UNIT * ADJACENT / (1 + max(0, apart - 2)))))
        parent = b.path[:-1]
        if parent in last and last[parent] < j - 1:
            out.append((last[parent], j, int(UNIT * SIBLING)))
        last[parent] = j
    return [e for e in out if e[2]]


def max_flow_labels(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The cheapest labelling: unary[i] > 0 is what it costs to call i boilerplate, < 0 to call it content; an
    edge costs its capacity if its ends differ. True: content, on the source's side of the minimum cut."""
    n, own = len(unary), list(unary)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # fix the nodes whose own evidence outweighs all their edges
        i = todo.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i].clear()
    free = [i for i in range(n) if label[i] is None]
    if free:
        for i, content in zip(free, _cut(free, own, near), strict=True):
            label[i] = content
    return [bool(x) for x in label]


def _cut(free: list[int], own: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Dinic's maximum flow on the free nodes."""
    number = {i: k for k, i in enumerate(free)}
    source, sink = len(free), len(free) + 1
    graph: list[dict[int, int]] = [{} for _ in range(len(free) + 2)]
    for i, k in number.items():
        for j, c in near[i].items():
            graph[k][number[j]] = c
        if own[i] > 0:
            graph[source][k], graph[k][source] = own[i], 0
        elif own[i] < 0:
            graph[k][sink], graph[sink][k] = -own[i], 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(len(free))]
        ways = {u: list(graph[u]) for u in level}
        tried = dict.fromkeys(level, 0)  # ways of a node that are full or dead ends in this phase
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:]))
                flow = min(graph[a][b] for a, b in steps)
                for a, b in steps:
                    graph[a][b] -= flow
                    graph[b][a] = graph[b].get(a, 0) + flow
                full = next(k for k, (a, b) in enumerate(steps) if graph[a][b] == 0)
                del path[full + 1 :]
                continue
            while tried[u] < len(ways[u]):
                v = ways[u][tried[u]]
                if graph[u][v] > 0 and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
                tried[u] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(page: str | None) -> str:
    blocks, weights, leads = blocks_of(page) if page else ([], {}, set())
    belief = belief_of(blocks, weights, leads)
    labels = max_flow_labels([round(UNIT * score(b, weights, belief)) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def _rows():
    def work(*columns: list):
        *rest, pages = columns
        for row, page in zip(zip(*rest, strict=True), pages, strict=True):
            text = main_text(page)
            yield (*row, text, len(text))

    return work


def extract(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(*id_cols, text, n_chars) of every page, a map without a shuffle."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in id_cols)
    return map_rows(df.select(*id_cols, html_col), _rows, f"{schema}, text string, n_chars bigint")
