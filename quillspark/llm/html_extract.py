"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is a node with a hidden label, content or boilerplate. Unary potentials come from its tag,
its class, id and role words, its own text and its share of linked text; parent-child potentials tie the
labels along the tree. Sum-product messages go upward and downward once, which gives each node's exact
marginal. All potentials are trained by counting over labelled pages; ``labelled_pages`` makes them by
rule, so their number is fixed. Text belongs to the element that directly holds it.

The text: character references decoded, white space inside a block to one space, blocks in page order
joined by one newline. Scripts, styles, forms, embedded objects and the head never hold text; ``br`` ends a
line of its block and closes no element; a slash closes a tag only within svg and math.

Defined cases: null, empty or markup-only html gives the empty text; unclosed and crossed tags close where
HTML implies it; an unclosed comment, script or style reaches to the end; plain text without any element is
content; repeated rows repeat results; other columns are ignored. Work is linear in the page's size.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no running text; those of RAW hold no markup either.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style textarea title noscript template iframe object svg math canvas audio video form button select option input label fieldset dialog datalist nav footer aside menu xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose tags a slash may close.
FOREIGN = ("svg", "math")
#: Start tags that close open elements of the second set, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OPEN = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""(?i)\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_OUT = "page_id long, url string, text string, n_nodes int"


class Page:
    """Elements in page order (parents first) and the text pieces each directly holds."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks, self.pieces, self.off = ["#page"], [-1], [()], [], [False]
        self._parse(source)
        #: The block that an element belongs to; phrasing such as a, b or em is part of its block's node.
        self.block = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            self.block[i] = i if self.tag[i] in BLOCK or self.tag[i] in NEVER else self.block[self.parent[i]]
        self.above = [self.block[p] if i else -1 for i, p in enumerate(self.parent)]

    def _parse(self, source: str) -> None:
        stack, at, n, pieces = [0], 0, len(source), self.pieces  # pieces: (node, text) or (node, None) for a break
        places = defaultdict(list)  # tag to the places in the stack where it is open
        self.blocks = []  # the places where a block is open
        last = source.rfind(">")
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                pieces.append((stack[-1], source[at:lt]))
            if lt >= n:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), lt):
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = (_TAG.match(source, lt) or _LOOSE.match(source, lt)) if lt < last else None
            if not m:
                if lt > last and _OPEN.match(source, lt):
                    break  # a tag that the end of the page cuts off
                pieces.append((stack[-1], "<"))
                at = lt + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self._close(tag, stack, places)
                continue
            if tag in BLOCK:
                self._implied(tag, stack, places)
            if tag in BLOCK or tag == "br":
                pieces.append((stack[-1], None))
            if tag in VOID:
                continue
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.marks.append(self._words(m[3]))
            self.off.append("data-y=0" in m[3])
            node = len(self.tag) - 1
            if tag in RAW:
                end = re.compile(rf"(?i)</{re.escape(tag)}\b").search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
            elif not (m[3].endswith("/") and (tag in FOREIGN or any(places.get(x) for x in FOREIGN))):
                if tag in BLOCK:
                    self.blocks.append(len(stack))
                places[tag].append(len(stack))
                stack.append(node)

    def _cut(self, stack: list[int], places: dict[str, list[int]], at: int) -> None:
        """Close the elements from a place of the stack on."""
        for node in stack[at:]:
            places[self.tag[node]].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del stack[at:]

    def _implied(self, tag: str, stack: list[int], places: dict[str, list[int]]) -> None:
        """A block closes the p that is the innermost block; some also the elements of their kind up to a bound."""
        if tag in IMPLIED:
            closes, bound = IMPLIED[tag]
            floor = max((places[name][-1] for name in bound if places.get(name)), default=0)
            found = [x[i] for name in (*closes, "p") if (x := places.get(name)) and (i := bisect_right(x, floor)) < len(x)]
            if found:
                self._cut(stack, places, min(found))
        elif self.blocks and self.tag[stack[self.blocks[-1]]] == "p":
            self._cut(stack, places, self.blocks[-1])

    def _close(self, tag: str, stack: list[int], places: dict[str, list[int]]) -> None:
        if tag in BLOCK:
            self.pieces.append((stack[-1], None))
        last = lambda name: places[name][-1] if places.get(name) else 0
        at = last(tag)
        if at and (tag in BLOCK or at >= max(map(last, ("td", "th", "article", "main", "body")))):
            self._cut(stack, places, at)

    @staticmethod
    def _words(attributes: str) -> tuple[str, ...]:
        if not attributes or "=" not in attributes and "hidden" not in attributes:
            return ()
        out = set()
        for m in _ATTR.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "hidden" or m[1].lower() == "style" and "display:none" in value.replace(" ", ""):
                out.add("hidden!")
            elif m[1].lower() != "style":
                out.update(h for w in _WORD.findall(value) if (h := next((h for p, h in STEMS if w.startswith(p)), w)) in HINTS)
        return tuple(sorted(out))


#: Words of class, id and role that are told apart; others count as "other" (fixed values).
HINTS = frozenset(
    "ad ads advert advertisement sponsor promo banner nav menu navbar breadcrumb breadcrumbs pager pagination footer foot copyright header masthead topbar sidebar side aside widget related recommended share social comment comments reply respond "
    "discussion cookie consent notice alert popup modal newsletter subscribe signup login search form tags meta byline toolbar hidden article content post entry main story body text page blog".split()
)

#: Beginnings of words that count as one of the hints (fixed values).
STEMS = (("comment", "comments"), ("disqus", "comments"), ("advert", "ad"), ("sponsor", "sponsor"), ("cookie", "cookie"), ("navig", "nav"), ("footer", "footer"), ("sidebar", "sidebar"), ("repl", "reply"), ("subscri", "subscribe"), ("newslet", "newsletter"))


def observations(page: Page) -> list[list[tuple]]:
    """For each block the observed values that its unary potential multiplies; none for phrasing."""
    n = len(page.tag)
    own, linked, total = [0] * n, [0] * n, [0] * n
    stops = [0] * n
    for node, piece in page.pieces:
        if piece:
            size, block = len(piece.split()), page.block[node]
            total[node] += size
            own[block] += size
            stops[block] += piece.count(".") + piece.count(",")
    for i in range(n - 1, -1, -1):
        if page.tag[i] == "a":
            linked[i] = total[i]
        if i:
            total[page.parent[i]] += total[i]
            linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        if page.block[i] != i:
            out.append([])
            continue
        seen = [("under", (page.tag[i], page.tag[page.above[i]] if i else "")), ("tag", page.tag[i])]
        seen += [("mark", w) for w in page.marks[i]]
        if own[i]:
            seen.append(("own", (min(5, own[i].bit_length()), min(3, stops[i]))))
        if total[i]:
            seen.append(("linked", min(3, 4 * linked[i] // total[i])))
        out.append(seen)
    return out


class Model:
    """Log potentials by counting, with add-one smoothing, over pages whose nodes are labelled."""

    def __init__(self, pages: list[tuple[Page, list[int]]]):
        unary, pair, root, self.classes = defaultdict(Counter), Counter(), Counter(), Counter()
        values = defaultdict(set)
        for page, labels in pages:
            for i, seen in enumerate(observations(page)):
                if page.block[i] != i:
                    continue
                y = labels[i]
                self.classes[y] += 1
                pair[labels[page.above[i]] if i else None, y] += 1
                for kind, value in seen:
                    unary[kind, y][value] += 1
                    values[kind].add(value)
        self.unary = {}
        for kind, known in values.items():
            for value in known:
                if kind == "mark":  # of all nodes of the label: most have no mark
                    p = [(unary[kind, y][value] + 0.005) / (self.classes[y] + 0.2) for y in (0, 1)]
                else:
                    p = [(unary[kind, y][value] + 0.5) / (sum(unary[kind, y].values()) + 0.5 * len(known)) for y in (0, 1)]
                self.unary[kind, value] = (math.log(p[0]), math.log(p[1]))
        self.pair = [[math.log((pair[a, b] + 1) / (pair[a, 0] + pair[a, 1] + 2)) for b in (0, 1)] for a in (0, 1)]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node by messages up and down the tree."""
        n, seen = len(page.tag), observations(page)
        up = [[0.0, 0.0] for _ in range(n)]
        for i in range(n):
            for key in seen[i]:
                u = self.unary.get(key)
                if u and not (key[0] == "tag" and seen[i][0] in self.unary):  # the tag alone only where its parent is new
                    up[i][0] += u[0]
                    up[i][1] += u[1]
            if page.tag[i] in NEVER:
                up[i][0] += 30.0
        message = [None] * n
        blocks = [i for i in range(n) if page.block[i] == i]
        (a00, a01), (a10, a11) = self.pair
        for i in reversed(blocks[1:]):
            x0, x1 = up[i]
            m = message[i] = (_log_add(a00 + x0, a01 + x1), _log_add(a10 + x0, a11 + x1))
            up[page.above[i]][0] += m[0]
            up[page.above[i]][1] += m[1]
        out = [0.0] * n
        belief = [None] * n
        belief[0] = tuple(up[0])
        for i in blocks:
            if i:
                p, m = belief[page.above[i]], message[i]
                r0, r1 = p[0] - m[0], p[1] - m[1]  # the parent without this child
                belief[i] = (up[i][0] + _log_add(r0 + a00, r1 + a10), up[i][1] + _log_add(r0 + a01, r1 + a11))
            out[i] = 1 / (1 + math.exp(min(700, max(-700, belief[i][0] - belief[i][1]))))
        return [out[page.block[i]] for i in range(n)]


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def text_of(page: Page, content: list[bool]) -> str:
    """Blocks of the text that content nodes hold; an element within one that never holds text hides it."""
    hidden = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        hidden[i] = hidden[page.parent[i]] or page.tag[i] in NEVER or "hidden!" in page.marks[i]
    blocks, held = [], []
    for node, piece in [*page.pieces, (0, None)]:
        if piece is None:
            block = " ".join(entities.unescape("".join(held)).split())
            if block:
                blocks.append(block)
            held = []
        elif content[node] and not hidden[node]:
            held.append(piece)
    return "\n".join(blocks)


def extract(source: str, model: Model) -> tuple[str, int]:
    page = Page(source)
    return text_of(page, [p > 0.5 for p in model.marginals(page)]), len(page.tag)


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[Page, list[int]]]:
    """Pages of several layouts whose regions are labelled as they are made."""
    rng = random.Random(seed)
    syllables = "the of and to in that was for on is with as it be by are this ter lan mer son del que ung ver tion".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 3))))
    text = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: ", ".join(text(3, 9) for _ in range(rng.randint(1, 3))).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 2, 3, 5, 8)))) if rng.random() > 0.12 else text(1, 3)
    link = lambda: f'<a href="/{word()}">{text(1, 3)}</a>'
    items = lambda a, b: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b)))
    off = lambda tag, mark, body: f'<{tag} data-y=0{f" class={chr(34)}{mark}{chr(34)}" if mark else ""}>{body}</{tag}>'
    out = []
    for _ in range(n):
        inline = lambda s: f"<b>{s}</b>" if rng.random() < 0.15 else f"{s} {link()} {text(1, 4)}" if rng.random() < 0.2 else f"{s} <em>{text(1, 2)}</em>" if rng.random() < 0.2 else s
        parts = [f"<h1>{text(2, 8)}</h1>" if rng.random() < 0.8 else f"<header><h1>{text(2, 8)}</h1></header>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            kind = rng.random()
            if kind < 0.66:
                parts.append(f"<p>{inline(prose())}</p>")
            elif kind < 0.73:
                parts.append(f"<h2>{text(1, 6)}</h2><p>{prose()}</p>")
            elif kind < 0.86:
                parts.append(f"<{(l := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{prose()}</li>" if rng.random() < 0.7 else f"<li><p>{prose()}</p></li>" for _ in range(rng.randint(2, 5))) + f"</{l}>")
            elif kind < 0.89:
                parts.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{text(1, 3)}</td><td>{text(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.935:
                parts.append(f"<pre>{text(4, 20)}</pre>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{text(3, 9)}</figcaption></figure>")
            else:
                parts.append(off(rng.choice(("div", "p", "section")), rng.choice(("ad", "ads", "advert", "sponsor promo")), rng.choice((text(3, 12), prose()))))
        if rng.random() < 0.3:
            parts.insert(1, off("div", rng.choice(("share social", "meta byline", "tags")), text(2, 6) + link()))
        body = "".join(parts)
        shape = rng.random()
        if shape < 0.4:
            body = f"<article>{body}</article>"
        elif shape < 0.55:
            body = f"<main><article>{body}</article></main>"
        elif shape < 0.7:
            body = f'<div class="{rng.choice(("content", "post entry", "article body", "story text"))}">{body}</div>'
        elif shape < 0.8:
            body = f'<div id="main"><div class="{rng.choice(("content", "post", "page"))}">{body}</div></div>'
        elif shape < 0.9:
            body = f"<div><section>{body}</section></div>"
        else:
            body = f"<main>{body}</main>"
        before, after = [], []
        if rng.random() < 0.7:
            menu = f"<ul>{items(3, 8)}</ul>"
            before.append(off("nav", "", menu) if rng.random() < 0.6 else off("div", rng.choice(("nav", "menu", "navbar")), menu))
        if rng.random() < 0.4:
            before.insert(0, off("header", rng.choice(("", "header", "masthead")), f"<h1>{text(1, 3)}</h1><p>{text(2, 7)}</p>") if rng.random() < 0.6 else off("div", rng.choice(("header", "topbar banner")), text(2, 8)))
        if rng.random() < 0.4:
            before.append(off("div", rng.choice(("ad", "ads banner", "advertisement")), sentence()))
        if rng.random() < 0.3:
            before.append(off("div", rng.choice(("cookie notice", "consent popup", "alert")), f"<p>{sentence()}</p>"))
        if rng.random() < 0.15:
            before.append(off("div", "breadcrumb", f"{link()} {link()}"))
        nested = rng.random() < 0.6
        for chance, mark, made in (
            (0.35, "sidebar", f"<h3>{text(1, 3)}</h3><ul>{items(2, 6)}</ul>"), (0.25, "related recommended", f"<ul>{items(2, 5)}</ul>"), (0.3, "comments", "".join(f'<div class="comment"><p>{prose()}</p></div>' if nested else f"<p>{prose()}</p>" for _ in range(3))), (0.2, "comment-list", "".join(f"<li><p>{prose()}</p></li>" for _ in range(3))),
            (0.2, "newsletter subscribe", f"<p>{sentence()}</p>"), (0.15, "widget", f"<p>{text(2, 9)}</p>"), (0.15, "pagination", f"{link()} {link()}"),
        ):
            if rng.random() < chance:
                if mark == "comment-list":
                    after.append(off(rng.choice(("ol", "ul")), mark, made))
                    continue
                (after if rng.random() < 0.7 else before).append(off("aside" if mark == "sidebar" and rng.random() < 0.5 else "section" if mark == "comments" and rng.random() < 0.4 else "div", mark, made))
        if rng.random() < 0.15:
            after.append(off("form", "", f"<p>{text(1, 5)}</p>"))
        if rng.random() < 0.85:
            foot = f"<p>{text(3, 9)}</p>" if rng.random() < 0.5 else text(3, 14)
            after.append(off("footer", "", foot) if rng.random() < 0.7 else off("div", rng.choice(("footer", "foot copyright")), foot))
        page = Page(f"<html><head data-y=0><title>{text(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
        labels = []
        for i, p in enumerate(page.parent):
            labels.append(0 if i and (labels[p] == 0 or page.off[i]) else 1)
        out.append((page, labels))
    return out


def _runner(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [extract(x or "", model) for x in b.column("html").to_pylist()]
            columns = [b.column("page_id"), b.column("url"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_nodes"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text, n_nodes."""
    model = model or Model(labelled_pages())
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_runner(model), _OUT)


def op2_query(spark, sf_dir) -> DataFrame:
    out = main_text(shared.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
