"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block's features are the elements around it, the words of their classes, ids and roles, and the shape of its text; none
depends on a language. The field has two labels, text and clutter, weights for every feature and for every pair of neighbouring
labels. It is trained on labelled pages that ``labelled_pages`` lays out in many ways, and decoded by Viterbi.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.arrays import made_on_a_worker, values
from spindrift.llm.page_blocks import Block, Node, blocks

#: Labelled pages that the field is trained on, and the seed of their layouts.
PAGES, SEED = 400, 5
TURNS, RATE, PENALTY = 200, 0.15, 0.001


#: Share of the elements whose name says nothing of their part.
UNNAMED = 0.2
#: Names that layouts give to the parts of a page.
NAMES = {
    "text": "content main-content article article-body post post-content entry entry-content story story-body text body-copy page-content main".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topbar links pagination tabs".split(),
    "top": "header masthead site-header banner top logo branding".split(),
    "side": "sidebar side widget related rail recommended popular more secondary aside tags".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor".split(),
    "notice": "cookie cookies consent notice alert message popup modal gdpr disclaimer newsletter subscribe".split(),
    "talk": "comments comment comment-list discussion replies responses reply".split(),
    "bottom": "footer site-footer copyright bottom legal foot colophon".split(),
    "share": "share social sharing buttons toolbar meta byline".split(),
    "box": "container wrapper page row col grid layout inner outer site wrap".split(),
}
KNOWN = frozenset(w for kind in NAMES.values() for name in kind for w in name.split("-"))


def known(named: tuple[str, ...]) -> set[str]:
    """The words of a name that layouts share; all others are one, as they say no more than that the element has a name."""
    return {w if w in KNOWN else "?" for w in named}


def element_features(node: Node) -> set[str]:
    """What an element tells about all blocks within it."""
    return {f"in {node.name}", *(f"named {w}" for w in known(node.named))}


def place_features(node: Node | None) -> set[str]:
    """What the innermost element and section tell about a block."""
    if node is None:
        return set()
    near = node.near
    return {f"own {node.name}"} if near is None else {f"own {node.name}", f"near {near.name}", *(f"near named {w}" for w in known(near.named))}


def path_features(node: Node | None) -> set[str]:
    return place_features(node).union(*map(element_features, node.path())) if node else set()


def text_features(block: Block) -> list[str]:
    text, n = block.text, block.text.count(" ") + 1
    share = block.linked / len(text)
    return [
        "words 1-2" if n < 3 else "words 3-7" if n < 8 else "words 8-19" if n < 20 else "words 20-",
        "no link" if share == 0 else "some link" if share < 0.5 else "link",
        "ends" if text[-1] in ".!?…。\"»”:" else "open",
        "marks" if any(c in text for c in ",;:") else "plain",
        *(["sign"] if "©" in text or "|" in text or "»" in text else []),
    ]


class Field:
    """Weights of the label text over clutter by feature, and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, start: float):
        self.weights, self.steps, self.start = weights, steps.tolist(), start

    def of_paths(self, page: list[Block]) -> Iterator[float]:
        """The weight of each block's elements, a feature counting once, by walking from block to block through the tree."""
        get, stack, held, total = self.weights.get, [], Counter(), 0.0
        for block in page:
            new, node = [], block.node
            while node is not None and (node.depth > len(stack) or stack[node.depth - 1] is not node):
                new.append(node)
                node = node.parent
            while len(stack) > (node.depth if node else 0):
                for f in element_features(stack.pop()):
                    held[f] -= 1
                    total -= 0 if held[f] else get(f, 0.0)
            for node in reversed(new):
                stack.append(node)
                for f in element_features(node):
                    held[f] += 1
                    total += get(f, 0.0) if held[f] == 1 else 0
            yield total + sum(get(f, 0.0) for f in place_features(block.node))

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, 1 for text, by Viterbi."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.steps
        get = self.weights.get
        back, a, b = [], 0.0, self.start
        for i, (block, path) in enumerate(zip(page, self.of_paths(page), strict=True)):
            own = path + sum(get(f, 0.0) for f in text_features(block))
            if i:
                from_a, from_b = b + ba > a + aa, b + bb > a + ab
                back.append((int(from_a), int(from_b)))
                a, b = max(a + aa, b + ba), max(a + ab, b + bb)
            b += own
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]]) -> Field:
    """The field that maximises the penalised likelihood of the pages' labels, by Adam over all pages at once."""
    pages = [p for p in pages if p[0]]
    features: dict[str, int] = {}
    each = [[[features.setdefault(f, len(features)) for f in (*sorted(path_features(b.node)), *text_features(b))] for b in page] for page, _ in pages]
    longest = max(len(p) for p in each)
    x = np.zeros((len(pages), longest, len(features)), dtype=np.float32)
    y, there = np.zeros((len(pages), longest), dtype=int), np.zeros((len(pages), longest), dtype=bool)
    for i, page in enumerate(each):
        there[i, : len(page)] = True
        y[i, : len(page)] = pages[i][1]
        for j, found in enumerate(page):
            x[i, j, found] = 1
    both = there[:, 1:]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    flat, known = x[there], y[there]
    w, mean, square = (np.zeros(len(features) + 5) for _ in range(3))  # features, four steps, the start
    for turn in range(1, TURNS + 1):
        steps, start = w[-5:-1].reshape(2, 2), w[-1]
        unary = np.zeros((len(pages), longest, 2))
        unary[there, 1] = flat @ w[:-5].astype(np.float32)
        unary[:, 0, 1] += start
        ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
        ahead[:, 0] = unary[:, 0]
        for t in range(1, longest):
            on = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + unary[:, t]
            ahead[:, t] = np.where(there[:, t, None], on, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = unary[:, t + 1] + behind[:, t + 1]
            on = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
            behind[:, t] = np.where(there[:, t + 1, None], on, 0.0)
        total = np.logaddexp(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
        p = np.exp(ahead + behind - total[:, None, None])[..., 1]
        pair = np.exp(ahead[:, :-1, :, None] + steps + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        gradient = np.concatenate([flat.T @ (known - p[there]), (seen - pair.sum((0, 1))).ravel(), [(y[:, 0] - p[:, 0]).sum()]])
        gradient = gradient / len(pages) - PENALTY * w
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return Field({f: float(w[i]) for f, i in features.items()}, w[-5:-1].reshape(2, 2), float(w[-1]))


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages of random words in many layouts, each as its html and the pieces of its text with label 1 for main text."""
    return [_Layout(random.Random(f"{seed}/{i}")).page() for i in range(n)]


class _Layout:
    def __init__(self, r: random.Random):
        self.r = r
        self.truth: list[tuple[str, int]] = []
        self.serial = 0
        self.loose = r.random() < 0.3  # end tags left out
        self.short = r.choice((0.05, 0.1, 0.6))  # share of the paragraphs with few words

    def word(self) -> str:
        return "".join(self.r.choice("bcdfglmnprst") + self.r.choice("aeiou") for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int, stop: str = "", label: int = 0) -> str:
        self.serial += 1
        n = self.r.randint(low, high)
        text = [f"w{self.serial}x"] + [self.word() for _ in range(n - 1)]
        for i in range(5, n - 1, 9):
            text[i] += self.r.choice(",.;,")
        self.truth.append((text[0], label))
        return " ".join(text) + stop

    def el(self, name: str, inside: str, kind: str = "") -> str:
        named = ""
        if kind:
            # Some names mean nothing, as many do on real pages.
            chosen = self.word() if self.r.random() < UNNAMED else " ".join(self.r.sample(NAMES[kind], self.r.choice((1, 1, 2))))
            named = f' {self.r.choice(("class", "class", "id"))}="{chosen}"'
        end = "" if self.loose and name in ("p", "li", "td", "tr") and self.r.random() < 0.5 else f"</{name}>"
        return f"<{name}{named}>{inside}{end}"

    def links(self, low: int, high: int) -> str:
        return "".join(self.el("li", f'<a href="/{i}">{self.words(1, 4)}</a>') for i in range(self.r.randint(low, high)))

    def part(self, kind: str, element: str, inside: str) -> str:
        plain = self.r.random()
        if plain < 0.45:
            return self.el(element, inside)
        if plain < 0.7:
            return self.el(element, inside, kind)
        return self.el("div", inside, kind)

    def menu(self) -> str:
        return self.part("menu", "nav", self.el("ul", self.links(2, 8)) if self.r.random() < 0.8 else "".join(f'<a href="#">{self.words(1, 3)}</a> ' for _ in range(4)))

    def top(self) -> str:
        return self.part("top", "header", self.r.choice((self.el("h1", f"<a>{self.words(1, 4)}</a>"), self.el("div", self.words(2, 6)), self.el("p", self.words(3, 12, ".")))) + (self.menu() if self.r.random() < 0.5 else ""))

    def ad(self) -> str:
        return self.el(self.r.choice(("div", "div", "section", "aside")), self.r.choice((self.words(3, 25, "."), self.el("p", self.words(3, 25, ".")), f"<a>{self.words(2, 8)}</a>")), "ad")

    def side(self) -> str:
        inside = self.el(self.r.choice(("h2", "h3", "h4")), self.words(1, 4)) + self.r.choice((self.el("ul", self.links(2, 7)), self.el("p", self.words(5, 40, ".")), self.el("div", self.words(3, 20, "."))))
        return self.part("side", "aside", inside)

    def notice(self) -> str:
        return self.el(self.r.choice(("div", "div", "section", "aside", "dialog")), self.r.choice((self.words(5, 30, "."), self.el("p", self.words(5, 30, ".")) + self.el("button", self.words(1, 2)))), "notice")

    def form(self) -> str:
        return self.el("form", self.r.choice(("", self.el("p", self.words(3, 20, ".")))) + self.el("label", self.words(1, 4)) + '<input type="text">' + self.el("button", self.words(1, 2)))

    def talk(self) -> str:
        one = lambda: self.el(self.r.choice(("div", "li", "article")), self.el("span", self.words(1, 2)) + self.el("p", self.words(3, 60, ".")), "talk")
        return self.el(self.r.choice(("div", "section", "ol")), self.el("h3", self.words(1, 3)) + "".join(one() for _ in range(self.r.randint(1, 4))), "talk")

    def bottom(self) -> str:
        return self.part("bottom", "footer", self.r.choice(("&copy; ", "", "")) + self.r.choice((self.words(4, 30, "."), self.el("p", self.words(4, 30, ".")), self.el("ul", self.links(2, 6)))))

    def text(self, inside_article: bool) -> str:
        w = lambda low, high, stop="": self.words(low, high, stop, 1)
        out = []
        if self.r.random() < 0.85:
            title = self.el("h1", w(2, 14))
            out.append(self.el("header", title) if inside_article and self.r.random() < 0.15 else title)
        if self.r.random() < 0.15:
            out.append(self.el("div", self.words(1, 6), "share"))
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.68:
                out.append(self.el("p", self.r.choice(("", "", "<b>")) + (w(1, 7, self.r.choice((".", ""))) if self.r.random() < self.short else w(8, 110, self.r.choice("..!?"))) + self.r.choice(("", "", f' <a href="#">{w(1, 5)}</a> {w(2, 20, ".")}', "<br>" + w(4, 30, ".")))))
            elif kind < 0.76:
                out.append(self.el(self.r.choice(("h2", "h3")), w(1, 8)))
            elif kind < 0.84:
                out.append(self.el(self.r.choice(("ul", "ol")), "".join(self.el("li", w(2, 25, self.r.choice((".", "")))) for _ in range(self.r.randint(2, 6)))))
            elif kind < 0.88:
                out.append(self.el("blockquote", self.el("p", w(6, 40, "."))))
            elif kind < 0.91:
                out.append(self.el("table", "".join(self.el("tr", self.el("td", w(1, 5)) + self.el("td", w(1, 5))) for _ in range(3))))
            elif kind < 0.94:
                out.append(self.el("pre", w(4, 20)))
            else:
                out.append(self.r.choice((self.ad, self.side, self.notice, self.form))())
        if self.r.random() < 0.1:
            out.append(self.talk())
        return "".join(out)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        head = f"<head><title>{self.words(2, 10)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head>"
        before = [f() for f in (self.notice, self.top, self.menu, self.ad, self.form, self.side) if self.r.random() < 0.5]
        how = self.r.random()
        if how < 0.4:
            body = self.el("article", self.text(True))
        elif how < 0.55:
            body = self.el("main", self.text(False))
        elif how < 0.65:
            body = self.el("main", self.el("article", self.text(True), "text"))
        elif how < 0.92:
            body = self.el(self.r.choice(("div", "div", "section", "td")), self.text(False), "text")
        else:
            body = self.text(False)
        after = [f() for f in (self.ad, self.talk, self.side, self.form, self.menu, self.notice) if self.r.random() < 0.35]
        if self.r.random() < 0.85:
            after.append(self.bottom())
        inside = "".join([*before, body, *after])
        for _ in range(self.r.randint(0, 2)):
            inside = self.el("div", inside, "box")
        return f"<!DOCTYPE html><html>{head}<body>{inside}" + self.r.choice(("", "</body></html>")), self.truth


def labelled(html: str, truth: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """A page's blocks with the label of the first marked word in each."""
    page, of = blocks(html), dict(truth)
    return page, [next((of[w] for w in b.text.replace(",", " ").replace(".", " ").replace(";", " ").split() if w in of), 0) for b in page]


@lru_cache(maxsize=1)
def trained() -> Field:
    return train([labelled(*page) for page in labelled_pages()])


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return " ".join(b.text for b, label in zip(page, field.decode(page), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row with ``text``, its page's main text, and ``n_chars``, the text's code points.

    A null or empty page, or one without main text, has an empty text. Repeated rows and null ids come back like any other;
    other columns play no part. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(field or made_on_a_worker(spark.range(1), lambda rows: trained()))
    rows = pages.select(*keep, F.col(html_col).alias("__html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = pa.array((main_text(h, own) for h in values(batch.column(batch.num_columns - 1))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(of, f"{columns}, text string").withColumn("n_chars", F.char_length("text").cast("long"))
