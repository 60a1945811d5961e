"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags), each with the path of elements above it.
A two-label chain (article or not) scores each block by features of its ancestors (tags, class and id words, the
nearest sections) and of its text (length, links, punctuation, furniture words), and each pair of neighbours by their
labels; Viterbi gives the page's best labelling and the article blocks are joined in page order.

The model is trained here, by gradient ascent on the conditional likelihood, on labelled pages that `labelled_pages`
makes: `TRAIN_PAGES` pages of several layouts, a documented bound that doesn't grow with the corpus.

Null, empty or text-free html: empty text. Broken markup: tags are closed as browsers close them, and a `<` that starts no
tag is text; elements nested deeper than `DEPTH` replace each other. Very long or broken pages: whole, in linear time.
Ties and repeated rows: one result each. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, EPOCHS, RATE = 240, 8, 0.3

#: HTML's element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template svg math title iframe object canvas audio video select textarea".split())
SECTIONS = frozenset("article main nav header footer aside form section dialog figure table body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of page furniture in short blocks.
FURNITURE = frozenset("cookie cookies subscribe newsletter advertisement sponsored copyright login register menu privacy terms share comments reply related search home contact".split())

DEPTH = 256

_NAME, _MARK = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSERS = {t: re.compile(f"</{t}\\s*>", re.I) for t in UNREAD}

Path = tuple[tuple[str, str], ...]


class _Ends:
    """Ends of a page's tags. Every quote is followed once, so pages of broken tags take linear time too."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes, self.asked, self.bare = html, {}, (0, _at(_MARK, html, 0)), (0, html.find(">"))

    def plain(self, at: int) -> int:
        """First `>` from `at` on; -1: none. Asked in ascending order."""
        if -1 < self.bare[1] < at:
            self.bare = at, self.html.find(">", at)
        return self.bare[1]

    def quoted(self, at: int) -> int:
        """First `>` from `at` on that stands in no quotes; -1: none. Asked in ascending order."""
        if -1 < self.asked[1] < at:
            self.asked = at, _at(_MARK, self.html, at)
        mark, trail = self.asked[1], []
        while mark >= 0 and self.html[mark] != ">":
            if mark in self.quotes:
                mark = self.quotes[mark]
                break
            trail.append(mark)
            close = self.html.find(self.html[mark], mark + 1)
            mark = _at(_MARK, self.html, close + 1) if close >= 0 else -1
        self.quotes.update(dict.fromkeys(trail, mark))
        return mark


def _at(what: re.Pattern[str], text: str, start: int) -> int:
    found = what.search(text, start)
    return found.start() if found else -1


def tokens(html: str) -> Iterator[tuple[str, bool, str, int]]:
    """(tag or empty, closing, attributes or text, end) in page order; a caller may send the place to go on from."""
    ends, at, n = _Ends(html), 0, len(html)
    while at < n:
        if html[at] != "<":
            stop = html.find("<", at)
            stop = n if stop < 0 else stop
            token = "", False, html[at:stop], stop
        elif html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            at = n if stop < 0 else stop + 3
            continue
        elif (plain := ends.plain(at)) < 0:  # no tag any more
            stop = html.find("<!--", at)
            stop = n if stop < 0 else stop
            token = "", False, html[at:stop], stop
        elif html[at + 1] in "!?":
            at = plain + 1
            continue
        else:
            closing = html[at + 1] == "/"
            name = _NAME.match(html, at + 1 + closing)
            if name is None:
                token = "", False, "<", at + 1
            else:
                stop = ends.quoted(name.end())
                stop = plain if stop < 0 else stop
                token = name[0].lower(), closing, html[name.end() : stop], stop + 1
        jump = yield token
        at = jump or token[3]


def blocks(html: str) -> list[tuple[Path, str, float]]:
    """(path, text, share of linked characters) of each leaf block in page order; a path holds (tag, class and id)."""
    out: list[tuple[Path, str, float]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = total = 0
    in_link = False

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((tuple(stack), text, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    counts: dict[str, int] = {}

    def leave(depth: int) -> None:
        for tag, _ in stack[depth:]:
            counts[tag] -= 1
        del stack[depth:]

    stream, jump = tokens(html), None
    while True:
        try:
            tag, closing, rest, at = stream.send(jump)
        except StopIteration:
            break
        jump = None
        if not tag:
            text = unescape(rest)
            parts.append(text)
            n = len(text.strip())
            total += n
            linked += n * in_link
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in INLINE or tag in VOID and tag != "hr":
            pass
        elif tag in UNREAD:
            if not closing and not rest.endswith("/"):
                found = _CLOSERS[tag].search(html, at)
                jump = found.end() if found else len(html)
        elif closing:
            flush()
            if counts.get(tag):
                leave(max(i for i, x in enumerate(stack) if x[0] == tag))
        else:
            flush()
            if tag == "hr":
                continue
            ends, bounds = {"p", *CLOSES.get(tag, ())}, HOLDS.get(tag, ())
            if any(counts.get(t) for t in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in ends:
                        leave(i)
                        break
            if tag not in ("html", "body") or not counts.get(tag):
                names = " ".join(x for g in _NAMES.findall(rest) for x in g if x).lower()
                leave(DEPTH - 1)
                stack.append((tag, names))
                counts[tag] = counts.get(tag, 0) + 1
    flush()
    return out


def path_features(path: Path) -> list[str]:
    found = {f"tag:{t}" for t, _ in path}
    sections = [t for t, _ in path if t in SECTIONS and t != "body"]
    found.add(f"near:{sections[-1] if sections else 'none'}")
    found.add(f"sections:{'>'.join(sections[-2:])}")
    found.add(f"parent:{path[-1][0] if path else 'none'}")
    for depth, (tag, names) in enumerate(reversed(path)):
        for w in _WORD.findall(names):
            found.add(f"name:{w}")
            if depth == 0:
                found.add(f"own:{w}")
            if tag == "article":
                found.add(f"article:{w}")
    return sorted(found)


def text_features(text: str, links: float, first: bool, last: bool) -> list[str]:
    words = text.split()
    n = min(5, int(math.log2(len(words) + 1)))
    link = 0 if links < 0.1 else 1 if links < 0.6 else 2
    stop = text.rstrip("\"')]»”’")[-1:] in ".!?…。！？"
    found = [f"words:{n}", f"links:{link}", f"size:{n}:{link}", f"stop:{stop}:{n > 2}"]
    if len(words) <= 25:
        found += sorted({f"says:{w}" for w in _WORD.findall(text.lower()) if w in FURNITURE})
        if "©" in text:
            found.append("says:©")
    return found + ["first"] * first + ["last"] * last


class ChainModel:
    """Two-label chain: emission score of label 1 by features, and a table of neighbouring labels."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.steps = [[0.0, 0.0], [0.0, 0.0]]
        self.paths: dict[Path, float] = {}

    def emissions(self, page: list[tuple[Path, str, float]]) -> list[float]:
        out, get = [], self.weights.get
        for i, (path, text, links) in enumerate(page):
            score = self.paths.get(path)
            if score is None:
                score = sum(get(f, 0.0) for f in path_features(path))
                if len(self.paths) < 50_000:
                    self.paths[path] = score
            out.append(score + sum(get(f, 0.0) for f in text_features(text, links, i == 0, i == len(page) - 1)))
        return out

    def decode(self, page: list[tuple[Path, str, float]]) -> list[int]:
        """Viterbi's labels."""
        if not page:
            return []
        steps, scores = self.steps, self.emissions(page)
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            zero, one = (a + steps[0][0], b + steps[1][0]), (a + steps[0][1], b + steps[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            a, b = max(zero), max(one) + s
        labels = [int(b > a)]
        for z, o in reversed(back):
            labels.append((z, o)[labels[-1]])
        return labels[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-4) -> None:
        """Adaptive gradient ascent on the log likelihood; `pages` hold features and labels of each block."""
        squares: dict[object, float] = {}

        def move(key: object, table: dict | list, at: object, gradient: float) -> None:
            g = gradient - decay * (table[at] if isinstance(table, list) else table.get(at, 0.0))
            squares[key] = squares.get(key, 1e-6) + g * g
            table[at] = (table[at] if isinstance(table, list) else table.get(at, 0.0)) + rate * g / math.sqrt(squares[key])

        for _ in range(epochs):
            for features, labels in pages:
                scores = [sum(self.weights.get(f, 0.0) for f in fs) for fs in features]
                n, steps = len(labels), self.steps
                fore, norm = [], []
                for t, s in enumerate(scores):
                    e = math.exp(max(-50.0, min(50.0, s)))
                    if t == 0:
                        x = [1.0, e]
                    else:
                        x = [sum(fore[-1][i] * math.exp(steps[i][j]) for i in (0, 1)) * (e if j else 1.0) for j in (0, 1)]
                    z = sum(x)
                    norm.append(z)
                    fore.append([v / z for v in x])
                later = [[1.0, 1.0] for _ in range(n)]
                for t in range(n - 2, -1, -1):
                    e = math.exp(max(-50.0, min(50.0, scores[t + 1])))
                    later[t] = [sum(math.exp(steps[i][j]) * (e if j else 1.0) * later[t + 1][j] for j in (0, 1)) / norm[t + 1] for i in (0, 1)]
                for t in range(n):
                    p = fore[t][1] * later[t][1]
                    q = fore[t][0] * later[t][0]
                    for f in features[t]:
                        move(f, self.weights, f, labels[t] - p / (p + q))
                for t in range(1, n):
                    e = math.exp(max(-50.0, min(50.0, scores[t])))
                    joint = [[fore[t - 1][i] * math.exp(steps[i][j]) * (e if j else 1.0) * later[t][j] for j in (0, 1)] for i in (0, 1)]
                    z = sum(map(sum, joint))
                    for i in (0, 1):
                        for j in (0, 1):
                            move((i, j), steps[i], j, float(labels[t - 1] == i and labels[t] == j) - joint[i][j] / z)
        self.paths.clear()


def labelled_pages(count: int, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """Made pages of several layouts, each with the texts of its article blocks in page order."""
    rng = random.Random(seed)
    syllables = "an ba ci de el fo ga hi in jo ka lu ma no or pe qui ra su ti un ve wa ze".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def phrase(lo: int, hi: int, stop: str = "") -> str:
        words = [word() for _ in range(rng.randint(lo, hi))]
        words = [w + "," if rng.random() < 0.08 else w + rng.choice("#*%&$|") * 2 if noisy and rng.random() < 0.5 else w for w in words[:-1]] + words[-1:]
        return " ".join(words).capitalize() + stop

    def sentences(lo: int, hi: int) -> str:
        return " ".join(phrase(1, 18, rng.choice("...!?")) for _ in range(rng.randint(lo, hi)))

    def wrap(tag: str, body: str, names: str = "") -> str:
        kind = rng.choice(["class", "id"])
        return f'<{tag} {kind}="{names}">{body}</{tag}>' if names else f"<{tag}>{body}</{tag}>"

    def links(k: int) -> str:
        return wrap("ul", "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(k)))

    def escaped(text: str) -> str:
        return text.replace("&", "&amp;")

    for _ in range(count):
        noisy = rng.random() < 0.1
        good: list[str] = []

        def keep(text: str) -> str:
            good.append(" ".join(text.split()))
            return escaped(text)

        def body() -> str:
            out = [wrap(rng.choice(["h1", "h1", "h2"]), keep(phrase(1, 12, rng.choice(["", "."]))))]
            for _ in range(rng.randint(1, 9)):
                roll = rng.random()
                if roll < 0.62:
                    out.append(f"<p>{keep(sentences(1, 6))}</p>")
                elif roll < 0.74:
                    out.append(f"<p><b>{keep(phrase(1, 12, '.'))}<br>")
                elif roll < 0.82:
                    out.append(wrap("h2", keep(phrase(1, 6))))
                elif roll < 0.9:
                    out.append("<ul>" + "".join(f"<li>{keep(sentences(1, 1))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
                else:
                    out.append(wrap("blockquote", f"<p>{keep(sentences(1, 2))}</p>"))
                if rng.random() < 0.08:
                    out.append(rng.choice([lambda: wrap("div", phrase(3, 14, "."), rng.choice(["ad", "ads advert", "promo", "sponsored"])), lambda: wrap("aside", phrase(2, 12, "."), rng.choice(["", "related", "pullout"])), lambda: wrap("div", "Share this " + links(2), rng.choice(["share", "social"]))])())
            return "".join(out)

        def comments() -> str:
            items = "".join(wrap(rng.choice(["div", "li", "p"]), sentences(1, 3), rng.choice(["", "comment", "comment-body"])) for _ in range(rng.randint(1, 5)))
            return wrap(rng.choice(["div", "section", "ol"]), wrap("h3", "Comments") + items, rng.choice(["comments", "comment-list", "discussion comments", "responses"]))

        def before() -> list[str]:
            return [
                wrap("nav", links(rng.randint(3, 7)), rng.choice(["", "", "menu", "navbar"])),
                wrap("header", wrap("div", phrase(1, 3)) + links(3), rng.choice(["", "site-header", "masthead"])),
                wrap("div", phrase(3, 15, "."), rng.choice(["ad", "ad", "advert", "banner-ad", "promo"])),
                wrap("div", f"We use cookies. {sentences(1, 1)}", rng.choice(["cookie-notice", "consent", "notice", "cookie banner"])),
                wrap("div", links(rng.randint(3, 6)), rng.choice(["menu", "nav", "topbar"])),
                wrap("div", links(rng.randint(1, 3)), "breadcrumb"),
                wrap("form", '<input name="q">' + phrase(1, 4) + "<button>Search</button>", rng.choice(["", "search"])),
            ]

        def after() -> list[str]:
            return [
                wrap("aside", wrap("h3", phrase(1, 3)) + links(4) + f"<p>{phrase(3, 12, '.')}</p>", rng.choice(["", "sidebar"])),
                wrap("div", wrap("h3", phrase(1, 3)) + f"<p>{sentences(1, 2)}</p>" + links(3), rng.choice(["sidebar", "widget", "related"])),
                comments(),
                wrap("form", f"<p>Subscribe to our newsletter. {phrase(2, 8, '.')}</p><button>Go</button>", rng.choice(["", "newsletter", "signup"])),
                wrap("footer", f"&copy; {word()}.example &middot; {sentences(1, 2)}", rng.choice(["", "site-footer"])),
                wrap("div", f"&copy; {word()} {phrase(2, 9, '.')}", rng.choice(["footer", "foot legal"])),
                wrap("div", phrase(3, 15, "."), rng.choice(["ad", "advert", "sponsored"])),
            ]

        top, tail = before(), after()
        layout = rng.random()
        if layout < 0.4:
            pre = top[0] + f"<!-- ad {rng.randint(0, 99)} -->" + top[2]
            article, post = wrap("article", body()), tail[4]
        else:
            pre = "".join(x for x in rng.sample(top, rng.randint(1, 4)))
            if layout < 0.6:
                article = wrap("article", body() + (comments() if rng.random() < 0.3 else ""))
                article = wrap("main", article) if rng.random() < 0.5 else article
            elif layout < 0.7:
                article = wrap("main", body(), rng.choice(["", "content"]))
            elif layout < 0.9:
                article = wrap("div", body(), rng.choice(["content", "post", "entry-content", "article-body", "main", "story", "post-content"]))
            else:
                article = f'<table><tr><td class="menu">{links(4)}</td><td class="content">{body()}</td></tr></table>'
            post = "".join(rng.sample(tail, rng.randint(1, 4)))
        head = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
        yield head + pre + article + post + rng.choice(["</body></html>", ""]), good


def labelled(html: str, good: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a made page: its article texts are matched in page order."""
    page, at, labels, features = blocks(html), 0, [], []
    for i, (path, text, links) in enumerate(page):
        hit = at < len(good) and text == good[at]
        at += hit
        labels.append(int(hit))
        features.append(path_features(path) + text_features(text, links, i == 0, i == len(page) - 1))
    if at != len(good):
        raise AssertionError("a made page isn't cut into its blocks")
    return features, labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> ChainModel:
    model = ChainModel()
    model.train([labelled(*p) for p in labelled_pages(pages, seed)])
    return model


def main_text(html: str, model: ChainModel) -> str:
    page = blocks(html)
    return "\n".join(text for (_, text, _), y in zip(page, model.decode(page), strict=True) if y)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: ChainModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row. The trained weights, a few thousand numbers, travel with the task."""
    model = model or trained()
    weights, steps = model.weights, model.steps
    spec = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ChainModel()
        own.weights, own.steps = weights, steps
        for batch in batches:
            texts = [main_text(h or "", own) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in spec.schema.fields}
    return spec.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
