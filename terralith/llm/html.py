"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with its runs of text as leaves.  Each node is content or not.  Its own features
(tag, class and id words, measures of text and links) give a unary potential, and every parent-child edge has a potential by
the kind of the parent.  Sum-product messages, upward and then downward, give each node's marginal probability of being
content; the text of leaves above one half is kept, in page order.

Unary weights and edge potentials are trained together from labelled pages, by gradient ascent on the likelihood of their
labels; the messages give the expectations that the gradient needs.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._linear import dot, push, sigmoid

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
UNTIL = re.compile(r"[^=>]*+")
SPACES = re.compile(r"\s*+")
MARKS = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LABEL = re.compile(r"""\bdata-label\s*=\s*["']?(\w+)""")

# HTML elements by the way they part text.
BLOCKS = frozenset(
    "html head title body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre form fieldset figure figcaption address details summary button label center dialog menu hgroup legend option".split()
)
BREAKS = frozenset("br wbr img input hr td th".split())
CLOSES_P = frozenset("article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre form fieldset figure address details menu hr".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main body html div nav aside header footer form".split())
#: Elements that are left out with what they hold.  The first two run to the end of the page if they are never closed.
LEFT_OUT = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select")
NESTING = ("template", "svg")

BITS = 12
KINDS = ("article", "main", "section", "div", "body", "html", "nav", "aside", "footer", "header", "ul", "ol", "p", "form")


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, name, attributes) of the tags in page order; comments and LEFT_OUT elements have no name.

    One pass: each search goes on from where the last one ended, and what isn't found once isn't searched for again.  A quote
    counts only after an equals sign, and only if it is closed; a tag that is never closed is the last one.  A self-closing
    element that would be left out holds nothing; one without an end tag holds nothing either, but for scripts and styles.
    """
    at, n, last, ending = 0, len(page), {q: page.rfind(q) for q in "\"'"}, {}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                end = page.index(">", at + 4) + 1
            else:
                end = page.find("-->", at + 4) + 3
            end = n if end < 3 else end
            yield at, end, False, "", ""
            at = end
            continue
        found = NAME.match(page, at)
        if found is None:
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at) + 1 or n
                yield at, end, False, "", ""
                at = end
            else:
                at += 1
            continue
        name, k = found[1].lower(), found.end()
        while True:
            k = UNTIL.match(page, k).end()
            if k >= n or page[k] == ">":
                break
            k = SPACES.match(page, k + 1).end()
            if k < n and page[k] in last and last[page[k]] > k:
                k = page.index(page[k], k + 1) + 1
        end, attrs, ends = min(n, k + 1), page[found.end() : k], page[at + 1] == "/"
        if k >= n:
            yield at, n, False, "", ""
            return
        if name in LEFT_OUT and not ends:
            if name not in ending:
                ending[name] = closings(page, name)
            end = max(end, ending[name].get(at, n if name in LEFT_OUT[:2] else end))
            yield at, end, False, "", ""
        else:
            yield at, end, ends, name, attrs
        at = end


def closings(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name that is left out end, by the place of their start tag, in one pass.

    Those of NESTING may hold each other; of others the first end tag counts.
    """
    found, open_, at = {}, [], 0
    tag = re.compile(rf"<(/?){name}(?=[\s/>])", re.I)
    while m := tag.search(page, at):
        at = page.find(">", m.end()) + 1
        if not at:
            break
        if m[1]:
            found.update((k, at) for k in open_[-1:])
            del open_[-1:]
        elif (name in NESTING or not open_) and not (page[at - 2] == "/" and name not in LEFT_OUT[:2]):
            open_.append(m.start())
    return found


def parse(page: str) -> tuple[list[int], list[str], list[str], list[list[str]], list[int], list[int]]:
    """(parents, tags, attribute text, pieces of text, characters inside links, labels or -1) of the nodes in page order.

    Node 0 is the page.  Leaves have the tag #text.  Inline elements don't part text; br counts as white space; scripts,
    styles, comments and the like are left out.  Missing end tags are implied as far as blocks need it.
    """
    parents, tags, attrs, texts, links, labels = [-1], [""], [""], [[]], [0], [-1]
    stack, leaf, in_link, at = [0], -1, 0, 0
    opened: dict[str, int] = {}  # elements on the stack by tag, so that it is searched only for what is there

    def close(k: int) -> None:
        nonlocal leaf
        for i in stack[k:]:
            opened[tags[i]] -= 1
        del stack[k:]
        leaf = -1

    def say(text: str) -> None:
        nonlocal leaf
        if leaf < 0:
            if not text.strip(" \t\r\n\f"):
                return
            leaf = len(parents)
            parents.append(stack[-1])
            tags.append("#text")
            attrs.append("")
            texts.append([])
            links.append(0)
            labels.append(-1)
        texts[leaf].append(text)
        if in_link:
            links[leaf] += len(text.strip())

    for start, end, ends, name, told in tags_of(page):
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if name == "a":
            in_link = 0 if ends else 1
        elif name not in BLOCKS:
            if name in BREAKS:
                if name == "hr":
                    leaf = -1
                elif leaf >= 0:
                    texts[leaf].append(" ")
        elif ends:
            if not opened.get(name):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == name:
                    close(k)
                    break
        else:
            if name in CLOSES_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in SCOPES:
                        break
            if name in CLOSES_SAME and any(opened.get(t) for t in CLOSES_SAME[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in CLOSES_SAME[name]:
                        close(k)
                        break
                    if tags[stack[k]] in SCOPES:
                        break
            leaf, in_link = -1, 0
            label = LABEL.search(told)
            parents.append(stack[-1])
            tags.append(name)
            attrs.append(told)
            texts.append([])
            links.append(0)
            labels.append(-1 if label is None else int(label[1] == "content"))
            stack.append(len(parents) - 1)
            opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        say(page[at:])
    return parents, tags, attrs, texts, links, labels


def block_text(pieces: list[str]) -> str:
    """Character references decoded, white space turned into one space, trimmed."""
    text = "".join(pieces)
    return " ".join((html.unescape(text) if "&" in text else text).split())


_COLS: dict[str, int] = {}


def _col(name: str) -> int:
    found = _COLS.get(name)
    if found is None:
        found = crc32(name.encode()) & (1 << BITS) - 1
        if len(_COLS) < 50_000:
            _COLS[name] = found
    return found


def tree(page: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(parents, kinds of the nodes, texts, labels, columns, column offsets) of a page."""
    parents, tags, attrs, pieces, links, labels = parse(page)
    n = len(parents)
    texts = [block_text(p) if p else "" for p in pieces]
    length, linked = [len(t) for t in texts], list(links)
    for i in range(n - 1, 0, -1):
        length[parents[i]] += length[i]
        linked[parents[i]] += linked[i]
    cols: list[int] = []
    offs = [0]
    for i in range(n):
        tag = tags[i]
        share = min(3, 4 * linked[i] // max(1, length[i]))
        size = min(8, length[i].bit_length())
        if tag == "#text":
            t = texts[i]
            cols += [_col(f"in {tags[parents[i]]}"), _col(f"text {size}"), _col(f"links {share}"), _col(f"stop {t[-1:] in '.!?:;'}"), _col(f"mark {t[:1] in '©®™'}")]
        else:
            cols += [_col(f"tag {tag}"), _col(f"tag {tag} links {share}"), _col(f"size {size}")]
            if attrs[i] and ("=" in attrs[i]):
                for m in MARKS.finditer(attrs[i]):
                    value = m[2] or m[3] or m[4] or ""
                    cols += [_col(f"mark {w}") for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())]
        offs.append(len(cols))
    kinds = np.array([KINDS.index(t) if t in KINDS else len(KINDS) for t in tags], np.int64)
    return np.array(parents), kinds, texts, np.array(labels), np.array(cols, np.int64), np.array(offs)


def levels_of(parents: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth.  Parents come before their children; several pages may be joined, each with a root of parent -1."""
    depth = np.zeros(len(parents), np.int64)
    for i, p in enumerate(parents.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def marginals(parents: np.ndarray, levels: list[np.ndarray], kinds: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content by node, and of the label pairs of each node with its parent: sum-product in log space.

    ``edge``: potentials by (kind of the parent, parent's label, child's label).
    """
    n = len(parents)
    own = np.stack([np.zeros(n), unary], 1)  # with what the children say
    up = np.zeros((n, 2))
    pair = edge[kinds[np.maximum(parents, 0)]]
    for level in levels[:0:-1]:
        told = pair[level] + own[level, None, :]
        up[level] = np.logaddexp(told[:, :, 0], told[:, :, 1])
        above = parents[level]  # in order, as nodes of a level are in page order
        head = np.flatnonzero(np.diff(above, prepend=-1))
        own[above[head]] += np.add.reduceat(up[level], head, axis=0)
    full = own.copy()
    both = np.zeros((n, 2, 2))
    for level in levels[1:]:
        rest = full[parents[level]] - up[level]
        told = both[level] = pair[level] + rest[:, :, None]
        full[level] += np.logaddexp(told[:, 0], told[:, 1])
    both += own[:, None, :]
    any_ = np.logaddexp(both[:, 0], both[:, 1])
    both -= np.logaddexp(any_[:, 0], any_[:, 1])[:, None, None]
    return sigmoid(full[:, 1] - full[:, 0]), np.exp(both)


def train_pages(pages: DataFrame, rounds: int = 300, ridge: float = 1e-5) -> bytes:
    """A model from labelled pages (column html): blocks marked data-label="content" or "other", which hold for what they
    contain until marked anew; everything else is no content.  The labelled set is meant to be small: its node features are
    gathered in one task for the fit.  Null pages are empty ones; repeated pages count each; without any page all potentials are 0.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column("html").to_pylist():
                parents, kinds, _, labels, cols, offs = tree(page or "")
                for i in range(len(parents)):
                    if labels[i] < 0:
                        labels[i] = labels[parents[i]] if i else 0
                out.append([x.astype(np.int64).tobytes() for x in (parents, kinds, labels, cols, offs)])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in range(5)], names=list("pklco"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        parts = [[np.frombuffer(x, np.int64) for x in r] for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([fit_pages(parts, rounds, ridge)], pa.binary())], names=["model"])

    table = pages.select("html").mapInArrow(nodes, "p binary, k binary, l binary, c binary, o binary")
    return bytes(table.repartition(1).mapInArrow(fit, "model binary").head()["model"])


def fit_pages(parts: list[list[np.ndarray]], rounds: int, ridge: float) -> bytes:
    """Edge potentials and unary weights from (parents, kinds, labels, columns, offsets) of each page, by AdaGrad."""
    edge, w = np.zeros((len(KINDS) + 1, 2, 2)), np.zeros(1 << BITS)
    if parts:
        base = np.cumsum([0, *(len(r[0]) for r in parts)])
        parents = np.concatenate([np.where(r[0] < 0, -1, r[0] + b) for r, b in zip(parts, base, strict=False)])
        kinds, label, cols = (np.concatenate([r[k] for r in parts]) for k in (1, 2, 3))
        offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(r[4]) for r in parts]))])
        child = np.flatnonzero(parents >= 0)
        seen = np.zeros_like(edge)
        np.add.at(seen, (kinds[parents[child]], label[parents[child]], label[child]), 1)
        ones, n, levels, above = np.ones(len(cols)), len(label), levels_of(parents), kinds[parents[child]]
        squares, edge_squares = np.full(len(w), 1e-8), np.full(edge.shape, 1e-8)
        for _ in range(rounds):
            p, both = marginals(parents, levels, kinds, dot(w, cols, ones, offs), edge)
            expected = np.stack([np.bincount(above, weights=x, minlength=len(edge)) for x in both[child].reshape(-1, 4).T], 1).reshape(edge.shape)
            g, g_edge = push(label - p, cols, ones, offs, len(w)) / n - ridge * w, (seen - expected) / n - ridge * edge
            squares += g * g
            edge_squares += g_edge * g_edge
            w += 0.3 * g / np.sqrt(squares)
            edge += 0.3 * g_edge / np.sqrt(edge_squares)
    return np.concatenate([edge.ravel(), w]).tobytes()


def extract(pages: DataFrame, model: bytes, column: str = "html") -> DataFrame:
    """``pages`` with text (blocks of content joined by line feeds; empty if none) and content_probability (the mean over
    its nodes with text; null if there are none).  Columns of these names are replaced; null and empty pages give an empty
    text, a page of any length is taken whole, equal pages give equal texts, and an empty table gives no rows."""
    pages = pages.drop("content_probability", *(["text"] if column != "text" else []))
    keep = [f for f in pages.schema if f.name != column]
    schema = StructType([*keep, StructField("text", StringType()), StructField("content_probability", DoubleType())])
    bound = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.frombuffer(bound.value)
        n = (len(KINDS) + 1) * 4
        edge, w = got[:n].reshape(-1, 2, 2), got[n:]
        for batch in batches:
            texts, chance = [], []
            source = batch.column(column)
            for a in range(0, len(source), 256):
                trees = [tree(page or "") for page in source[a : a + 256].to_pylist()]
                base = np.cumsum([0, *(len(t[0]) for t in trees)])
                parents = np.concatenate([np.where(t[0] < 0, -1, t[0] + b) for t, b in zip(trees, base, strict=False)])
                cols = np.concatenate([t[4] for t in trees])
                offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(t[5]) for t in trees]))])
                p, _ = marginals(parents, levels_of(parents), np.concatenate([t[1] for t in trees]), dot(w, cols, np.ones(len(cols)), offs), edge)
                for t, b in zip(trees, base.tolist(), strict=False):
                    with_text = [(s, q) for s, q in zip(t[2], p[b : b + len(t[2])].tolist(), strict=True) if s]
                    texts.append("\n".join(s for s, q in with_text if q > 0.5))
                    chance.append(sum(q for _, q in with_text) / len(with_text) if with_text else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(texts, pa.string()), pa.array(chance, pa.float64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def labelled_pages(spark: SparkSession, n: int = 800, seed: int = 7) -> DataFrame:
    """Pages composed at random of content and of the usual rest, labelled; the training set where none is given.

    Layouts differ: one element around the article, an article with a head and a foot of its own, sections, paragraphs that
    stand in the body, and blocks that each lie in an element with a name made by a program.  Where names tell nothing, what
    isn't content can be told by its elements and links.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(1, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: " ".join(line(1, 30).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(1, 6)))
    name = lambda *names: f' {rng.choice(["class", "id"])}="{rng.choice(names)}{rng.choice(["", "", " box", "-1", "-wrap"])}"' if rng.random() < 0.8 else ""
    made = lambda: f' class="{rng.choice(["css-", "sc-", "x", "_", ""])}{"".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(4, 8)))}"'
    other_label = lambda text: re.sub(r"<(\w+)", r'<\1 data-label="other"', text, count=1)

    def links() -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))

    def nameless() -> str:
        """What isn't content, without a name that says so."""
        mark = lambda: made() if rng.random() < 0.6 else ""
        kind = rng.randrange(7)
        if kind == 0:
            return f"<nav{mark()}><ul>{links()}</ul></nav>"
        if kind == 1:
            return f"<div{mark()}><ul>{links()}</ul></div>"
        if kind == 2:
            return f'<header{mark()}><div{mark()}><a href="/">{line(1, 3)}</a></div><p>{line(2, 8)}</p></header>'
        if kind == 3:
            return f"<footer{mark()}><p>&copy; {line(1, 3)} &middot; {sentence()}</p></footer>"
        if kind == 4:
            return f"<aside{mark()}><h3>{line(1, 3)}</h3><ul>{links()}</ul><p>{sentence()}</p></aside>"
        if kind == 5:
            return f'<form{mark()}><label>{line(1, 3)}</label><input name="q"><button>{line(1, 2)}</button></form>'
        return f"<div{mark()}>" + "".join(f'<a href="/{word()}">{line(1, 4)}</a> ' for _ in range(rng.randint(2, 6))) + "</div>"

    def other() -> str:
        kind = rng.randrange(14)
        text = sentence()
        if kind == 0:
            return f'<nav{name("nav", "menu", "navbar", "breadcrumb")}><ul>{links()}</ul></nav>'
        if kind == 1:
            return f'<div{name("menu", "nav", "navigation", "topbar")}><ul>{links()}</ul></div>'
        if kind == 2:
            return f'<header{name("header", "site-header", "masthead", "banner")}><h1><a href="/">{line(1, 3)}</a></h1><p>{line(2, 8)}</p></header>'
        if kind == 3:
            return f'<footer{name("footer", "site-footer", "copyright")}>&copy; {line(1, 3)} &middot; {text}</footer>'
        if kind == 4:
            return f'<div class="{rng.choice(["footer", "copyright", "legal", "bottom"])}"><p>&copy; {text}</p></div>'
        if kind == 5:
            return f'<aside{name("sidebar", "related", "widget")}><h3>{line(1, 3)}</h3><ul>{links()}</ul><p>{text}</p></aside>'
        if kind == 6:
            return f'<div class="{rng.choice(["sidebar", "related", "widget", "recommended", "popular", "trending", "promo"])}"><h3>{line(1, 3)}</h3><ul>{links()}</ul></div>'
        if kind == 7:
            return f'<div class="{rng.choice(["cookie-notice", "cookie", "consent", "notice", "banner", "gdpr", "alert", "modal", "popup", "newsletter"])}"><p>{text}</p><button>{line(1, 2)}</button></div>'
        if kind in (8, 9):
            return f'<{(t := rng.choice(["div", "div", "div", "section", "aside"]))} class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "advertisement", "ad-slot", "banner-ad"])}">{rng.choice([text, "<p>" + text + "</p>"])}</{t}>'
        if kind == 10:
            return f'<form action="/{word()}" class="{rng.choice(["search", "subscribe", "login", "newsletter"])}"><label>{line(1, 3)}</label><input name="q"><button>{line(1, 2)}</button><p>{line(2, 8)}</p></form>'
        if kind in (11, 12):
            said = "".join(f'<{(t := rng.choice(["li", "div", "article"]))} class="{rng.choice(["comment", "reply"])}"><p>{sentence()}</p></{t}>' for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses", "disqus"])}"><h3>{line(1, 2)}</h3>{said}</{t}>'
        return f'<div class="{rng.choice(["share", "social", "tags", "meta", "byline", "breadcrumbs", "pagination", "pager", "toolbar"])}">{"".join(f"<a href=x>{word()}</a> " for _ in range(rng.randint(2, 6)))}{line(0, 3)}</div>'

    def content() -> str:
        parts = [f"<h1>{line(1, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.randrange(12)
            if kind < 8:
                text = sentence() if rng.random() < 0.8 else line(1, 3) + "."
                parts.append(f"<p>{rng.choice(['', '', '<b>', '<em>', '<br>'])}{text}{rng.choice(['', '<br>'])}" + ("</p>" if rng.random() < 0.85 else ""))
            elif kind == 8:
                parts.append(f"<h{rng.randint(2, 4)}>{line(1, 6)}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
            elif kind == 9:
                parts.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{rng.choice([sentence(), line(1, 4)])}</li>" for _ in range(rng.randint(2, 5))) + f"</{t}>")
            elif kind == 10:
                parts.append(rng.choice([f"<blockquote><p>{sentence()}</p></blockquote>", f"<pre>{line(3, 9)}</pre>", f"<figure><img src=x><figcaption>{line(2, 9)}</figcaption></figure>", f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>", f"<div>{sentence()}</div>"]))
            else:
                parts.append(f'<p>{sentence()} <a href="/x">{line(1, 3)}</a> {sentence()}</p>')
        for _ in range(rng.choice((0, 0, 1, 2))):
            at = rng.randint(0, len(parts))
            parts.insert(at, re.sub(r"<(\w+)", r'</p><\1 data-label="other"', other(), count=1))
        return "".join(parts)

    def article() -> str:
        """An article with a head, and mostly a foot, of its own; its paragraphs may stand in sections."""
        head = f"<header{rng.choice(['', made()])}><h1>{line(1, 9)}</h1>{rng.choice(['', f'<p>{line(2, 6)}</p>', f'<p>{sentence()}</p>'])}</header>" if rng.random() < 0.8 else f"<h1>{line(1, 9)}</h1>"
        body = [f"<p>{sentence()}</p>" if rng.random() < 0.6 else content() for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            body = [f"<section{rng.choice(['', made()])}>{rng.choice(['', f'<h2>{line(1, 5)}</h2>'])}{b}</section>" for b in body]
        foot = f'<footer data-label="other">{rng.choice([sentence(), f"<p>{sentence()}</p>", line(2, 6)])}</footer>' if rng.random() < 0.7 else ""
        return f'<article{rng.choice(["", made(), name("post", "story", "entry")])} data-label="content">{head}{"".join(body)}{foot}</article>'

    def blocks() -> list[str]:
        """Paragraphs and headings, no element around them."""
        out = [f"<h1>{line(1, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            out.append(rng.choice([f"<p>{sentence()}</p>"] * 6 + [f"<h2>{line(1, 6)}</h2>", f"<ul><li>{sentence()}</li><li>{line(1, 4)}</li></ul>", f"<blockquote><p>{sentence()}</p></blockquote>"]))
        return out

    def wrapped(block: str, depth: int, label: str) -> str:
        return f"<div{made()}{label}>{wrapped(block, depth - 1, '') if depth else block}</div>"

    def page() -> str:
        head, end = f"<!DOCTYPE html><html><head><title>{line(1, 9)}</title><style>p{{}}</style></head>", rng.choice(["</body></html>", ""])
        layout = rng.randrange(20)
        some = nameless if rng.random() < 0.7 else other
        before, after = ["".join(other_label(some()) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        if layout < 4:
            body = article()
            for _ in range(rng.randint(0, 2)):
                t = rng.choice(["div", "main", "section"])
                body = f"<{t}{rng.choice(['', made(), name('container', 'page', 'main')])}>{body}</{t}>"
            return f"{head}<body>{before}{body}{after}{end}"
        if layout < 6:
            return f'{head}<body data-label="content">{before}{"".join(blocks())}{after}{end}'
        if layout < 10:
            label, around = ' data-label="content"', rng.random() < 0.6
            body = "".join(wrapped(b, rng.choice((0, 0, 1)), "" if around else label) for b in blocks())
            return f"{head}<body>{before}" + (f"<div{rng.choice(['', made()])}{label}>{body}</div>" if around else body) + f"{after}{end}"
        before, after = ["".join(other() for _ in range(rng.randint(0, 4))) for _ in range(2)]
        tag = rng.choice(["article"] * 5 + ["main", "main", "div", "div", "section"])
        mark = name("content", "post", "article", "entry", "story", "main", "article-body", "post-content", "entry-content") if tag in ("article", "main") else f' class="{rng.choice(["content", "post", "article", "entry", "story", "article-body", "post-content", "main-content"])}"'
        body = f'<{tag}{mark} data-label="content">{content()}</{tag}>'
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(["div", "main", "section"]) + name("container", "wrapper", "page", "row", "layout", "main")
            body = f"<{t}>{other() if rng.random() < 0.3 else ''}{body}{other() if rng.random() < 0.3 else ''}</{t.split()[0]}>"
        return f"{head}<body>{before}{body}{after}{end}"

    return spark.createDataFrame([(page(),) for _ in range(n)], "html string")
