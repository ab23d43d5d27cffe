"""Articles in layouts of all kinds, from a generator that shares nothing with the module; texts against the standard library's parser."""

import html.parser
import random
import re

import pytest

from terralith.llm import html as pages

WORDS = """the river rose in night and people of lower town moved to hills by noon water had gone nobody was hurt market opened again school
children saw boats where streets used be council promised new walls before winter but few believed them as last spring ended with same words
farmer lost nine sheep baker gave bread away for free while engineers measured old bridge twice""".split()
FLOOD = ["Flood in town", "The river rose in the night and the people of the lower town moved to the hills.", "By noon the water had gone. Nobody was hurt, and the market opened again."]
H, P, Q = f"<h1>{FLOOD[0]}</h1>", f"<p>{FLOOD[1]}</p>", f"<p>{FLOOD[2]}</p>"


class Blocks(html.parser.HTMLParser):
    """Texts of h1, h2, p and li in page order, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "p", "li"):
            self.found.append("")
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag not in ("h1", "h2", "p", "li")

    def handle_data(self, data):
        if self.open:
            self.found[-1] += data

    @classmethod
    def of(cls, markup):
        self = cls()
        self.feed(markup)
        self.close()
        return [" ".join(t.split()) for t in self.found if t.strip()]


@pytest.fixture(scope="module")
def model(spark):
    return pages.train_pages(pages.labelled_pages(spark))


@pytest.mark.parametrize(
    "page,more",
    [
        (f"<body><article><header>{H}<p>By A. Writer</p></header>{P}{Q}<footer>Filed under news</footer></article></body>", ["By A. Writer"]),
        (f"<body><main><article><header>{H}</header><section>{P}</section><section>{Q}</section></article></main></body>", []),
        (f"<html><body>{H}{P}{Q}</body></html>", []),
        (f"<body><div class='css-1x9'>{H}</div><div class='css-8ab'>{P}</div><div class='sc-9zz'>{Q}</div></body>", []),
        (f"<body><header><a href=/>Home</a></header><div class=x1><div class=y3>{H}</div><div class=y4>{P}</div><div class=y4>{Q}</div></div><aside><ul><li><a href=a>One</a></li></ul></aside></body>", []),
    ],
)
def test_no_layout_loses_the_article(spark, model, page, more):
    got = pages.extract(spark.createDataFrame([(page,)], "html string"), model).head()["text"].split("\n")
    assert [t for t in got if t not in more] == FLOOD


def sentence(rng):
    words = rng.choices(WORDS, k=rng.randint(6, 25))
    return " ".join(words).capitalize() + rng.choice([".", ".", "?", " &amp; more.", " &#8212; so they say."])


def paragraph(rng):
    return f"<p>{' '.join(sentence(rng) for _ in range(rng.randint(1, 5)))}</p>"


def menu(rng):
    items = "".join(f"<li><a href='/{w}'>{w.title()}</a></li>" for w in rng.sample(WORDS, rng.randint(3, 7)))
    return rng.choice(["<nav><ul>{}</ul></nav>", "<nav class=top><ul>{}</ul></nav>", "<aside><ul>{}</ul></aside>", "<div class=menu><ul>{}</ul></div>"]).format(items)


def composed(rng):
    """(page, blocks of the article)."""
    inner = [f"<h1>{' '.join(rng.choices(WORDS, k=rng.randint(2, 7))).capitalize()}</h1>"]
    for _ in range(rng.randint(2, 8)):
        inner.append(rng.choice([paragraph(rng)] * 5 + [f"<h2>{rng.choice(WORDS).title()} {rng.choice(WORDS)}</h2>", f"<ul><li>{sentence(rng)}</li><li>{sentence(rng)}</li></ul>", f"<blockquote>{paragraph(rng)}</blockquote>"]))
    expected = Blocks.of("".join(inner))
    hidden = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(6))
    kind = rng.randrange(6)
    if kind == 0:
        body = f"<article><header>{inner[0]}</header>{''.join(inner[1:])}<footer>{rng.choice(WORDS)} {rng.choice(WORDS)}</footer></article>"
    elif kind == 1:
        body = f"<main><article>{inner[0]}" + "".join(f"<section>{b}</section>" for b in inner[1:]) + "</article></main>"
    elif kind == 2:
        body = "".join(inner)
    elif kind == 3:
        body = "".join(f"<div class='m-{hidden()}'>{b}</div>" for b in inner)
    elif kind == 4:
        body = f"<div id=root><div class={hidden()}><div class={hidden()}>{''.join(inner)}</div></div></div>"
    else:
        body = f"<div class=post><article class=entry>{''.join(inner)}</article></div>"
    foot = rng.choice(["", "<footer><p>&copy; 2020 The Gazette. All rights reserved.</p></footer>", "<footer>&copy; The Gazette</footer>"])
    return f"<!doctype html><html><head><title>x</title><script>if (a < b) f('<p>no</p>')</script></head><body>{rng.choice(['', menu(rng), menu(rng)])}{body}{rng.choice(['', menu(rng)])}{foot}</body></html>", expected


def test_words_of_articles_in_many_layouts(spark, model):
    rng = random.Random(21)
    made = [composed(rng) for _ in range(300)]
    got = [r["text"] for r in pages.extract(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(made)], "i long, html string"), model).orderBy("i").collect()]
    kept = lost = extra = 0
    for text, (_, expected) in zip(got, made, strict=True):
        blocks = text.split("\n")
        for b in expected:
            n = len(re.findall(r"\w+", b))
            kept, lost = (kept + n, lost) if b in blocks else (kept, lost + n)
        extra += sum(len(re.findall(r"\w+", b)) for b in blocks if b not in expected)
    assert kept / (kept + lost) >= 0.98
    assert kept / (kept + extra) >= 0.98
