"""Page text, benchmark passages and the source mix."""

import itertools
import random
import re
import time
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import decontam, html, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return html.train_pages(html.labelled_pages(spark))


def page_text(spark, model, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").selectExpr("*", "'x' AS text", "1D AS content_probability")
    return [r["text"] for r in html.extract(rows, model).orderBy("page_id").collect()]


def test_main_text_only(spark, model):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
    <header class="site-header"><h1><a href="/">Site name</a></h1></header><nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="wrapper"><article class="post"><h1>The title</h1><p>First &amp; best\n   paragraph, with a <a href="x">link</a>.</p><!-- hidden -->
    <div class="ad">Buy this thing now.</div><p>Second&nbsp;one<br>goes on &#233; here.</p><ul><li>An item of it.</li></ul></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">More</a></li></ul></aside><section class="comments"><div class="comment"><p>Nice words, thanks.</p></div></section></div>
    <form class="search"><input name="q"><button>Go</button></form><footer class="footer">&copy; Somebody</footer></body></html>"""
    assert page_text(spark, model, [page, None, "", "<div"])[0] == "The title\nFirst & best paragraph, with a link.\nSecond one goes on é here.\nAn item of it."
    assert page_text(spark, model, [None, "", "<div", "<nav><a href=x>y</a></nav>"]) == ["", "", "", ""]
    assert html.extract(spark.createDataFrame([], "page_id int, html string"), model).count() == 0


def test_long_and_deep_pages_are_whole(spark, model):
    body = "".join(f"<p>Sentence number {k} of the story goes on and on.</p>" for k in range(5000))
    deep = "<div>" * 3000 + "<p>Down here it is.</p>"
    got = page_text(spark, model, [f'<body><article class="content">{body}</article></body>', deep])
    assert got[0].count("\n") == 4999


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<iframe/>", "<template/>", "<math/>", "<svg>", "<iframe>", "<select>", "<img>", "<br/>"])
def test_empty_and_unclosed_elements_swallow_nothing(spark, model, tag):
    page = f'<article class="post"><p>Before it there was a whole sentence.</p>{tag}<p>After it came another sentence.</p></article>'
    assert page_text(spark, model, [page]) == ["Before it there was a whole sentence.\nAfter it came another sentence."]


def blocks(page):
    _, tags, _, pieces, _, _ = html.parse(page)
    return [html.block_text(x) for x, t in zip(pieces, tags) if t == "#text"]


def test_pages_are_read_as_they_stand():
    assert blocks("<p>a <math><mi>x</mi>=5</math> b</p><p>1 < 2 and 3 > 2</p>") == ["a x=5 b", "1 < 2 and 3 > 2"]
    assert blocks('<p>x</p><script>var a="</p>"; if(a<b){}</script><p>y</p><style>p{}') == ["x", "y"]
    assert blocks("<svg><svg><text>no</text></svg><text>no</text></svg><p>yes</p>") == ["yes"]
    assert blocks("<!--><p>a</p><!-- x > <p>no</p> --><p>b") == ["a", "b"]
    assert blocks('<p title="a>b">c</p><a href=\'x>y\'>d</a><p title="unclosed>e</p>') == ["c", "d", "e"]


@pytest.mark.parametrize("page", ["<a " + '"' * 200_000 + "<", '<a =" ' * 50_000, "<a " * 100_000, "<svg>" * 50_000 + "</svg>", "<svg " * 100_000 + ">", "<!--" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<script>" * 50_000])
def test_crafted_pages_take_no_longer_than_others(page):
    started = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - started < 5


def test_pages_unlike_the_training_set(spark, model):
    """No classes, tables for layout, names in another language: structure alone tells."""
    said = ["The city council met on Tuesday to discuss the new bridge over the river, which has been closed since March.", "Engineers say that the repairs will take another six months and cost twice as much as planned."]
    both, want = "".join(f"<p>{x}</p>" for x in said), "\n".join(["Bridge stays closed", *said])
    pages = [
        f"<html><body><header><a href=/>Daily</a></header><nav><a href=/a>World</a> <a href=/b>Sport</a></nav><main><h1>Bridge stays closed</h1>{both}</main><footer>© Daily</footer></body></html>",
        f"<table><tr><td><a href=1>Home</a><br><a href=2>Shop</a><br><a href=3>Mail</a></td><td><h2>Bridge stays closed</h2>{both}</td></tr></table><center><a href=4>Imprint</a> | <a href=5>Contact</a></center>",
        f'<body><div id="kopf"><ul><li><a href=1>Start</a></li><li><a href=2>Archiv</a></li></ul></div><div id="inhalt"><h1>Bridge stays closed</h1>{both}</div><div id="fuss"><a href=3>Impressum</a> <a href=4>Kontakt</a></div></body>',
    ]
    assert page_text(spark, model, pages) == [want] * 3


def test_articles_of_the_table_are_whole_and_alone(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, model).select("page_id", "text").collect()}
    for r in pages.collect():
        inside = re.search(r"<article>.*?</article>", r["html"], re.S)[0]
        assert got[r["page_id"]] == "\n".join(x for x in blocks(inside) if x)


def test_marginals_as_by_enumeration():
    rng = np.random.default_rng(2)
    parents, kinds = np.array([-1, 0, 0, 1, 1, 2, 4]), np.array([0, 1, 0, 2, 1, 0, 0])
    unary, edge = rng.normal(size=7), rng.normal(size=(3, 2, 2))
    p, both = html.marginals(parents, html.levels_of(parents), kinds, unary, edge)
    total, want = 0.0, np.zeros(7)
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(unary[i] * y[i] for i in range(7)) + sum(edge[kinds[parents[i]], y[parents[i]], y[i]] for i in range(1, 7)))
        total += w
        want += w * np.array(y)
    assert np.allclose(p, want / total)
    assert np.allclose(both[1:].sum((1, 2)), 1)


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(3)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in bench if len(t.split()) >= 16][:40]
    noise = lambda n: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows, want = [], {}
    for k, (item, text) in enumerate(long):
        w = text.split()
        if k % 3 == 0:
            said = text.upper()
        elif k % 3 == 1:
            said = " ".join(x if (j + 2) % 8 or j > len(w) - 6 else noise(1) for j, x in enumerate(w))
        else:
            rng.shuffle(w)
            said = " ".join(w)
        rows.append((k, f"{noise(rng.randint(0, 90))} {said} {noise(rng.randint(0, 90))}"))
        want[k] = item if k % 3 != 2 else None
    rows += [(100 + k, noise(200)) for k in range(60)] + [(300, None), (301, ""), (302, "?!"), (303, long[0][1]), (303, long[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS cosine")
    table = spark.createDataFrame([*bench, (-5, None), (-6, "")], "item_id long, text string")
    got = decontam.contaminated(docs, table).collect()
    found = {r["doc_id"]: r["item_ids"] for r in got}
    assert all(i in found.get(k, []) for k, i in want.items() if i is not None)
    assert not [k for k in found if want.get(k) is None and k != 303]
    assert sum(r["doc_id"] == 303 for r in got) == 2
    split = decontam.contaminated(docs, table, items_at_once=50).collect()
    assert sorted(map(str, split)) == sorted(map(str, got))
    assert decontam.contaminated(docs.limit(0), table).count() == 0
    assert decontam.contaminated(docs, table.limit(0)).count() == 0


def long_items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(40).collect()]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_copies_are_found_whatever_else_the_corpus_holds(spark, n):
    bench = long_items(spark)
    docs = spark.createDataFrame([(k, bench[k][1]) for k in range(n)], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert all(bench[k][0] in got.get(k, []) for k in range(n))


def test_repeated_and_nameless_rows_and_short_items_in_any_blocks(spark):
    bench = [*long_items(spark), (-1, "Quokka Zebra, violet"), (-2, "lone"), (-3, None), (-4, "..."), (-5, "one two three four")]
    texts = [bench[0][1], bench[1][1], "so quokka zebra violet it was", "quokka violet zebra", "a lone one", "one two three and four", "two three four one two three four."]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[1]), (None, texts[1]), (None, "clean words"), *((10 + k, t) for k, t in enumerate(texts[2:]))]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    one, many = (sorted(str(r) for r in decontam.contaminated(docs, table, items_at_once=k).collect()) for k in (5000, 4))
    assert one == many
    got = decontam.contaminated(docs, table).collect()
    by = lambda i: sorted(tuple(r["item_ids"]) for r in got if r["doc_id"] == i)
    assert len(by(1)) == 3 and len(by(None)) == 2
    assert [by(10 + k) for k in range(5)] == [[(-1,)], [], [(-2,)], [], [(-5,)]]


def test_paraphrases_as_by_brute_force(spark):
    """Every window of every document against every passage, by common subsequences alone."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(k, noise(rng.randint(10, 60))) for k in range(60)]
    rows = []
    for k in range(240):
        w = list(bench[k % 60][1])
        keep = rng.uniform(0.55, 0.9)
        for j in range(len(w) - 4):
            if rng.random() > keep:
                w[j] = rng.choice(vocabulary)
        rows.append((k, " ".join(noise(rng.randint(0, 70)) + w + noise(rng.randint(0, 70)))))
    rows += [(1000 + k, " ".join(noise(150))) for k in range(200)]
    got = {(r["doc_id"], i) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in bench], "item_id long, text string")).collect() for i in r["item_ids"]}
    want = set()
    for d, text in rows:
        t = text.split()
        for item, w in bench:
            masks = {}
            for k, x in enumerate(w):
                masks[x] = masks.get(x, 0) | 1 << k
            scale = min(decontam.SCALES, key=lambda s: abs(8 * s - len(w)))
            for b in range(-1, -(-len(t) // 8)):
                window = t[max(0, 8 * b) : 8 * (b + scale + 2)]
                share = decontam.common_words(masks, len(w), window) / len(w)
                if share >= 0.75 or share >= 0.6 and any(window[k : k + 4] == w[-4:] for k in range(len(window))):
                    want.add((d, item))
                    break
    assert len(want) > 150 and got <= want
    assert len(got) >= 0.97 * len(want), (len(got), len(want))


def test_common_subsequence_as_by_dynamic_programming():
    rng = random.Random(5)
    for _ in range(50):
        a, b = [[rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(2)]
        masks = {}
        for k, t in enumerate(a):
            masks[t] = masks.get(t, 0) | 1 << k
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontam.common_words(masks, len(a), b) == d[-1][-1]


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "9 AS target", "8 AS taken")
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return docs, [r.asDict() for r in mixing.mix_sources(sized, "size").select("doc_id", "source", "size", "source_size", "target", "taken").collect()]


def test_mix_as_by_sql(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", "d", None, "é"]), " ".join("w" * rng.randint(0, 40)) or None) for i in range(400)]
    rows += [(None, "a", "x y z"), (None, "a", "x y z"), (5, "b", "five five"), (5, "b", "five five"), (900, "empty", None), (901, "tiny", "one")]
    docs, got = mixed(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "text").toArrow())
    key = lambda r: (str(r[0]), str(r[1]), *r[2:])
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall(), key=key)
    assert sorted(map(tuple, (r.values() for r in got)), key=key) == [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in want]
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values())
    again = mixed(spark, rows[::-1])[1]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixed(spark, [])[1] == []
    assert [r["taken"] for r in mixed(spark, [(1, None, None), (2, "a", "")])[1]] == [0, 0]


def test_windows_are_summed_once_and_not_copied():
    """Rows shorter than a window used to double what the sums of windows hold; the sums themselves must stay."""
    at = np.concatenate([np.arange(0, 4000, 40), np.arange(4000, 4101)])  # rows of 40 blocks and of one
    total = np.random.default_rng(0).standard_normal((4100, 128)).astype(np.float32)
    tracemalloc.start()
    for scale, first, end, v in decontam.windows(at, total):
        real = np.flatnonzero(first >= 0)
        assert len(real) == 100 * (41 - scale) + 100
        assert all(np.allclose(v[k], total[first[k] : end[k]].sum(0), atol=1e-4) for k in real[:: len(real) // 50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.6 * total.nbytes


def test_sketch_equals_the_product_of_matrices(spark):
    """A'(A basis) by plain matrices, over more words than a tile holds."""
    rng = np.random.default_rng(0)
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 300, n)) for n in (5000, 70, 3, 9000)]
    idf = rng.random(decontam.SIZE).astype(np.float32) + 1
    want, basis = np.zeros((decontam.SIZE, 5)), rng.standard_normal((decontam.SIZE, 5)).astype(np.float32)
    for text in docs:
        raw = np.frombuffer(text.encode(), np.uint8)
        col = (decontam.tokens(raw, np.array([0, len(raw)]))[0] & decontam.U64(decontam.SIZE - 1)).astype(np.int64)
        for k in range(0, len(col), decontam.PASSAGE):
            one = col[k : k + decontam.PASSAGE]
            a = np.bincount(one, weights=idf[one], minlength=decontam.SIZE)
            want += np.outer(a, a @ basis) / (idf[one].astype(float) ** 2).sum()
    got = decontam.sketch(spark.createDataFrame([(x,) for x in docs], "text string"), idf, basis)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_the_index_is_fitted_on_every_row(spark, monkeypatch):
    """More passages than the index was once fitted on."""
    seen, real = [], decontam.sketch
    passages = lambda texts: texts.count() if "text" in texts.columns else texts.agg(F.sum(F.length("sizes"))).head()[0]
    monkeypatch.setattr(decontam, "sketch", lambda texts, *more: seen.append(passages(texts)) or real(texts, *more))
    docs = spark.range(160_000).selectExpr("id AS doc_id", "concat('w', id % 700, ' w', id % 11) AS text")
    decontam.contaminated(docs, spark.createDataFrame([(1, "five words that nobody said")], "item_id long, text string"))
    assert seen == [160_001] * 2


def test_sums_of_groups_of_unlike_sizes():
    rng = np.random.default_rng(1)
    table, at, sizes = rng.standard_normal((50, 3)), rng.integers(0, 50, 9000), rng.permutation(np.repeat([1, 2, 29], [1000, 1000, 200]))
    starts = np.cumsum(sizes) - sizes
    want = np.stack([table[at[s : s + n]].sum(0) for s, n in zip(starts, sizes)])
    assert np.allclose(decontam.group_sums(table, at, starts, sizes), want)
