"""Lexical search and vector codes by brute force; splits of words by enumeration, rules by hand, verdicts by held-out hosts."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralith.llm import _joins, search, urls, vectors
from terralith.llm._joins import attach

DOCS = "doc_id long, text string, doc string, term int, n long, bucket int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, k=10):
    found = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c) for i, c in found if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(low(text)))
    out = []
    for item, terms in asked.items():
        ranked = []
        for place, (doc_id, c) in enumerate(held):
            m = 10 + 90 * c.total() * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms & c.keys())
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, place, doc_id))
        out += [(item, r, x[4], -x[0]) for r, x in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "and", "straße", "naïve", "x1", "2024", "e-mail", "don't", "雪", "a", "zebra", "quark", "lemma", "ÉTÉ", "été"]
    docs = [(i, rng.choice([" ", "\n", ", ", "\x00"]).join(rng.choices(words, [20, 5, 9, *range(13, 0, -1)], k=rng.choice([1, 3, 12, 60])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;"), (None, "zebra quark"), (7, "zebra quark"), (7, "zebra quark"), (n + 3, "zebra quark " * 30_000)]
    return docs


@pytest.mark.parametrize("sent", [200_000, 0])
def test_search_equals_brute_force(spark, monkeypatch, sent):
    """By broadcast and by shuffle; nulls, ties, repeated rows, rows without an id, a very long text, names that clash."""
    monkeypatch.setattr(search, "SENT", sent)
    monkeypatch.setattr(_joins.attach, "__defaults__", (sent,))
    docs = corpus()
    items = [(1, "Zebra, the QUARK"), (2, "été ÉTÉ"), (3, None), (4, "..."), (5, "nowhere"), (None, "lemma"), (None, "snow 雪"), (1, "the")]
    table = spark.createDataFrame([(*d, "x", 1, 2, 3) for d in docs], DOCS)
    asked = spark.createDataFrame([(*i, "t", 0) for i in items], "item_id long, text string, term string, items int")
    got = sorted(map(tuple, search.search(search.build_index(table), asked).collect()), key=repr)
    assert got == brute_search(docs, items)
    assert {r[0] for r in got} == {1, 2, None}


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search(search.build_index(none), items).count() == 0
    some = spark.createDataFrame([(1, "word"), (2, "other")], "doc_id long, text string")
    assert search.search(search.build_index(some), items.where("false")).count() == 0


def test_attach_keeps_every_row_by_either_way(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else None, i) for i in range(300)] + [(99, -1)], "k long, i long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (None, "none"), (5, "e")], "k long, v string")
    want = sorted((k, i, {0: "a", 1: "b", 2: "c", None: "none"}[k]) for k, i in map(tuple, left.collect()) if k != 99 and k is not None)
    for sent in (10, 0):
        got = [tuple(r) for r in attach(left, right, "k", sent).collect()]
        assert sorted(r for r in got if r[0] is not None) == want
        assert sorted(r[1] for r in got if r[0] is None) == list(range(0, 300, 2))


def brute_codes(rows, rounds=4):
    """rows: (vec_id, vector or None, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[v[k * w : (k + 1) * w] for _, v, _ in first] for k in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            groups = {}
            for _, v, _ in kept:
                x = v[k * w : (k + 1) * w]
                groups.setdefault(near(x, books[k])[1], []).append(x)
            for i, g in groups.items():
                books[k][i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, v, lab in kept:
        best = [near(v[k * w : (k + 1) * w], books[k]) for k in range(4)]
        out.append((i, "".join(f"{b:02x}" for _, b in best), sum(d for d, _ in best), lab))
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, e, min(total[lab], 2**63 - 1), digest) for i, c, e, lab in out], key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, v string, code int"


@pytest.mark.parametrize("scale", [1.0, 3e5])  # exact in doubles, and beyond
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in scale * rng.normal(size=8)], int(i) % 3 or None) for i in rng.permutation(330)]
    rows += [(3, rows[5][1], 1), (None, rows[6][1], None), rows[9], (900, None, 1), (901, [None] * 8, 2), (902, [math.nan] + [0.0] * 7, 2), (903, [math.inf] + [0.0] * 7, 2), (-5, [0.0] * 8, 1)]
    rows += [(1000 + i, [0.001 * i] * 8, 0) for i in range(4)]
    got = vectors.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [1.0], 1), (3, [], 1), (4, [4.0, 5.0, 6.0], None)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.compress(table).collect()}
    assert {i: (r["code"], r["error"], r["label_error"]) for i, r in got.items()} == {1: ("00000000", 0, 0), 4: ("01010100", 0, 0)}
    assert vectors.compress(table.where("vec_id = 3")).count() == 0
    assert vectors.compress(table.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = spark.createDataFrame([(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [0.5] * 4, 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(r["code"] for r in vectors.compress(huge).collect()) == ["00000000", "01010101", "02020202"]


def test_annuli_leave_nothing_out():
    """Ties go to the lower index, entries at the very border of an annulus count."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-3, 4, (256, 2)).tolist()
    x = rng.integers(-5, 6, (400, 2))
    index, d = vectors.Annuli(entries).nearest(x)
    for row, i, dist in zip(x.tolist(), index.tolist(), d.tolist(), strict=True):
        assert (dist, i) == min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), j) for j, e in enumerate(entries))


def test_split_is_the_likeliest_of_all():
    rng = random.Random(5)
    for _ in range(60):
        run = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        words = {run[i:j]: -rng.uniform(1, 9) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if rng.random() < 0.4}
        pieces = [(i, j - i, words[run[i:j]]) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if run[i:j] in words]
        unknown = -7.0

        def value(parts, words=words, unknown=unknown):
            return sum(max(words.get(p, -math.inf), unknown - len(p) * math.log(26)) for p in parts)

        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(run)), k) for k in range(len(run)))
        best = max(value([run[a:b] for a, b in itertools.pairwise((0, *c, len(run)))]) for c in cuts)
        split = urls.best_split(len(run), pieces, unknown)
        assert "".join(run[a:b] for a, b in split) == run
        assert value([run[a:b] for a, b in split]) == pytest.approx(best)


RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
URLS = {
    "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://www.example.com/en/?q=/fr/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://a.www.example.com/en/x#y": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://badexample.com/en/1": ("badexample.com", "/en/1", "com/", "allow"),
    "http://example.com/EN/1": ("example.com", "/EN/1", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
    "http://net/es/?x://y": ("net", "/es/", "net/es/", "block"),
    "http://a.net/es": ("a.net", "/es", None, "allow"),
    "http://a.org?x/../en/": ("a.org", "", None, "allow"),
    "mailto:me": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
    "http://123.45/6": ("123.45", "/6", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(None, "http://a.net/fr/", "", ""), (0, "http://Example.COM/en/1", "", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, words string")
    model = urls.train_urls(table, spark.createDataFrame([("an example of a text",), (None,), ("",)], "text string"))
    got = [(r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in urls.judge_urls(table, model, RULES).collect()]
    want = list(enumerate(URLS.values())) + [(None, URLS["http://a.net/fr/"]), (0, URLS["http://Example.COM/en/1"])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert urls.judge_urls(table.where("false"), model, RULES).count() == 0


def test_verdicts_of_concatenated_hosts(spark):
    """Hosts of words that run together: 20 unwanted ones and 40 others, whose words the lists know or not."""
    rng = random.Random(11)
    bad = ["".join(rng.sample(urls.UNWANTED, 2)) + end for end in ("24", "hub") for _ in range(10)]
    plain = ["green", "north", "valley", "bridge", "garden", "daily", "history", "sailing", "bread", "lantern"]
    good = ["".join(rng.sample(plain, 2)) for _ in range(40)]
    hosts = [(i, f"https://www.{h}.org/en/{i}.html", h in bad) for i, h in enumerate(bad + good)]
    table = spark.createDataFrame(hosts, "page_id long, url string, bad boolean")
    texts = spark.createDataFrame([(" ".join(rng.choices([*plain, "the", "in", "to", "and", "on", "her", "an"], k=300)),) for _ in range(20)], "text string")
    got = {r["page_id"]: r for r in urls.judge_urls(table, urls.train_urls(table, texts)).collect()}
    assert [got[i]["host"] for i, _, b in hosts if b != (got[i]["verdict"] == "block")] == []
    assert {got[i]["words"] for i, u, _ in hosts if "greenvalley" in u} <= {"www green valley org en html"}


def test_a_very_long_url(spark):
    table = spark.createDataFrame([(1, "http://" + "casinowinner" * 2000 + ".net/" + "a/" * 20_000)], "page_id long, url string")
    model = urls.train_urls(table, spark.createDataFrame([("casino winner",)], "text string"))
    r = urls.judge_urls(table, model).head()
    assert r["host"] == "casinowinner" * 2000 + ".net" and r["words"].startswith("casino winner casino winner")
