"""Repeated passages and the n-gram Jaccard join against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from terralith.llm import _graph, jaccard, suffix

DOCS = "doc_id long, text string"


def brute_repeats(rows):
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            s = raw[k : k + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_as_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)] + ["a" * 400, "ab" * 120]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            text += p[a : a + rng.randint(20, 200)] if rng.random() < 0.6 else " ".join(word() for _ in range(30))
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1]), (7, rows[9][1]), (204, "a" * 49), (205, "a" * 50), (206, "a" * 5000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "0 AS kept", "'' AS blob")
    want = brute_repeats(rows)
    for parts, fan in ((6, 1024), (14, 3)):  # in one step, and in two
        got = suffix.remove_repeats(docs, parts=parts, fan=fan).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got) == want


def test_suffixes_with_a_common_head_are_cut_into_ranges(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("the quality " + "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(40))) for i in range(60)]
    table = suffix.packs(spark.createDataFrame(rows, DOCS).coalesce(1), "doc_id", "text")
    cuts = suffix.range_cuts(table, 8)
    assert len(cuts) == 7 and len(set(cuts.tolist())) == 7


def test_repeats_of_nothing_and_of_rows_without_id(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    got = suffix.remove_repeats(spark.createDataFrame([(None, "q" * 60), (5, "q" * 60)], DOCS)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {5: 0, None: 60}


def test_merge_by_loser_tree_gives_order_and_common_prefixes():
    rng = random.Random(1)
    runs = []
    for _ in range(5):
        items = sorted(bytes(rng.choice(b"ab") for _ in range(suffix.LENGTH)) if rng.random() < 0.5 else b"a" * 45 + bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(rng.randint(0, 40)))
        common = lambda x, y: next((k for k in range(suffix.LENGTH) if x[k] != y[k]), suffix.LENGTH)
        runs.append((items, [0, *(common(x, y) for x, y in zip(items, items[1:]))][: len(items)]))
    run, at, shared = suffix.merged(runs)
    out = [runs[r][0][i] for r, i in zip(run, at)]
    assert out == sorted(x for items, _ in runs for x in items)
    assert shared[1:] == [common(x, y) for x, y in zip(out, out[1:])]


def brute_classes(rows, threshold=0.8):
    def shingles(text):
        w = (text or "").split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common >= threshold * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def near_copies(rng):
    rows, i = [], 0
    for size in (1, 2, 5, 40, 70):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(90, 150))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "two words"), (i + 4, "two  words"), (i + 5, rows[0][1]), (0, rows[0][1])]
    return rows


def test_classes_and_links_as_by_brute_force(spark, monkeypatch):
    rows = near_copies(random.Random(11))
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS node", "2 AS sig", "3 AS size")
    want = brute_classes(rows)
    for block in (jaccard.BLOCK, 16):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert sorted(tuple(r)[:3] for r in jaccard.jaccard_classes(docs).collect()) == want


def test_classes_of_nothing_and_of_rows_without_id(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0
    got = jaccard.jaccard_classes(spark.createDataFrame([(None, "a b"), (4, "a b")], DOCS)).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == [(4, 4, 0), (None, None, 0)]


def test_pruning_keeps_what_the_posterior_allows():
    least = jaccard.least_matches(0.8, 1e-9)
    assert least == sorted(least) and 0 <= least[0] <= 8 and 20 <= least[-1] <= 40


def test_components_of_hubs_and_chains_as_by_union_find(spark, monkeypatch):
    monkeypatch.setattr(_graph, "HUBS", 8)
    rng = random.Random(4)
    pairs = [(1, k) for k in range(2, 300)] + [(k, k + 1) for k in range(400, 440)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_ranges_of_suffixes_stand_in_order(spark):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(120)) for _ in range(30)]
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(200)) + rng.choice(shared)) for k in range(200)]
    table = suffix.packs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text")
    cuts = suffix.range_cuts(table, 8)
    assert len(cuts) == 7 and (cuts[1:] > cuts[:-1]).all()
    _, pack = next(suffix.by_pack(iter(table.toArrow().to_batches())))
    ids, buf, offs = suffix.opened(pack)
    s = suffix.Suffixes(ids, buf, offs, np.unique(suffix.anchors(buf, offs)[4]), cuts)
    order = [bytes(k) for k in s.key]
    assert order == sorted(order) and s.cuts[0] == 0 and s.cuts[-1] == len(order)
    assert np.diff(s.cuts).min() > len(order) // 24  # none is empty, none has most
