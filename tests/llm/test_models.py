"""Katz scores against a plain computation; classifiers by held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralith.llm import _packs, _tables, katz, quality, toxicity
from terralith.llm._linear import share_of

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.1"  # sf0.01 holds about ten held-out toxic rows, too few to tell


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["</s>"]


def discounts(counts):
    n = [sum(c == r for c in counts.values()) for r in range(1, 7)]
    if all(n):
        common = 6 * n[5] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common != 1 else 0 for r in range(1, 6)]
        if all(0 < x < 1 for x in d):
            return {r: x for r, x in enumerate(d, 1)}
    return {r: (r - 0.5) / r for r in range(1, 6)}


def discounted(d, c):
    return d.get(c, 0) * c if c <= 5 else c - 0.05


def brute_katz(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for i, text in rows:
        if not held[i]:
            t = ["<s>", *tokens(text)]
            one.update(t[1:])
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
            starts += 1
    n, d1, d2, d3 = sum(one.values()), discounts(one), discounts(two), discounts(three)
    p1 = {w: discounted(d1, c) / (n + 1) for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    seen = {}
    for (h, w), c in two.items():
        seen.setdefault((h,), {})[w] = discounted(d2, c) / (starts if h == "<s>" else one[h])
    for (g, h, w), c in three.items():
        seen.setdefault((g, h), {})[w] = discounted(d3, c) / two[g, h]
    memo = {}

    def weight(h):
        if h not in memo:
            memo[h] = (1 - sum(seen[h].values())) / (1 - sum(p(w, h[1:]) for w in seen[h]))
        return memo[h]

    def p(w, h):
        if not h:
            return p1.get(w, unknown)
        if h not in seen:
            return p(w, h[1:])
        return seen[h][w] if w in seen[h] else weight(h) * p(w, h[1:])

    some = [("<s>",), ("never seen",), ("never seen", "w1"), *((w,) for w in list(one)[:5] if w != "</s>"), *(g for g in list(two)[:12] if g[1] != "</s>")]
    for h in some:
        assert math.isclose(sum(p(w, h) for w in one) + p("unknown to all", h), 1, rel_tol=1e-9)
    out = {}
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + len(one) + 1)) for w in t)
        whole = ["<s>", *t]
        out[i] = (held[i], len(t), sum(one[w] > 0 for w in t), n, base, sum(math.log10(p(whole[k], tuple(whole[max(0, k - 2) : k]))) for k in range(1, len(whole))))
    return out


@pytest.mark.parametrize(("seed", "buckets", "fan"), [(1, 5, 1024), (2, 5, 1024), (1, 13, 3)])
def test_katz_scores_as_computed_plainly(spark, seed, buckets, fan):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 60)))) for i in range(90)]
    rows += [(150 + i, "w1 w2 w3 " * 9 + f"w{i}") for i in range(12)]  # histories that are followed by frequent tokens alone
    rows += [(200, None), (201, ""), (202, "  x\ty\n"), (203, "never seen words"), (204, "é É " * 500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6).selectExpr("*", "1 AS kind", "'' AS pack")
    got = {r["doc_id"]: r for r in katz.score_documents(docs, buckets=buckets, fan=fan).collect()}
    want = brute_katz(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert tuple(got[i])[1:5] == w[:4]
        assert got[i]["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert got[i]["score"] == pytest.approx(w[5], rel=1e-9)


def test_counts_keep_64_bits():
    counts = np.array([0, 1, 5_000_000_000, 1 << 62])
    for c in (counts, counts[:2], counts[:0]):
        got, bits = katz.widened(katz.narrow(c, np.ones(len(c))))
        assert got.tolist() == c.tolist() and bits.tolist() == [1] * len(c)


def test_rows_between_packs_and_parts_grow_with_the_packs(spark):
    rng, fan = random.Random(3), 8
    for n in (1, 8):
        rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(300))) for i in range(400 * n)]
        table = _tables.written(_packs.packs(spark.createDataFrame(rows, DOCS).coalesce(1), "doc_id", "text", size=80_000), "packs")
        packs = table.where("part = 1").count()
        buckets, between, answers = 8 * n, [], {}
        for most in (fan, 1024):
            counts = _tables.written(katz.short_counts(table, buckets, most, between), "counts")
            answers[most] = {name: _packs.received(pa.Table.from_pandas(rows)) for name, rows in counts.where("pack <> ''").toPandas().groupby("pack")}
            if most == fan:
                assert counts.where("pack <> ''").count() <= 2 * fan * packs  # of two kinds
        assert {k: {x: katz.widened(b)[0].tolist() for x, b in v[1].items()} for k, v in answers[fan].items()} == {k: {x: katz.widened(b)[0].tolist() for x, b in v[1].items()} for k, v in answers[1024].items()}
        assert len(between) == (n > 1)
        if between:  # rows for a cell and part: a cell stands for a pack or more
            assert between[0].where("pack <> ''").count() <= 2 * fan * 4 * buckets


def test_katz_of_nothing_repeats_and_missing_ids(spark):
    assert katz.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    got = katz.score_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 3), (1, 3)]
    assert all(r["score"] < 0 for r in got)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, label):
    score, label = np.array(score), np.array(label)
    pos, neg = score[label == 1], score[label == 0]
    return float((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


def test_toxicity_separates_held_out_labels(spark, docs, labels):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train_toxicity(docs.where(~held), labels.where(~held).select("doc_id", F.col("toxic").alias("grade")))
    got = toxicity.score_toxicity(docs, model).join(labels.where(held), "doc_id").select("score", "predicted", "toxic").collect()
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.93
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = sum(r["predicted"] * r["toxic"] for r in got)
    assert right >= 0.9 * sum(r["toxic"] for r in got) and right >= 0.97 * sum(r["predicted"] for r in got)


def test_label_model_trusts_accurate_voters_and_discounts_copies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    said = lambda hit, wrong: np.where(rng.random(20_000) < np.where(truth, hit, wrong), 1, -1).astype(np.int8)
    weak = said(0.5, 0.1)
    v = np.stack([said(0.8, 0.02), said(0.7, 0.02), weak, weak, weak, *(said(0.3, 0.3) for _ in range(4))], 1)
    v[rng.random(v.shape) < 0.1] = 0  # abstentions tell nothing
    known, where, n = np.unique(toxicity.code_of(v), return_inverse=True, return_counts=True)
    pattern = toxicity.votes_of(known, v.shape[1])
    assert (toxicity.code_of(pattern) == known).all()
    q, share, table, weight = toxicity.label_model(pattern, n)
    assert ((q[where] > 0.5) == truth).mean() > 0.93
    assert abs(share - 0.2) < 0.04 and weight[2:5].max() < 0.6 < weight[:2].min()
    assert abs(table[0, 1] - 0.8) < 0.1 and abs(table[0, 0] - 0.02) < 0.02
    for row, got in zip(pattern[:200], q[:200]):  # the posterior by Bayes' rule, voter by voter
        odds = math.log(share / (1 - share))
        for j, x in enumerate(row):
            odds += weight[j] * {1: math.log(table[j, 1] / table[j, 0]), -1: math.log((1 - table[j, 1]) / (1 - table[j, 0])), 0: 0.0}[int(x)]
        assert got == pytest.approx(1 / (1 + math.exp(-odds)), abs=0.02)


def test_votes_as_by_plain_counting(spark):
    texts = ["You IDIOT, you", "", None, "calm words only, all of them", "A!!!! B!!!!", "SHOUT SHOUT AGAIN", "trash? a clown & a #$% b", "same same same x", "réeuxx réeuxy word word", "réeuxx " + "plain " * 900]
    lexicon = np.zeros(toxicity.SIZE)
    raw = np.frombuffer("réeuxx".encode(), np.uint8)
    kinds, _, _, _ = toxicity.tokens(raw, np.array([0, len(raw)]))
    for _, col in kinds[1:]:
        lexicon[col] = 1
    rows = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4)
    got = {r["code"]: r["n"] for r in toxicity.vote_patterns(rows, lexicon).collect()}
    want = {}
    for t in texts:
        raw = (t or "").encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        word = [w for w in "".join(chr(c) if chr(c).isalnum() and c < 128 or c >= 128 else " " for c in low).split(" ") if w]
        word = [w.encode("latin-1") for w in word]
        vote = [1 if any(w.decode("utf-8", "ignore") in listed for w in word) else -1 for listed in toxicity.INSULTS]
        vote += [-1]
        for k in (6, 5, 4):
            hits = sum(len(w) > k and w[:k] == "réeuxx".encode()[:k] for w in word)
            vote.append(-1 if not hits else int(hits >= 2 and hits >= 0.005 * len(word)))
        size = max(1, len(raw))
        vote += [1 if sum(map(f, raw)) / size > 0.05 else -1 for f in (lambda c: 65 <= c <= 90, lambda c: c == 33, lambda c: c in b"#$%&*|")]
        vote.append(1 if sum(a == b for a, b in zip(word, word[1:])) > 0.05 * max(1, len(word)) else -1)
        code = sum((x + 1) * 3**k for k, x in enumerate(vote))
        want[code] = want.get(code, 0) + 3
    assert got == want


def test_quality_keeps_good_documents(spark, docs, labels):
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = quality.train_quality(docs, quality.ratings(labels.where(~fold)))
    got = quality.score_quality(docs, model).join(labels.where(fold), "doc_id").select("tail_probability", "expected_grade", "quality").collect()
    good = [r["tail_probability"] >= 0.5 for r in got if r["quality"] == 1]
    bad = [r["tail_probability"] >= 0.5 for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3
    assert all(0 <= r["expected_grade"] <= 2 for r in got)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    grade = np.digitize(x + 0.3 * rng.normal(size=600), [-0.7, 0.7])
    got = np.frombuffer(quality.fit_ordinal(grade, np.zeros(600, np.int64), x, np.arange(601), 3), np.float32)
    assert got[0] < got[1] and got[2] > 1


@pytest.mark.parametrize("module", ["quality", "toxicity"])
def test_scores_of_empty_null_and_unlabelled(spark, module):
    rows = spark.createDataFrame([(1, None, 7.0, 1.0), (None, "", 7.0, 1.0), (3, "word " * 50_000, 7.0, 1.0)], "doc_id long, text string, score double, expected_grade double")
    none = spark.createDataFrame([], "doc_id long, grade int")
    m = quality if module == "quality" else toxicity
    train, score = (m.train_quality, m.score_quality) if module == "quality" else (m.train_toxicity, m.score_toxicity)
    got = score(rows, train(rows, none)).collect()
    assert len(got) == 3
    if module == "toxicity":
        assert len({r["score"] for r in got}) == 1 and got[0]["score"] < 0.5  # no voter says toxic
        assert {r["score"] for r in score(rows, train(rows.limit(0), none)).collect()} == {0.5}
    assert score(rows.limit(0), train(rows, none)).count() == 0


@pytest.mark.parametrize("most,n,low,high", [(10**7, 10**12, 25, 90), (5, 3, 10**6, 10**6), (10**9, 10**12, 850, 1150)])
def test_shares_of_very_many_rows_choose_rows(spark, most, n, low, high):
    rows = spark.range(10**6 if most != 10**7 else 5 * 10**6)
    assert low <= rows.where(share_of(most, n, "id", F.lit("sample"))).count() <= high


def test_no_share_is_rounded_to_nothing():
    """Bounds of 12,000 rows out of 1e12 and out of 1e16 differ from the least hash, and from each other."""
    bounds = [(12_000 << 64) // n for n in (10**12, 10**16)]
    assert bounds[0] > bounds[1] > 0
