"""The corpus pipeline stage by stage, and the registered queries."""

import random

import pytest

import __spark_entry__ as entry

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.written(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.count() <= docs.count()
        docs = out
    mixed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < mixed.count() <= docs.count() < before
    ran = pipeline.run(spark, SF)
    assert ran.columns == mixed.columns and ran.count() == mixed.count()


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1 << 40, "", "", "", 0), (1 << 41, "x " * 100_000, "en", None, 200_000), (1 << 41, "x " * 100_000, "en", None, 200_000)], docs.schema)
    for table in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, table, SF).collect()


def odd_corpus(spark):
    """Documents with copies, near copies, shared passages, benchmark passages; repeated ids and rows without one."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda n: [word() for _ in range(n)]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    base = [words(80) for _ in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(6):
        w = list(base[k])
        w[40] = "changed"
        rows += [(100 + k, " ".join(w)), (200 + k, " ".join(base[k]))]
    rows += [(300 + k, " ".join(words(30)) + f" {bench[k]} " + " ".join(words(30))) for k in range(6)]
    rows += [(None, " ".join(words(10)) + f" {bench[0]}"), (None, rows[0][1]), (None, None), (400, None), (401, "")]
    rows += [(500, " ".join(words(60))), (500, " ".join(words(60))), (500, rows[2][1]), (7, rows[7][1]), (7, rows[7][1])]
    shared = " ".join(words(60))
    rows += [(600 + k, " ".join(words(20)) + f" {shared} " + " ".join(words(20))) for k in range(4)]
    return [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], bench


def shingles(text):
    w = [x for x in (text or "").split() if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_of_each_group_stays_as_by_brute_force(spark):
    rows, _ = odd_corpus(spark)
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in pipeline.ngram_jaccard_join(spark, docs, SF).collect())
    named = [r for r in rows if r[0] is not None]
    group = list(range(len(named)))
    for a in range(len(named)):
        for b in range(a):
            x, y = shingles(named[a][1]), shingles(named[b][1])
            if x == y or len(x & y) >= 0.8 * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    stay = [min(i for i, g in enumerate(group) if g == k) for k in set(group)]
    want = [(str(r[0]), r[1] or "") for r in rows if r[0] is None]
    for k in set(group):
        least = min(named[i][0] for i, g in enumerate(group) if g == k)
        texts = {named[i][1] or "" for i, g in enumerate(group) if g == k and named[i][0] == least}
        chosen = [g for g in got if g[0] == str(least) and g[1] in texts]
        assert len(chosen) == 1, (least, chosen)
        want.append(chosen[0])
    assert got == sorted(want) and len(stay) == len(set(group))


def test_passages_go_and_contaminated_rows_go_with_an_id_or_without(spark):
    rows, bench = odd_corpus(spark)
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    least = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            least.setdefault(raw[k : k + 50], []).append(1 << 62 if i is None else i)
    want = []
    for i, t, *_ in rows:
        raw, own = (t or "").encode(), 1 << 62 if i is None else i
        gone = set()
        for k in range(len(raw) - 49):
            if min(least[raw[k : k + 50]]) < own:
                gone.update(range(k, k + 50))
        want.append((str(i), bytes(b for k, b in enumerate(raw) if k not in gone).decode("utf-8", "ignore")))
    out = pipeline.suffix_array_dedup(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out)
    clean = pipeline.benchmark_decontamination(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean) == sorted((str(i), t or "") for i, t, *_ in rows if not any(b in (t or "") for b in bench))


def test_queries_have_stable_names():
    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_decontamination_fits_its_index_on_every_row(spark, monkeypatch):
    """More passages than the index was once fitted on."""
    seen, real = [], pipeline.decontam.sketch
    passages = lambda texts: texts.count() if "text" in texts.columns else texts.selectExpr("sum(length(sizes))").head()[0]
    monkeypatch.setattr(pipeline.decontam, "sketch", lambda texts, *more: seen.append(passages(texts)) or real(texts, *more))
    docs = spark.range(160_000).selectExpr("id AS doc_id", "concat('w', id % 700, ' w', id % 11) AS text")
    pipeline.benchmark_decontamination(spark, docs, "/root/testdata/sf0.001")
    assert len(seen) == 2 and min(seen) > 160_000
