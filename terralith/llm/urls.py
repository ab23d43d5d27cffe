"""URL filters: rules on hosts and paths, and a naive Bayes model over the words of host and path where no rule fits.

Names of hosts are words without spaces between them.  A unigram model of words, counted in texts, splits each run of letters
by Viterbi into the words that are likeliest together.  The words of host and path are then scored by multinomial naive Bayes.

Nothing is gathered by host or by word in one task: runs of letters are split once each, whatever number of urls holds them, and
lookups of words, runs and hosts go through ``attach``.  Scores are sums of whole numbers, so they are the same in every run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import attach
from ._tables import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of letters: a-z and all characters beyond ASCII.
RUN = r"[^\x00-\x60\x7B-\x7F]+"
LONGEST = 24  # letters of a word
UNIT = 1_000_000  # points of a natural logarithm
PRIOR = 0.05  # probability of an unwanted url before its words are seen

# Words that tell what a host is about, from which the labels of hosts start.
UNWANTED = """
ads advert adult bet betting bingo bonus buy camgirl cams cash casino cheap cheapest click clickbait clicks coupon crack cracked
credit deals discount drugs escort escorts forex fraud free gamble gambling hacked hookup instant jackpot keygen loan loans
lottery malware miracle money nude offer offers payday phish pharma pharmacy pill pills poker popup porn prize prizes replica
rich roulette scam sex sexy slot slots spam spammer spyware torrent track tracker tracking trial viagra warez win winner xxx
""".split()
WANTED = """
academy archive art arts book books bridge children church city climate club college community cook culture daily docs family
film food football forest forum garden gazette health help history home hospital hotel house journal kitchen law letters library
local magazine maps market medicine museum music nature news notes ocean office paper park people photo poetry press project
radio recipe research review river school science society sport stories studio support teacher theatre times town travel
university village water weather wiki women world writing
""".split()


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for urls of a host and all its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Model:
    """``words`` (word, n) counts words of texts, ``total`` all of them; ``tokens`` (token, points) holds the words' evidence."""

    words: DataFrame
    total: int
    tokens: DataFrame


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z) after the first ``://``, and the path behind it; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; of equally long ones the one with the longer host, then a block.

    ``rules`` is a list of the caller, a few thousand at most; it becomes part of the plan.
    """
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(len(r.host)).alias("host"), F.lit(r.verdict == "block").alias("block"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    none = F.lit(None).cast("struct<length: int, host: int, block: boolean, rule: string, verdict: string>")
    return F.array_max(F.array(none, *found))


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(0))


def count_words(texts: DataFrame, text: str = "text", markup: bool = False) -> DataFrame:
    """(word, n) of the runs of up to LONGEST letters in all texts, without tags if there is ``markup``."""
    raw = F.col(text).cast("string")
    raw = F.regexp_replace(raw, "<[^>]*>", " ") if markup else raw
    words = texts.select(F.explode(runs_of(raw)).alias("word")).where(F.length("word") <= LONGEST)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(length: int, pieces: list[tuple[int, int, float]], unknown: float) -> list[tuple[int, int]]:
    """(start, end) of the likeliest words of a run of ``length`` letters, by Viterbi.

    ``pieces`` are the known words in it (start, length, log probability); letters that belong to none make unknown words of
    up to LONGEST letters, with ``unknown`` for the word and log 26 less for each letter.  Of equally likely splits the one
    whose last words are longer is taken.
    """
    at: dict[int, list[tuple[int, float]]] = {}
    for start, n, p in pieces:
        at.setdefault(start + n, []).append((start, p))
    best, back = [0.0] + [-math.inf] * length, [0] * (length + 1)
    for end in range(1, length + 1):
        known = at.get(end, [])
        guesses = [(end - n, unknown - n * math.log(26)) for n in range(1, min(LONGEST, end) + 1)]
        for start, p in sorted(known + guesses):
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], length
    while end:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def split_runs(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, tokens) for the distinct ``runs`` (run): the words of each."""
    unknown = math.log(1 / max(1, total))
    numbered = written(runs.select("run", F.monotonically_increasing_id().alias("no")), "runs")

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["no", "start", "word"]
        for batch in batches:
            for run, no in zip(batch.column("run").to_pylist(), batch.column("no").to_pylist(), strict=True):
                for a in range(0, len(run), 4096):  # long runs a part at a time
                    spots = [(i, run[i:j]) for i in range(a, min(len(run), a + 4096)) for j in range(i + 1, min(len(run), i + LONGEST) + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(spots), pa.int64()), pa.array([i for i, _ in spots], pa.int32()), pa.array([w for _, w in spots], pa.string())], names=schema)

    spots = written(numbered.mapInArrow(substrings, "no long, start int, word string"), "substrings")
    # words that stand in some run, once each: no key has many rows on either side
    known = written(spots.select("word").distinct().join(words, "word").select("word", F.log(F.col("n") / F.lit(float(max(1, total)))).alias("p")), "known-words")
    found = attach(spots, known, "word").select("no", F.struct("start", F.length("word").alias("n"), "p").alias("piece"))
    pieces = found.unionByName(numbered.select("no", F.lit(None).cast(found.schema["piece"].dataType).alias("piece"))).groupBy("no").agg(F.collect_list("piece").alias("pieces"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for run, some in zip(batch.column("run").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                tokens.append([run[i:j] for i, j in best_split(len(run), [(x["start"], x["n"], x["p"]) for x in some], unknown)])
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(tokens, pa.list_(pa.string()))], names=["run", "tokens"])

    return numbered.join(pieces, "no").select("run", "pieces").mapInArrow(split, "run string, tokens array<string>")


def train_urls(urls: DataFrame, texts: DataFrame, url: str = "url", text: str = "text", markup: bool = False, weight: float = 100.0, seeds: float = 0.4) -> Model:
    """A model from all ``urls`` and from the words of all ``texts``.

    Each host counts once, whatever number of urls it has, and so does each run of its paths.  A host with more words of
    UNWANTED than of WANTED teaches the unwanted class, all others the wanted one.  Before any host is seen, a class is as
    if it had ``weight`` words, a share ``seeds`` of them from its list and the others as frequent as in all hosts, so words that say nothing of a class
    count for nothing while a class has few hosts.  Null urls and empty hosts teach nothing; no urls give a model of the two lists.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    split = urls.select(host.alias("host"), path.alias("path")).where("host <> ''")
    units = split.select("host", F.explode(F.concat(F.transform(runs_of(F.col("host")), lambda r: F.struct(r.alias("run"), F.lit(True).alias("own"))), F.transform(runs_of(F.col("path")), lambda r: F.struct(r.alias("run"), F.lit(False).alias("own"))))).alias("r"))
    units = written(units.select("host", "r.run", "r.own").distinct(), "host-runs")

    counted = written(count_words(texts, text, markup), "word-counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    listed = urls.sparkSession.createDataFrame([(w,) for w in sorted({*UNWANTED, *WANTED})], "word string").select("word", F.lit(1 + total // UNIT).cast("long").alias("n"))
    words = written(counted.unionByName(listed).groupBy("word").agg(F.sum("n").alias("n")), "words")

    runs = written(split_runs(units.select("run").distinct(), words, total), "split-runs")
    lean = F.size(F.filter("tokens", lambda t: t.isin(UNWANTED))) - F.size(F.filter("tokens", lambda t: t.isin(WANTED)))
    leaning = written(runs.select("run", lean.alias("lean")).where("lean <> 0"), "leaning-runs")
    hosts = attach(units.where("own"), leaning, "run").groupBy("host").agg(F.sum("lean").alias("lean")).where("lean > 0").select("host", F.lit(1).alias("unwanted"))
    hosts = written(hosts, "unwanted-hosts")
    theirs = attach(units, hosts, "host").groupBy("run").agg(F.count("*").alias("bad"))
    by_run = units.groupBy("run").agg(F.count("*").alias("n")).join(theirs, "run", "left")
    tokens = by_run.join(runs, "run").select(F.explode("tokens").alias("token"), "n", F.coalesce("bad", F.lit(0)).alias("bad"))
    counts = written(tokens.groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "token-counts")
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).head()

    spare = 0.1  # of a word, for words that no host has
    common = lambda n: (n + spare) / (size["n"] + spare * (size["v"] + len(UNWANTED) + len(WANTED)))

    def evidence(n: Column, bad: Column, in_bad: Column, in_good: Column) -> Column:
        prior = lambda listed, k: weight * (seeds * listed / k + (1 - seeds) * common(n))
        unwanted = (bad + prior(in_bad, len(UNWANTED))) / (size["bad"] + weight)
        wanted = (n - bad + prior(in_good, len(WANTED))) / (size["n"] - size["bad"] + weight)
        return F.round(UNIT * F.log(unwanted / wanted)).cast("long").alias("points")

    both = counts.unionByName(listed.select(F.col("word").alias("token"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))).groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    points = both.select("token", evidence(F.col("n"), F.col("bad"), F.col("token").isin(UNWANTED).cast("int"), F.col("token").isin(WANTED).cast("int")))
    return Model(words, total, written(points, "token-points"))


def judge_urls(urls: DataFrame, model: Model, rules: Sequence[Rule] = (), id_col: str = "page_id", url: str = "url", prior: float = PRIOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words) for each row of ``urls``.

    ``score`` is the log odds of an unwanted url by its words, with ``prior``; where no rule fits, urls of 0 and more are
    blocked.  Urls without a run of letters have the prior's score.  Null urls and ones without ``://`` have an empty host and
    path and go by the prior.  Repeated rows and rows without an id are judged each; other columns aren't looked at.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    rows = urls.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = written(rows, "split-urls")
    runs = rows.select("row", F.posexplode(F.concat(runs_of(F.col("host")), runs_of(F.col("path")))).alias("at", "run"))
    tokens = written(split_runs(runs.select("run").distinct(), model.words, model.total), "split-runs")
    # evidence by run: its words' points; words that training has not seen say nothing
    each = tokens.select("run", F.explode("tokens").alias("token"))
    known = attach(each, model.tokens, "token").groupBy("run").agg(F.sum("points").alias("points"))
    scored = written(tokens.join(known, "run", "left").select("run", "tokens", F.coalesce("points", F.lit(0)).alias("points")), "scored-runs")
    found = attach(runs, scored, "run").groupBy("row").agg(F.sum("points").alias("points"), F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("split"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(found, "row", "left").withColumn("rule", rule)
    score = F.round((F.coalesce("points", F.lit(0)) + round(UNIT * math.log(prior / (1 - prior)))) / F.lit(float(UNIT)), 6)
    words = F.coalesce(F.array_join(F.flatten(F.transform("split", lambda s: s["tokens"])), " "), F.lit(""))
    verdict = F.coalesce("rule.verdict", F.when(score >= 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule.rule", verdict.alias("verdict"), score.alias("score"), words.alias("words"))
