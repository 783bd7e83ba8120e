"""Operator 6: URL filter by host word segmentation and multinomial naive Bayes, with rules.

Runs of letters in host labels are cut into words by a unigram Viterbi search: the most probable
split under word counts. The counts come from all URLs' hyphenated and path words, to which a short
word list adds a prior. They stay in a table: a run's substrings meet it by an equi-join, so that no
word is left out however many there are. URLs whose host holds a word of the seed list start as bad
examples, all others as good ones; multinomial naive Bayes over the words of host and path then
scores every URL, so words that keep company with seed words count against a host without one, and
good company can outweigh a seed. Word odds are a table, too, and meet the words of hosts and paths
by joins. Rules override the score: of the rules whose host is the URL's host or a parent domain,
and whose path begins the URL's path, the longest wins.

A run of more than 63 letters is no label of a host name and stays one word.

Defined results: a null url, or one without `://`, has empty host and path and is allowed by the
method; repeated rows come back once each; null ids are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.llm.common import written

#: (host, path, verdict): the rules of the production query.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Letters of a host label at most.
LABEL = 63
#: Prior count of each listed word.
PRIOR = 50.0
# Words of hosts that sell or trick, the bad examples' seeds.
SEEDS = tuple(
    "adult ads adserver bet bets betting bonus casino cialis clickbait escort gambling jackpot lottery malware payday"
    " phishing pills poker porn porno scam sex slots spam track tracker tracking viagra warez xxx".split()
)
# Common words of host names, for the split only.
COMMON = tuple(
    "all art auto best blog blue book box buy cam car cash cheap city click club code cool data day deal deals dev digital"
    " direct doc docs easy fast farm file film fit food forum free fun game games get go gold good green group guide health"
    " help home host hot house info job jobs lab land law learn life line link list live loan loans local mail map market"
    " max media money more music net new news now online page pay photo pill play plus press price pro rate red review sale"
    " school science search shop site social soft sport star store story super team tech time top tour town trade travel"
    " true tv video web wiki win winner wins work world zone".split()
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, 1 << 30)).otherwise(F.lit(""))


def rule_match(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in ordered
    ]
    return F.coalesce(*fits)


def split_run(run: str, known: list[tuple[int, int, float]], unknown: float) -> list[str]:
    """The most probable words of a run of letters; unknown stretches stay in one piece.

    known are (start from 1, length, cost) of the words in it; an unknown stretch costs `unknown` and
    more with each letter.
    """
    n, letter = len(run), math.log(26)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, cost in known:
        ends[start - 1 + length].append((start - 1, cost))
    # best[i]: (cost, start, in an unknown stretch) of the best split of the first i letters
    sure = [(0.0, 0, False)] + [(math.inf, 0, False)] * n
    loose = [(math.inf, 0, False)] * (n + 1)
    for i in range(1, n + 1):
        for j, cost in sorted(ends[i]):
            base, before = min((sure[j][0], False), (loose[j][0], True))
            sure[i] = min(sure[i], (base + cost, j, before))
        loose[i] = min((sure[i - 1][0] + unknown + letter, i - 1, False), (loose[i - 1][0] + letter, i - 1, True))
    words, i, inside, end = [], n, loose[n][0] < sure[n][0], n
    while i > 0:
        _, i, inside_before = loose[i] if inside else sure[i]
        if not inside or not inside_before:
            words.append(run[i:end])
            end = i
        inside = inside_before
    return words[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(runs: pd.Series, known: pd.Series, unknown: pd.Series) -> pd.Series:
    made = [
        split_run(r, [(k["start"], k["size"], k["cost"]) for k in (ks if ks is not None else [])], u)
        for r, ks, u in zip(runs, known, unknown, strict=True)
    ]
    return pd.Series(made, dtype=object)


def word_counts(urls: DataFrame) -> DataFrame:
    """(w, n): words that URLs write apart, in hyphenated host labels and paths, with the listed words' prior."""
    host = F.filter(F.split("host", "\\."), lambda x: F.instr(x, "-") > 0)
    text = F.lower(F.concat_ws(" ", F.array_join(host, " "), "path"))
    words = urls.select(F.explode(F.split(text, "[^a-z]+")).alias("w")).where(F.length("w") >= 2)
    listed = [(w, PRIOR) for w in (*COMMON, *SEEDS)]
    prior = urls.sparkSession.createDataFrame(listed, "w string, n double")
    return words.groupBy("w").agg(F.count("*").cast("double").alias("n")).unionByName(prior).groupBy("w").agg(F.sum("n").alias("n"))


def host_words(urls: DataFrame) -> DataFrame:
    """(host, words): every host's words without its top-level domain."""
    counts = written(word_counts(urls), "url-words")
    total = counts.agg(F.sum("n").alias("all"), F.min("n").alias("least"))
    # one row: what all words count, and the cost of an unknown one, over that of any known word
    costs = counts.join(F.broadcast(total)).select("w", (-F.log(F.col("n") / F.col("all"))).alias("cost"))
    dear = total.select((-F.log(F.col("least") / F.col("all")) + math.log(10)).alias("unknown"))
    labels = F.split(F.regexp_replace("host", ":[^:]*$", ""), "\\.")
    names = F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    runs = F.flatten(F.transform(names, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+)"), 1)))
    held = written(urls.select("host").where("host <> ''").distinct().select("host", F.posexplode(runs).alias("at", "run")), "url-runs")
    short = held.select("run").distinct().where(F.length("run") <= LABEL)
    spans = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("run")),
        lambda i: F.transform(F.sequence(F.lit(1), F.length("run") - i + 1), lambda n: F.struct(i.alias("start"), n.alias("size"), F.substring(F.col("run"), i, n).alias("w"))),
    ))
    # the first letter stays without a cost, so that a run without known words is kept
    met = short.select("run", F.inline(spans)).join(costs, "w", "left").where("cost is not null or (start = 1 and size = 1)")
    known = F.collect_list(F.when(F.col("cost").isNotNull(), F.struct("start", "size", "cost"))).alias("known")
    cut = met.groupBy("run").agg(known).join(F.broadcast(dear)).select("run", _split("run", "known", "unknown").alias("words"))
    whole = held.join(written(cut, "url-splits"), "run", "left").select("host", "at", F.coalesce("words", F.array("run")).alias("words"))
    return whole.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


def _path_words() -> Column:
    return F.regexp_extract_all(F.translate("path", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z]+)"), 1)


def train(urls: DataFrame, hosts: DataFrame, seeds: tuple = SEEDS) -> tuple[DataFrame, float]:
    """((w, odds) of every word, log odds of the classes): add-one multinomial naive Bayes.

    urls has a row for each URL (host, path), hosts their words; hosts with a seed word are bad.
    """
    listed = F.array(*(F.lit(w) for w in seeds)).cast("array<string>")
    marked = hosts.select("host", "words", F.arrays_overlap("words", listed).alias("bad"))
    # words of hosts and of paths are counted apart, so that neither travels with the other
    of_hosts = urls.groupBy("host").agg(F.count("*").alias("n")).join(marked, "host")
    said = urls.where("path <> '' and host <> ''").select("host", F.explode(_path_words()).alias("w")).groupBy("host", "w").agg(F.count("*").alias("n"))
    tokens = of_hosts.select("bad", "n", F.explode("words").alias("w")).unionByName(said.join(marked, "host").select("bad", "n", "w"))
    sums = lambda: (F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    by_word = written(tokens.groupBy("w").agg(*sums()), "url-odds")
    bad_all, good_all, n_words = (x or 0 for x in by_word.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    bad_urls, good_urls = (x or 0 for x in of_hosts.agg(*sums()).first())
    odds = F.log((F.col("bad") + 1) / (bad_all + n_words + 1)) - F.log((F.col("good") + 1) / (good_all + n_words + 1))
    return by_word.select("w", odds.alias("odds")), math.log((bad_urls + 1) / (good_urls + 1))


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", seeds: tuple = SEEDS) -> DataFrame:
    """Every row's id, host, path, rule, verdict, words (of the host) and log odds of being bad."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = written(urls, "urls")
    hosts = written(host_words(urls), "url-hosts")
    odds, prior = train(urls, hosts, seeds)

    def scored(rows: DataFrame, key: str) -> DataFrame:
        summed = rows.select(key, F.explode("words").alias("w")).join(odds, "w").groupBy(key).agg(F.sum("odds").alias(f"{key}_odds"))
        return rows.join(summed, key, "left").withColumn(f"{key}_odds", F.coalesce(f"{key}_odds", F.lit(0.0)))

    by_host = written(scored(hosts, "host"), "url-host-scores").withColumnRenamed("words", "host_words")
    paths = urls.select("path").where("path <> ''").distinct().select("path", _path_words().alias("words"))
    by_path = written(scored(paths, "path").drop("words"), "url-path-scores")
    rows = urls.join(by_host, "host", "left").join(by_path, "path", "left")
    log_odds = F.when(F.col("host") != "", F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)))
    found = rule_match(F.col("host"), F.col("path"), rules)
    method = F.when(log_odds > 0, "block").otherwise("allow")
    return rows.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        (found["rule"] if rules else F.lit(None).cast("string")).alias("rule"),
        (F.coalesce(found["verdict"], method) if rules else method).alias("verdict"),
        F.coalesce(F.array_join("host_words", " "), F.lit("")).alias("words"),
        F.round(log_odds, 6).alias("log_odds"),
    )
