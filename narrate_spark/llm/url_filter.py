"""URL filter: rules first, then naive Bayes on segmented hosts and paths.

Host names are cut into words by a unigram Viterbi: word counts come from the
texts of all pages, and of all cuts of a name the most probable is taken.  Only
distinct names are cut, and only the counts of their own substrings are looked
up, by a join, so neither hosts nor words are held as a whole anywhere.

Multinomial naive Bayes then scores the words of host and path.  Pages whose tokens
hold a seed word train the class to block, all others the class to allow.
Tokens are counted one by one, and smoothing takes the number of distinct ones.  The
log odds are joined to the tokens of the pages and summed by page; of the most
frequent tokens, at most ``HOT``, they are broadcast, so no key of the join is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

# Rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Words that mark a page as one to block when the class is learned.
SEEDS = ("adult", "bet", "casino", "drugs", "gambling", "hack", "malware", "nude", "phishing", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
# Longest word of the unigram model.
MAX_WORD = 24
# Tokens with over one in so many occurrences are broadcast.
HOT = 1000

_TOKENS = "[\\p{L}\\p{M}]+"


def url_host(url: Column) -> Column:
    """Host of a URL in lower case: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*+)", 1)
    return F.translate(host, common.UPPER, common.LOWER)


def url_path(url: Column) -> Column:
    """Path of a URL: behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*+([^?#]*+)", 1)


def match_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, count) over whole texts, tags left out."""
    plain = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "<[^<>]*+>", " ")
    return (
        texts.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(_TOKENS), F.lit(0))).alias("word"))
        .filter(F.char_length("word") <= MAX_WORD)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def viterbi(name: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable cut of a name; ``known``: start, size and count of the words in it.

    An unknown piece is the less likely the longer it is.  Of equal cuts the one
    with the longer last word is taken.
    """
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    counts = {(start, size): count for start, size, count in known}
    for end in range(1, len(name) + 1):
        for size in range(min(end, MAX_WORD), 0, -1):
            count = counts.get((end - size, size), 10 / 10**size)
            p = best[end - size] + math.log(count / total)
            if p > best[end]:
                best[end], back[end] = p, size
    words, end = [], len(name)
    while end:
        words.append(name[end - back[end] : end])
        end -= back[end]
    return words[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names, cut by the word counts."""
    total = int(counts.agg(F.sum("count")).first()[0] or 1)
    size = F.least(F.lit(MAX_WORD), F.char_length("name") - F.col("start") + 1)
    pieces = (
        names.select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("start"))
        .select("name", "start", F.explode(F.sequence(F.lit(1), size)).alias("size"))
        .withColumn("word", F.substr("name", "start", "size"))
    )
    # a name's pieces are at most its length times MAX_WORD
    known = (
        pieces.join(counts, "word", "left")
        .groupBy("name")
        .agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct(F.col("start") - 1, "size", "count"))).alias("known"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").to_pylist()
            words = [
                viterbi(name, [tuple(k.values()) for k in known], total)
                for name, known in zip(names, b.column("known").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return known.mapInArrow(cut, "name string, words array<string>")


def page_tokens(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Host, path, rule, its verdict, the host's words and all tokens of each page."""
    base = common.stored(
        pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    hosts = base.select("host").distinct()
    names = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(_TOKENS), F.lit(0))).alias("at", "name"))
    names = common.stored(names)
    segments = common.stored(segment_names(names.select("name").distinct(), common.stored(word_counts(pages, "html"))))
    words = (
        names.join(segments, "name")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))
    )
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    in_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit(_TOKENS), F.lit(0)), lambda t: F.concat(F.lit("/"), t))
    words_ = F.coalesce("words", F.array().cast("array<string>"))
    return base.join(words, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), words_.alias("words"), F.concat(words_, in_path).alias("tokens")
    )


def learn(tokens: DataFrame, seeds: tuple[str, ...] = SEEDS) -> tuple[float, int, DataFrame]:
    """Prior log odds of the class to block, number of occurrences, and (token, n, odds) of each distinct token.

    Every page counts.  Only sums come to the driver.
    """
    marks = [*seeds, *(f"/{s}" for s in seeds)]
    bad = F.exists("tokens", lambda t: t.isin(marks)).cast("long")
    known = tokens.select("tokens", bad.alias("bad"))
    pages, blocked = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    counts = common.stored(
        known.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    )
    distinct, all_, bad_ = counts.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "bad"))).first()
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad_ + distinct))) - F.log((F.col("n") - F.col("bad") + 1) / F.lit(float(all_ - bad_ + distinct)))
    # decimals, so that a page's sum does not depend on the order of its tokens
    return math.log((blocked + 1) / (pages - blocked + 1)), all_, counts.select("token", "n", odds.cast("decimal(18,12)").alias("odds"))


def page_odds(tokens: DataFrame, odds: DataFrame, total: int) -> DataFrame:
    """(row, odds): sum of the log odds of all tokens of each row that has any."""
    own = tokens.select("row", F.explode("tokens").alias("token"))
    is_hot = F.col("n") * HOT > total
    hot = F.broadcast(odds.filter(is_hot).select("token", "odds"))
    found = own.join(hot, "token").select("row", "odds").union(
        own.join(hot.select("token"), "token", "left_anti").join(odds.filter(~is_hot), "token").select("row", "odds")
    )
    return found.groupBy("row").agg(F.sum("odds").cast("double").alias("odds"))


def filter_urls(pages: DataFrame, rules: tuple = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Verdict on each page (page_id, url, html; other columns are not read).

    A rule decides where one fits, else naive Bayes: ``score`` is its probability
    of the class to block, which from one half on is the verdict.  Null and
    malformed urls have empty host and path, so only the prior speaks.  Rows are judged
    one by one: repeated rows and null ids are kept, an empty table gives no row.
    """
    tokens = common.stored(page_tokens(pages, rules).withColumn("row", F.monotonically_increasing_id()))
    prior, total, odds = learn(tokens, seeds)
    judged = tokens.join(page_odds(tokens, odds, total), "row", "left")
    sum_ = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(prior) + F.coalesce("odds", F.lit(0.0))))
    judged = judged.withColumn("score", 1 / (1 + F.exp(-sum_)))
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``."""
    return filter_urls(common.table(spark, sf_dir, "pages"))
