"""URL filter: rules first, then host word segmentation (unigram Viterbi) and multinomial naive Bayes over host and path words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, quoted, sliced

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Characters of the longest word that the segmentation knows: a label of a host has no more.
LONGEST = 63
#: What is not text in a page. A comment, script or style without an end goes on to the end of the page, so each character is read once.
MARKUP = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>|&[#\w]++;"


def parts(url: str) -> tuple[Column, Column]:
    """(host, path) as the contract defines them; both empty if url is null or has no ://."""
    u = F.coalesce(quoted(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.lit(2**31 - 1) - at - 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; of equally long rules the last given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _pieces(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _viterbi(name: str, logs: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The likeliest split of a name into words; a character outside all words costs `unknown`, runs of such form one word."""
    best, back = [0.0], [0]
    for j in range(1, len(name) + 1):
        value, cut = best[j - 1] + unknown, j - 1
        for i in range(max(0, j - longest), j):
            if (p := logs.get(name[i:j])) is not None and best[i] + p > value:
                value, cut = best[i] + p, i
        best.append(value)
        back.append(cut)
    words, j = [], len(name)
    while j:
        words.append((name[back[j] : j], name[back[j] : j] in logs))
        j = back[j]
    out: list[str] = []
    loose = ""
    for word, known in reversed(words):
        if known:
            out += [loose, word] if loose else [word]
            loose = ""
        else:
            loose += word
    return out + [loose] * bool(loose)


def _substrings(longest: int):
    """(nid, word, whole) for each distinct substring of 2 to `longest` characters of each name; whole marks the name itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            for nid, name in zip(batch["nid"], batch["name"]):
                for at in range(0, max(1, len(name) - 1), 10_000):  # a stretch of a very long name at a time
                    words = {name[i : i + k] for i in range(at, min(at + 10_000, len(name))) for k in range(2, min(longest, len(name) - i) + 1)}
                    if words:
                        yield pd.DataFrame({"nid": nid, "word": list(words), "whole": [w == name for w in words]})

    return run


def segmented(names: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(name, words) for distinct names: (nid, name), by the counts (word, n, hosts) of the words.

    n counts a word's uses in texts, hosts the hosts that use it as a whole name; a name's own host is left out, so a name that only one
    host has doesn't vouch for itself. The substrings of each name, under its number, meet the counts in a join, so a task holds
    the words of its names only, never the vocabulary.
    """
    total = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("hosts"), F.lit(0))).alias("total"))  # one row
    pieces = cut(names.select("nid", "name").mapInPandas(_substrings(longest), "nid long, word string, whole boolean"))
    held = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    found = hot_join(pieces, cut(counts.join(held, "word")), "word", "held", F.col("nid"), pieces.count()).withColumn("n", F.col("n") + F.col("hosts") - F.col("whole").cast("int")).where("n > 0")
    logs = found.crossJoin(F.broadcast(total)).select("nid", F.struct("word", F.log(F.col("n") / F.col("total")).alias("p")).alias("log"))
    by_name = logs.groupBy("nid").agg(F.collect_list("log").alias("logs"))
    rows = names.join(by_name, "nid", "left").crossJoin(F.broadcast(total))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            out = []
            for name, logs, total in zip(batch["name"], batch["logs"], batch["total"]):
                unknown = -math.log(max(2.0, float(total))) - 3.0
                out.append(_viterbi(name, {x["word"]: x["p"] for x in logs} if logs is not None else {}, unknown, longest))
            yield pd.DataFrame({"name": batch["name"], "words": out})

    return rows.select("name", "logs", "total").mapInPandas(split, "name string, words array<string>")


def judged_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules=RULES, alpha: float = 1.0,
    longest: int = LONGEST, hidden: int = 0,
) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, words (segmented), log_odds (block over allow), learned.

    The classifier learns from the urls that the rules decide and judges those that none fits; every row has its log_odds, so its
    judgement can be compared with the rules'. With hidden = k, urls whose hash is divisible by k are not learned from. Words are counted
    over the whole text of all pages, and names once for each host that uses them. Null urls and urls without :// have empty host and path,
    and like other urls without words they follow the prior; without any url to learn from the odds are 0 and the verdict is allow.
    Rows without an id and repeated rows are judged like any other. Other columns of pages are left out.
    """
    host, path = parts(url_col)
    rule, fixed = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "fixed": fixed})
    shown = F.pmod(F.xxhash64("host", "path"), F.lit(hidden)) != 0 if hidden else F.lit(True)
    rows = rows.withColumn("learned", F.col("fixed").isNotNull() & shown)
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()))  # numbers are kept from here on
    tokens = rows.select("rid", "host", "path", "fixed", "learned", F.posexplode(_pieces(F.concat_ws("/", "host", "path"))).alias("i", "name"))
    bad, good = (F.sum(F.when(F.col("learned") & (F.col("fixed") == v), 1).otherwise(0)) for v in ("block", "allow"))
    by_host = tokens.groupBy("name", "host").agg(F.count(F.lit(1)).alias("n"), bad.alias("b"), good.alias("a"))
    names = by_host.groupBy("name").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("uses"), F.sum("b").alias("b"), F.sum("a").alias("a"))
    names = cut(names.withColumn("nid", F.monotonically_increasing_id()))
    counts = names.select(F.col("name").alias("word"), F.lit(0).cast("long").alias("n"), "hosts")
    if html_col:
        text = F.regexp_replace(F.coalesce(quoted(html_col), F.lit("")), MARKUP, " ")
        words = pages.select(F.explode(_pieces(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.unionByName(words.withColumn("hosts", F.lit(0).cast("long")))
    # single letters are no words
    counts = counts.where(F.length("word").between(2, longest)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("hosts").alias("hosts"))
    split = cut(segmented(names.select("nid", "name"), cut(counts), longest))

    hits = names.select("name", "b", "a").join(split, "name").select("b", "a", F.explode("words").alias("word"))
    hits = hits.groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("held"))
    sums = hits.agg(F.sum("b").alias("sb"), F.sum("a").alias("sa"), F.count(F.lit(1)).alias("v"))  # one row
    odds = hits.crossJoin(F.broadcast(sums)).select(
        "word", "held", (F.log((F.col("b") + alpha) / (F.col("sb") + alpha * F.col("v"))) - F.log((F.col("a") + alpha) / (F.col("sa") + alpha * F.col("v")))).alias("w")
    )
    odds = cut(odds)
    by_word = hot_join(split.select("name", F.explode("words").alias("word")), odds, "word", "held", F.col("name"), odds.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0])
    by_word = by_word.groupBy("name").agg(F.sum("w").alias("w"))
    weighed = cut(split.join(by_word, "name").join(names.select("name", "uses"), "name"))
    many = tokens.select("rid", "i", "name")
    scored = hot_join(many, weighed, "name", "uses", F.col("rid"), weighed.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])
    scored = scored.groupBy("rid").agg(F.sum("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "words"))).alias("parts"))
    scored = scored.select("rid", "w", F.flatten(F.transform("parts", lambda s: s["words"])).alias("words"))
    is_bad, is_good = (F.sum(F.when(F.col("learned") & (F.col("fixed") == v), 1).otherwise(0)) for v in ("block", "allow"))
    prior = rows.agg(is_bad.alias("nb"), is_good.alias("na"))  # one row
    start = F.log((F.coalesce("nb", F.lit(0)) + alpha) / (F.coalesce("na", F.lit(0)) + alpha))
    judged = rows.join(scored, "rid", "left").crossJoin(F.broadcast(prior)).withColumn("log_odds", start + F.coalesce("w", F.lit(0.0)))
    words = F.coalesce("words", F.array().cast("array<string>"))
    by_odds = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", by_odds).alias("verdict"), words.alias("words"), "log_odds", "learned"
    )
