"""Language ID by Bayesian evidence fusion: text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, quoted, sliced

BITS = 15
_MARKUP = re.compile(rb"(?is)<script.*?(?:</script>|\Z)|<style.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*+>|&[#\w]++;")
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


#: Trigrams that are looked up at a time, so that memory doesn't grow with languages times letters.
STRETCH = 1 << 18


def stretches(text: bytes) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the letters of a text, lower-cased in ASCII, one space between words; a stretch at a time."""
    text = b" " + _OTHER.sub(b" ", text.lower()) + b" "
    for i in range(0, len(text) - 2, STRETCH):
        x = np.frombuffer(text[i : i + STRETCH + 2], np.uint8).astype(np.uint32)
        yield (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def trigrams(text: bytes) -> np.ndarray:
    """All of them at once."""
    return np.concatenate([np.zeros(0, np.int64), *stretches(text)])


#: Languages whose trigram tables a task or the driver holds at a time: 16 MB. More are counted and scored in turns.
AT_ONCE = 64


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram counts by language, summed over the task as long as AT_ONCE languages suffice."""
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))

    def given() -> Iterator[pd.DataFrame]:
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": counts[at]})
        total.clear()

    for batch in sliced(batches):
        for lang, body in zip(batch["lang"], batch["body"]):
            if lang not in total and len(total) == AT_ONCE:
                yield from given()
            for grams in stretches(body):
                total[lang] += np.bincount(grams, minlength=1 << BITS)
    yield from given()


def language_code(lang: Column) -> Column:
    """The code of two or three letters of a language tag, in lower case; null if it is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([A-Za-z]{2,3})\s*(?:[-_].*)?$", 1)), F.lit(""))


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """(languages in the order of the alphabet, their trigram counts: lang, gram, n) from all rows of docs that have a language code.

    Any number of languages: only their names come to the driver, and there are at most 26^2 + 26^3 codes.
    """
    rows = docs.select(language_code(quoted(lang_col)).alias("lang"), F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("body")).where("lang IS NOT NULL")
    counts = cut(rows.mapInPandas(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return sorted(r[0] for r in counts.select("lang").distinct().collect()), counts


def log_table(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """The log probability of each trigram in each of some languages, at most AT_ONCE: a bounded table for driver and tasks."""
    found = counts.where(F.col("lang").isin(langs)).toPandas()
    table = np.full((len(langs), 1 << BITS), 0.5)
    table[found["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(int), found["gram"].to_numpy()] += found["n"].to_numpy()
    return np.log(table / table.sum(axis=1, keepdims=True))


def _text_logs(table: np.ndarray, weight: float):
    """The weighted log likelihoods of a page's text, one for each language of the table."""

    @F.pandas_udf("array<double>")
    def logs_of(body: pd.Series) -> pd.Series:
        out = []
        for b in body:
            logs = np.zeros(len(table))
            for grams in stretches(_MARKUP.sub(b" ", b)):
                logs += table[:, grams].sum(axis=1)
            out.append(logs * weight)
        return pd.Series(out)

    return logs_of


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(quoted(url), F.lit("")), r"://([^/?#]*)", 1)
    return F.lower(rest)


def _total(numbers: str) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def fused(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = 5.0,
    text_weight: float = 1 / 3,
) -> DataFrame:
    """One row per row of pages: id_col, lang, probability, text_lang, declared, suffix.

    A trigram's log likelihood counts `text_weight`, as each letter is in three. What a declared language and a suffix say of
    the language, and the priors of hosts, are sums of text posteriors over all pages; a host's prior is smoothed by its
    domain's with `strength` pages, and that by the corpus'. A page's own text is left out of all these sums, so it is evidence once. Null or
    empty pages have no text evidence and get what the other evidence says; without any languages in docs, lang is null. Equally likely
    languages: the first in the alphabet. Over AT_ONCE languages, texts are read once for each AT_ONCE of them. Repeated rows and rows without an id are rows like others. Other columns are left out.
    """
    langs, counts = text_model(docs)
    host = host_of(url_col)
    html = F.coalesce(quoted(html_col), F.lit(""))
    names = {
        "host": host, "domain": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
        "declared": F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang=[\"']?([a-z]{2,3})", 1)),
    }
    rows = pages.select(quoted(id_col).alias("_id"), *(c.alias(n) for n, c in names.items()), html.cast("binary").alias("_body"))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(F.col("_id").alias(id_col), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "suffix")

    rows = rows.withColumn("_rid", F.monotonically_increasing_id())
    logs = []
    for i in range(0, len(langs), AT_ONCE):
        if i:
            rows = cut(rows)  # so that no task holds the tables of two turns
        logs.append(f"_t{i}")
        rows = rows.withColumn(logs[-1], _text_logs(log_table(counts, langs[i : i + AT_ONCE]), text_weight)("_body"))
    rows = rows.select("_id", "_rid", *names, F.concat(*logs).alias("t"))
    top = F.array_max("t")
    rows = cut(rows.withColumn("p", F.transform("t", lambda x: F.exp(x - top))).withColumn("p", F.transform("p", lambda x: x / _total("p"))))
    sums = F.array(*(F.sum(F.get("p", F.lit(i))) for i in range(len(langs))))
    everything = rows.agg(F.count(F.lit(1)).alias("n"), sums.alias("g"))
    total = everything.first()["n"]
    summed = rows
    for by, prefix in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        # a hot key is one row per task in the aggregate, and dealt over many parts in the join
        facts = rows.groupBy(by).agg(F.count(F.lit(1)).alias(f"_n_{prefix}"), sums.alias(prefix))
        summed = hot_join(summed, facts, by, f"_n_{prefix}", F.col("_rid"), total)
    rows = summed.join(F.broadcast(everything.drop("n")))  # one row
    # sums without the page itself
    rows = rows.withColumns({of: F.zip_with(of, "p", lambda s, p: F.greatest(s - p, F.lit(0.0))) for of in "hdsmg"})
    rows = rows.withColumns({f"all_{of}": _total(of) for of in "hdg"})
    codes, n = F.array(*(F.lit(x) for x in langs)), len(langs)

    def score(i: Column) -> Column:
        h, d, s, m, g = (F.get(F.col(of), i) for of in "hdsmg")
        corpus = (g + 1) / (F.col("all_g") + n)
        domain = (d + strength * corpus) / (F.col("all_d") + strength)
        prior = (h + strength * domain) / (F.col("all_h") + strength)
        # how much likelier the declaration and the suffix are under this language; a declaration of it starts with credit
        credit = F.when(F.col("declared") == F.get(codes, i), 9.0 * strength).otherwise(strength)
        declared = F.when(F.col("declared") == "", 0.0).otherwise(F.log((m + credit) / (g + 10 * strength)))
        suffix = F.log((s + strength * corpus) / (g + strength))
        return F.get(F.col("t"), i) + declared + suffix + F.log(prior)

    each = F.sequence(F.lit(0), F.lit(n - 1))
    best = lambda of: F.array_sort(F.transform(each, lambda i: F.struct((-of(i)).alias("s"), F.get(codes, i).alias("l"))))
    rows = rows.select("_id", "declared", "suffix", best(score).alias("r"), best(lambda i: F.get(F.col("t"), i)).alias("x"))
    weight = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.exp(F.col("r")[0]["s"] - x["s"]))
    return rows.select(F.col("_id").alias(id_col), F.col("r")[0]["l"].alias("lang"), (1 / weight).alias("probability"), F.col("x")[0]["l"].alias("text_lang"), "declared", "suffix")
