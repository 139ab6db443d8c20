"""URL filter: rules first, then naive Bayes over segmented host and path words.

Host labels are concatenated names; a unigram Viterbi splits them into words. Its counts
come from the words of all pages. Only the substrings of distinct labels are looked up, by
a join, so no vocabulary is broadcast. A multinomial naive Bayes over the words of host and
path, hashed into a fixed number of slots (which bounds the model), is trained on the URLs
that the rules decide and on seed words, and judges those that no rule decides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, stage

SLOTS = 1 << 16
LONGEST = 20
UNSEEN = 1e-3
SEED_WEIGHT = 0.2

# Words that mark a host as unwanted.
BLOCK_WORDS = ("adult", "betting", "casino", "cheap", "escort", "farm", "gambling", "lottery", "pills", "poker",
               "porn", "sex", "spam", "viagra", "warez", "xxx")

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; the path then up to ``?``, ``#`` or the end. Null or without ``://``: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, *LOWER), F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null if none does. A rule is a host
    with a path; it fits its host and all subdomains if the url's path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    # the longest is asked first, so it stands outermost
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(word, n)``: lower-case runs of letters of all texts, tags left out."""
    plain = F.lower(F.regexp_replace(F.col(column), "<[^>]*>", " "))
    return (texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), 1)).alias("word"))
            .where(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def viterbi(label: str, logs: dict[str, float], unseen: float) -> list[str]:
    """The split of a label into words of the largest summed log probability; a letter run
    that is no known word costs ``unseen`` for each character. Ties: the longer last word."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            part = label[start:end]
            options.append((best[start] + logs.get(part, unseen * len(part) * 1.5), -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``(label, words)`` for distinct ``labels (label)`` by counts ``(word, n)``."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    unseen = math.log(UNSEEN / (total + 1))
    starts = F.sequence(F.lit(1), F.length("label"))
    pieces = (labels.where(F.length("label") > 0).select("label", F.explode(starts).alias("s"))
              .select("label", F.explode(F.transform(
                  F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("s") + 1)),
                  lambda n: F.substr("label", F.col("s"), n))).alias("word")).distinct())
    known = (pieces.join(counts, "word").groupBy("label")
             .agg(F.collect_list(F.struct("word", "n")).alias("found")))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(label, found):
            logs = {} if rows is None else {r["word"]: math.log(r["n"] / (total + 1)) for r in rows}
            out.append(viterbi(text, logs, unseen))
        return pd.Series(out)

    # a label has at most LONGEST times its length substrings
    return labels.where(F.length("label") > 0).join(known, "label", "left").select(
        "label", split("label", "found").alias("words"))


def parts_of(host: Column) -> Column:
    """Letter and digit runs of a host, without its last label."""
    return F.filter(F.split(F.regexp_replace(host, r"\.?[^.]*$", ""), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def url_tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, path, tokens)`` for distinct ``urls (host, path)``: the words of the host's
    labels (marked ``h:``) and the runs of letters and digits of the path (``p:``)."""
    hosts = urls.select("host").distinct()
    parts = stage(hosts.select("host", F.posexplode(parts_of(F.col("host"))).alias("no", "label")), "labels")
    words = segment(parts.select("label").distinct(), counts)
    # a host has at most 253 characters
    split = (parts.join(words, "label").groupBy("host")
             .agg(F.sort_array(F.collect_list(F.struct("no", "words"))).alias("x"))
             .select("host", F.transform(F.flatten(F.col("x.words")), lambda w: F.concat(F.lit("h:"), w)).alias("hw")))
    path = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return urls.join(split, "host", "left").select("host", "path", F.concat(
        F.coalesce("hw", F.array().cast("array<string>")),
        F.transform(path, lambda w: F.concat(F.lit("p:"), w))).alias("tokens"))


def train_bayes(labelled: DataFrame, seeds: tuple[str, ...] = BLOCK_WORDS, slots: int = SLOTS,
                seed_weight: float = SEED_WEIGHT) -> np.ndarray:
    """Log odds for block by slot, the prior's last, from ``labelled (tokens, verdict, n)``.
    Every seed word counts as ``seed_weight`` of all block words. Laplace smoothing."""
    block = F.col("verdict") == "block"
    counts = (labelled.select(F.explode("tokens").alias("t"), "n", block.cast("long").alias("b"))
              .groupBy(F.pmod(F.xxhash64("t"), F.lit(slots)).cast("int").alias("slot"))
              .agg(F.sum(F.col("n") * F.col("b")).alias("block"), F.sum(F.col("n") * (1 - F.col("b"))).alias("allow")))
    sums = np.zeros((2, slots))
    for row in counts.collect():  # at most `slots` rows
        sums[0, row["slot"]], sums[1, row["slot"]] = row["allow"], row["block"]
    weight = max(1.0, seed_weight * sums[1].sum())
    frame = labelled.sparkSession.range(1).select(F.array(*[
        F.pmod(F.xxhash64(F.lit(f"h:{w}")), F.lit(slots)).cast("int") for w in seeds]).alias("s")) if seeds else None
    for slot in (frame.first()["s"] if frame is not None else []):
        sums[1, slot] += weight
        sums[0, slot] = 0.0
    n_allow, n_block = labelled.agg(
        F.coalesce(F.sum(F.when(~block, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(block, F.col("n"))), F.lit(0))).first()
    odds = np.log(sums[1] + 1) - math.log(sums[1].sum() + slots) - np.log(sums[0] + 1) + math.log(sums[0].sum() + slots)
    return np.append(odds, math.log(n_block + 1) - math.log(n_allow + 1))


def judge(pages: DataFrame, rules: list[tuple[str, str]], counts: DataFrame, url: str = "url",
          seeds: tuple[str, ...] = BLOCK_WORDS, slots: int = SLOTS) -> DataFrame:
    """``pages``, all columns, with ``host``, ``path``, ``rule``, ``score`` (log odds for
    block) and ``verdict`` (under free names where one is taken) for every row: the rule's
    verdict, else block if the score is above 0. ``counts``: ``(word, n)`` for the split.

    A null url or one without ``://`` has an empty host and path; an empty host has no words
    and gets the prior's verdict; very long hosts and paths are used whole; repeated rows are
    judged alike; without any labelled url only the seeds speak; an empty table gives an
    empty one.
    """
    prepare(pages.sparkSession)
    bad = [r for r in rules if "/" not in r[0] or r[1] not in ("allow", "block")]
    if bad:
        raise ValueError(f"rules need a host, a slash and allow or block: {bad}")
    h, p, r, d, v, s = (free_name(pages, n) for n in ("host", "path", "rule", "decided", "verdict", "score"))
    host, path = url_parts(F.col(f"`{url}`").cast("string"))
    parsed = pages.withColumn(h, host).withColumn(p, path)
    rule, decided = matching_rule(F.col(h), F.col(p), rules)
    parsed = parsed.withColumn(r, rule).withColumn(d, decided)
    # equal urls are one row with their count from here on
    urls = stage(parsed.groupBy(F.col(h).alias("host"), F.col(p).alias("path"))
                 .agg(F.count(F.lit(1)).alias("n"), F.first(d).alias("verdict")), "urls")
    tokens = stage(url_tokens(urls.select("host", "path"), counts).join(urls, ["host", "path"]), "url-tokens")
    odds = train_bayes(tokens.where(F.col("verdict").isNotNull()), seeds, slots)

    @F.pandas_udf("double")
    def score(slot: pd.Series) -> pd.Series:
        return pd.Series([float(math.fsum(odds[np.asarray(x, dtype=np.int64)]) + odds[-1]) for x in slot], dtype="float64")

    hashed = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int"))
    scores = tokens.select(F.col("host").alias("h_"), F.col("path").alias("p_"), score(hashed).alias(s))
    joined = parsed.join(scores, (parsed[h] == scores["h_"]) & (parsed[p] == scores["p_"]), "left")
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], h, p, r, s,
                         F.coalesce(F.col(d), F.when(F.col(s) > 0, "block").otherwise("allow")).alias(v))
