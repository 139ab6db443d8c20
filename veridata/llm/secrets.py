"""Secret scans with a random forest that removes false findings.

Candidates are long runs of key characters that hold a digit, mixed case or very many
characters, and shorter ones that a keyword assigns; a name in front of '=' is no part of
its value. Features: length, transitions between kinds of characters, digit share,
coverage by dictionary words (those that a share of all texts holds), the path and the
neighbouring words. The forest is trained on labelled findings. Everything is built from
DataFrame functions and MLlib; lines are split and filtered before words are looked at.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

BARE = "[A-Za-z0-9+/_-]"
KEY = "[A-Za-z0-9+/_=-]"
MIN_SHARE = 0.0002  # of all distinct texts, two of them at least
LONGEST = 24
MAX_FINDINGS = 20_000
NEAR = 2
WITHIN = 256  # characters of a line that `before` is taken from

# Words that announce a secret, and paths that hold examples.
ANNOUNCE = "(?:access|api[_-]?key|auth|bearer|credential|key|passwd|password|private|pwd|secret|token)"
JOINED = "(?:credential|passwd|password|secret|token|(?:access|api|auth|private|secret)key)"  # also at the end of clientSecret
KEYWORDS = rf"(?i)(?:(?<!\p{{L}}){ANNOUNCE}|{JOINED})s?(?!\p{{L}})"
EXAMPLE_PATH = r"(?i)(doc|example|fixture|mock|sample|test)"

# A name with a keyword and what stands between it and its value.
NAMED = rf"(?i:(?:(?<![A-Za-z]){ANNOUNCE}|{JOINED})s?(?![A-Za-z])[A-Za-z0-9_-]{{0,32}})"
SIGN = "[\"'`\\])]{0,2}\\s{0,8}(?:=>|:=|={1,3}|:)\\s{0,8}[\"'`]?"
LONG, SHORT = f"{BARE}{KEY}{{15,}}", f"{BARE}{KEY}{{7,14}}(?!{KEY})"
# A run starts after another character or after '='. A name goes off it if a value follows; a
# name of 16 characters is a run of its own.
RUN = (f"(?:(?<!{KEY})|(?<==))(?:{BARE}{{16,}}(?==+{LONG})|(?!{BARE}+=+{LONG})(?!{BARE}*?{NAMED}=+{BARE}{KEY}{{7}}){LONG}"
       f"|(?<=[=:>]\\s{{0,8}}[\"'`]?)(?={SHORT})(?<={NAMED}{SIGN}){SHORT})")
LINES = f"{KEY}{{16,}}|{NAMED}{SIGN}{BARE}{KEY}{{7}}"
# What a line has assigned before: the end of a value that is closed.
CLOSED = "(?s)^.*[=:]>?\\s*(?:\"[^\"]*\"|'[^']*'|`[^`]*`|[^\\s\"'`,;&]+[,;&])|^.*=[^\\s\"'`=]+\\s"
# The candidates among the runs, and where a name in camel case parts.
HIDDEN = f"(?:(?<!{KEY})|(?<==))(?={KEY}{{24}}|{KEY}*[0-9]|(?={KEY}*[a-z]){KEY}+[A-Z]){RUN}"
CASE = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def plausible(candidate: Column) -> Column:
    """Holds a digit, or both cases past its first letter, or 24 characters."""
    return (candidate.rlike("[0-9]") | (candidate.rlike("^.+[A-Z]") & candidate.rlike("[a-z]"))
            | (F.length(candidate) >= 24))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``(doc_id, path, line_no, start, candidate, before)`` for every candidate of ``docs``:
    ``start`` counts the characters of the line in front of it, ``before`` is the last words
    of these, of ``WITHIN`` characters at most."""
    lines = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{path}`").cast("string").alias("path"),
                         F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
             .where(F.col("line").rlike(LINES)))
    # a line is cut at its runs; the lengths of runs and of gaps add up to the starts
    runs, gaps = F.regexp_extract_all("line", F.lit(f"({RUN})"), 1), F.split("line", RUN)
    zipped = F.slice(F.arrays_zip(gaps.alias("gap"), runs.alias("run")), 1, F.size(runs))
    first = F.struct(F.array().cast("array<struct<start:int,near:string>>").alias("places"), F.lit(0).alias("at"),
                     F.lit("").alias("near"))

    def step(acc, x):
        near = F.right(F.concat(acc["near"], x["gap"]), F.lit(WITHIN))
        start = acc["at"] + F.length(x["gap"])
        return F.struct(F.concat(acc["places"], F.array(F.struct(start.alias("start"), near.alias("near")))).alias("places"),
                        (start + F.length(x["run"])).alias("at"),
                        F.right(F.concat(near, x["run"]), F.lit(WITHIN)).alias("near"))

    places = F.aggregate(F.col("z"), first, step)["places"]
    each = (lines.select("doc_id", "path", "line_no", zipped.alias("z"))
            .select("doc_id", "path", "line_no", F.explode(F.arrays_zip(F.col("z"), places.alias("place"))).alias("c"))
            .select("doc_id", "path", "line_no", F.col("c.place.start").alias("start"), F.col("c.z.run").alias("candidate"),
                    F.col("c.place.near").alias("near")))
    words = F.split(F.lower("near"), r"\s+")
    return each.where(plausible(F.col("candidate"))).select(
        "doc_id", "path", "line_no", "start", "candidate",
        F.concat_ws(" ", F.slice(words, F.greatest(F.lit(1), F.size(words) - NEAR), NEAR + 1)).alias("before"))


def dictionary(docs: DataFrame, min_share: float = MIN_SHARE, longest: int = LONGEST) -> DataFrame:
    """Distinct words of 3 to ``longest`` letters, parted at case changes, that ``min_share``
    of the distinct texts and two of them at least hold outside of candidates."""
    text = F.col("text").cast("string")
    rest = F.split(F.regexp_replace(F.regexp_replace(text, HIDDEN, " "), CASE, " "), r"[^\p{L}]+")
    each = F.array_distinct(F.transform(F.filter(rest, lambda w: F.length(w).between(3, longest)), F.lower))
    # copies of a text count once; the empty word counts the texts
    held = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("text"), F.explode(F.concat(each, F.array(F.lit("")))).alias("word"))
    counts = stage(held.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR word = ''"), "words")
    least = counts.where("word = ''").select(F.greatest(F.lit(2.0), F.col("n") * min_share).alias("least"))
    return counts.where("word <> ''").crossJoin(F.broadcast(least)).where("n >= least").select("word")


def coverage(found: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(candidate, coverage)`` for distinct ``found (candidate)``: the share of its
    characters that lie in dictionary words anywhere in its letter runs, which part at case
    changes."""
    parts = F.regexp_extract_all(F.lower(F.regexp_replace("candidate", CASE, " ")), F.lit(r"(\p{L}{3,})"), 1)
    runs = found.select("candidate", F.explode(parts).alias("run"))
    size = F.length("run")
    pieces = (runs.select("run").distinct()
              .select("run", F.explode(F.sequence(F.lit(1), size - 2)).alias("at"))
              .select("run", "at", F.explode(F.sequence(F.lit(3), F.least(F.lit(longest), size - F.col("at") + 1))).alias("n"))
              .select("run", "at", F.substr("run", F.col("at"), F.col("n")).alias("word")))
    # the longest word at each place; the letters of overlapping words count once
    best = (pieces.join(words, "word").groupBy("run", "at").agg(F.max(F.length("word")).alias("n"))
            .groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("places")))
    first = F.struct(F.lit(1).alias("end"), F.lit(0).alias("letters"))
    letters = F.aggregate("places", first, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["n"]).alias("end"),
        (acc["letters"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["end"], x["at"]))).alias("letters")))["letters"]
    covered = (runs.join(best.select("run", letters.alias("letters")), "run", "left")
               .groupBy("candidate").agg(F.sum(F.coalesce("letters", F.lit(0))).alias("letters")))
    return covered.select("candidate", (F.col("letters") / F.length("candidate")).alias("coverage"))


FEATURES = ["size", "transitions", "digits", "uppers", "hex", "covered", "example", "path_no", "keyword", "assigned",
            "quoted", "word_no"]


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns ``FEATURES`` (doubles, never null)."""
    c, before, path = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("path", F.lit(""))
    size = F.length(c)
    change = F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    covered = coverage(found.select("candidate").distinct(), words)
    last = F.try_element_at(F.filter(F.split(before, r"[^\p{L}]+"), lambda w: w != ""), F.lit(-1))
    own = F.regexp_replace(before, CLOSED, "")  # a keyword counts for the value that it assigns
    values = {
        "size": size, "transitions": F.regexp_count(c, change) / size, "digits": F.regexp_count(c, F.lit("[0-9]")) / size,
        "uppers": F.regexp_count(c, F.lit("[A-Z]")) / size, "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "covered": F.coalesce("coverage", F.lit(0.0)), "example": path.rlike(EXAMPLE_PATH).cast("int"),
        "path_no": F.pmod(F.xxhash64(path), F.lit(64)), "keyword": own.rlike(KEYWORDS).cast("int"),
        "assigned": before.rlike(r"[=:]>?\s*[\"'`]?$").cast("int"), "quoted": before.rlike("[\"'`]$").cast("int"),
        "word_no": F.when(last.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(last), F.lit(63)))}
    return found.join(covered, "candidate", "left").select(
        *[F.col(x) for x in found.columns], *[values[f].cast("double").alias(f) for f in FEATURES])


def likely_labels(features: DataFrame) -> DataFrame:
    """Labels for a corpus that has none: a run with digits that a keyword assigns is a
    secret, a plain number or a run without digits is not, the rest has no label (null)."""
    return features.withColumn("label", F.when(
        (F.col("keyword") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0) & (F.col("digits") < 1), 1.0)
        .when((F.col("digits") == 1) | (F.col("digits") == 0), 0.0))


def train(labelled: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 20, depth: int = 6) -> PipelineModel | None:
    """The forest from labelled findings (``FEATURES`` and ``label`` 0/1): at most
    ``max_findings`` of them, those of the smallest hashes. None if one class is missing."""
    rows = stage(labelled.where(F.col("label").isNotNull())
                 .orderBy(F.xxhash64("doc_id", "line_no", "start", "candidate"), "candidate").limit(max_findings)
                 .select("label", *FEATURES), "findings")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    return PipelineModel([vectors, forest.fit(vectors.transform(rows))])


def scan(docs: DataFrame, path: str = "source", findings: DataFrame | None = None, threshold: float = 0.5,
         max_findings: int = MAX_FINDINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, line_no, start, candidate, before, probability, is_secret)`` for every
    candidate of ``docs (doc_id, text, <path>)``.

    ``findings (doc_id, candidate, label)`` are labelled findings; without them
    ``likely_labels`` is used. If they hold one class or none, every candidate has
    probability 1 and nothing is removed. Null and empty texts have no candidates; a null
    path counts as empty, a null doc_id stays null; repeated rows give repeated candidates;
    lines of any length are used whole; an empty table gives an empty one; other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    found = stage(candidates(docs, path), "candidates")
    features = stage(with_features(found, dictionary(docs, min_share)), "secret-features")
    if findings is None:
        labelled = likely_labels(features)
    else:
        known = findings.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "candidate").agg(
            F.max(F.col("label").cast("double")).alias("label"))
        labelled = features.join(known, ["doc_id", "candidate"])
    model = train(labelled, max_findings)
    kept = ["doc_id", "line_no", "start", "candidate", "before"]
    if model is None:
        return features.select(*kept, F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret"))
    return model.transform(features).select(
        *kept, vector_to_array("probability")[1].alias("probability")).withColumn(
        "is_secret", F.col("probability") >= threshold)
