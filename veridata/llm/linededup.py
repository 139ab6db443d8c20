"""Cross-site boilerplate: lines are removed by the number of distinct sites they occur on.

Each line hash gets one HyperLogLog sketch of its sites, merged by aggregation (combined
before the shuffle, so a line in a third of all rows is one sketch per task). A sketch far
from the threshold decides; lines near it, within four standard errors and one site at
least, get an exact distinct count. Only hashes, sites and positions are exploded; texts
are read once more to take the lines out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, prepare, stage

MIN_SITES = 10
LG_K = 12
SPACE = " \t\r"


def _key(doc_id, text):
    """128 bits that name a row by its id and text; rows alike in both count as one document."""
    return F.struct(F.xxhash64(doc_id, text).alias("x"), F.xxhash64(F.lit("row"), text, doc_id).alias("y"))


def line_sites(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Line hashes ``h`` of ``lines (h, site, at)`` found on ``min_sites`` distinct sites or
    more, with their first place ``first``. Null sites are not counted."""
    margin = max(1.0, 4 * 1.04 / math.sqrt(1 << lg_k) * min_sites)
    sketched = stage(
        lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"), F.min("at").alias("first"))
        .select("h", "first", F.hll_sketch_estimate("s").alias("sites"))
        .where(F.col("sites") >= min_sites - margin), "line-sketches")
    near = sketched.where(F.abs(F.col("sites") - min_sites) <= margin).select("h")
    exact = (lines.join(near, "h", "left_semi").where("site is not null").select("h", "site").distinct()
             .groupBy("h").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites))
    sure = sketched.where(F.col("sites") > min_sites + margin).select("h", "first")
    return sure.union(sketched.join(exact, "h").select("h", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source",
                       lg_k: int = LG_K) -> DataFrame:
    """``docs`` with every boilerplate line taken out of ``text`` but at its first place
    (smallest doc_id, then line number); a last column ``lines_removed`` counts them.

    Lines are what newlines part, compared without blanks, tabs and returns at their ends;
    blank lines always stay. Null text stays null, empty stays empty, with 0 removed; a
    null doc_id comes after all others; rows alike in doc_id and text count as one document
    and give equal rows; an empty table gives an empty table; all other columns are kept
    (a column that is named ``lines_removed`` already moves the count to a free name).
    """
    if min_sites < 2:
        raise ValueError("min_sites must be at least 2")
    prepare(docs.sparkSession)
    doc, text = F.col("doc_id"), F.col("text")
    lines = (docs.select(_key(doc, text).alias("k"), doc.alias("doc_id"), F.col(f"`{site}`").alias("site"),
                         F.posexplode(F.split(text, "\n")).alias("no", "line"))
             .select("k", "doc_id", "site", "no", F.btrim("line", F.lit(SPACE)).alias("line")).where("line <> ''")
             .select("k", "no", "site",
                     F.struct(F.xxhash64("line").alias("x"), F.xxhash64(F.lit("line"), "line").alias("y")).alias("h"),
                     F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"),
                              F.col("no"), F.col("k")).alias("at")))
    bad = line_sites(lines, min_sites, lg_k)
    hits = lines.join(bad, "h").where(F.col("at") != F.col("first")).select("k", "no").distinct()
    # a row of drops is never longer than its document
    drops = hits.groupBy("k").agg(F.collect_list("no").alias("nos"))
    k, drop, count = (free_name(docs, n) for n in ("row_key", "row_drops", "lines_removed"))
    joined = docs.withColumn(k, _key(doc, text)).join(
        drops.select(F.col("k").alias(k), F.col("nos").alias(drop)), k, "left")
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    new = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    removed = F.coalesce(F.size(drop), F.lit(0))
    return joined.select(
        *[F.when(F.col(drop).isNull(), text).otherwise(new).alias("text") if c == "text" else F.col(f"`{c}`")
          for c in docs.columns],
        F.when(F.col(drop).isNull(), 0).otherwise(removed).cast("long").alias(count))
