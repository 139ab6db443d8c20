"""The filter audit against counting every order by hand."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from veridata.llm import filteraudit as fa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {c for c, f in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words),
                                       100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))) if f}


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = []
    for doc, text, source in rows:
        smaller = [d for d, t, _ in rows if (t or "") == (text or "") and d is not None and (doc is None or d < doc)]
        docs.append((source or "", doc, fails(text or "") | ({"E"} if smaller else set())))
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [(d, f) for p, d, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return out


def corpus():
    rng = random.Random(5)
    words = ["ab", "Cd", "EFG", "x#", "y$z", "été", " q", "lorem", "ipsum", "dolor", "sit"] + [f"w{i}" for i in range(90)]
    rows = []
    for d in range(120):
        pool = rng.sample(words, rng.randint(2, len(words)))
        text = rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b \r", "  "]).join(rng.choices(pool, k=rng.choice([0, 3, 49, 50, 51, 120])))
        rows.append((d, text, rng.choice(["a", "b", "", None])))
    rows += [(200 + i, rows[i % 7][1], "hot") for i in range(40)]
    rows += [(None, rows[3][1], "a"), (None, "only without id", "a"), (None, "only without id", "a"), (5, rows[5][1], "b"),
             (6, "other text of the same id", "b"), (300, None, None), (301, "", "b"), (302, "W " * 30_000, "long")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 230, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    return rows, labels


def test_every_order_of_every_part(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(d, t, None, s, None) for d, t, s in rows], DOCS).withColumn("part", F.lit("clash")) \
        .withColumn("mask", F.lit(7)).withColumn("n", F.lit("x"))
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in fa.audit(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert fa.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], DOCS)
    rows = fa.audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""}
    assert {(r["removed"], r["redundant"]) for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {(1, 0)}


def test_walk_equals_counting():
    counts = np.random.default_rng(2).integers(0, 9, (4, 32, 3))
    states = fa.gray_walk(counts)
    for subset in range(32):
        assert (states[:, subset] == counts[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
