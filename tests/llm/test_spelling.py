"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridata.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, thin=31, least=7, twice=2, factor=10):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % thin == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= twice}
    near = defaultdict(set)
    by = defaultdict(set)
    for w in count:  # words one edit apart share a word with one code point left out
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
        by[w].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if plain_one_edit(a, b)}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= factor * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def plain_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def corpus(seed=1, size=150):
    rng = random.Random(seed)
    parts = ["an", "tion", "er", "st", "the", "où", "Ñé", "in", "ß", "÷a"]
    base = ["".join(rng.choices(parts, k=rng.randint(3, 5))) for _ in range(size)] + ["aaaaaaaa", "aaaaaaab", "aaaaaaa"]

    def odd(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + rng.choice("eEÿ") + w[i + 1:]])

    rows = []
    for d in range(400):
        words = [w if rng.random() < 0.9 else odd(w) for w in rng.choices(base, weights=[1 / (i + 1) for i in range(len(base))], k=30)]
        words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
        rows.append((d, rng.choice([" ", "\n", "1", "Ÿ ", "-"]).join(words)))
    long = "".join(rng.choices("abcdefg", k=3000))
    # chains of forms: each ten times the one before
    chain = [("chainword", 2000), ("chainwort", 150), ("chainwart", 12)]
    rows += [(1000 + i, " ".join([w] * 2)) for w, n in chain for i in range(n // 2)]
    rows += [(None, None), (7, None), (8, ""), (9, " \t"), (None, "nullword nullword nullwords nullwords")] + [(3, rows[3][1])] * 3
    rows += [(5000 + i, w) for i in range(4) for w in (long, long[:1500] + long[1501:], long[:-1] + "z")]
    return rows


@pytest.mark.parametrize("most", [50_000, 3])
def test_all_pairs(spark, most):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).selectExpr("*", "'x' AS word", "1 AS n", "0 AS root")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, most=most).collect()}
    want = brute(rows)
    assert got == want
    assert any(v[0] and v[0] != v[1] for v in want.values()) and sum(v[3] > 0 for v in want.values()) > 100


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    one = spark.createDataFrame([(1, "single words only", None, None, None)], DOCS)
    assert spelling.variants(one).collect() == []


def test_search_meets_every_near_pair_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abéž\U0001F600", k=rng.randint(3, 6))) for _ in range(300)})
    trees = [spelling.Trie(np.concatenate([np.zeros((len(words), 1), np.int64), spelling.vectors(words).astype(np.int64)], axis=1))] * 2
    met = Counter()
    for a, p, state in spelling.search(*trees):
        for x, y, s in zip(a, p, state):
            for i in trees[0].order[trees[0].leaves[x]:trees[0].leaves[x + 1]]:
                for j in trees[1].order[trees[1].leaves[y]:trees[1].leaves[y + 1]]:
                    if s or words[i] < words[j]:
                        met[frozenset((words[i], words[j]))] += 1
    near = {frozenset((a, b)) for a in words for b in words if plain_one_edit(a, b)}
    assert near <= set(met) and set(met.values()) == {1}
    counts, bucket = np.arange(len(words)), np.zeros(len(words), np.int64)
    found = Counter()
    for batch in spelling.near_in(words, counts, bucket, words, counts, bucket):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[word] += n
    assert found == Counter(w for pair in near for w in pair)


def test_one_edit():
    for a, b in [("abc", "abc"), ("abc", "abcd"), ("abc", "xabc"), ("abc", "axc"), ("abc", "acb"), ("abc", "abcde"), ("", "a"), ("aab", "ab")]:
        assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == plain_one_edit(a, b)
