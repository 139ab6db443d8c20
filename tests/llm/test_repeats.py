"""Repeated strings against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veridata.llm import repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p + 1:p + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((d, len(t), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, **how):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).selectExpr("*", "1 AS k", "'z' AS z", "0 AS `check`")
    got = repeats.remove_repeats(docs, **how).collect()
    return sorted(((r["doc_id"], r["n_bytes"], tuple(tuple(s) for s in r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
                   for r in got), key=str)


def corpus(length):
    rng = random.Random(length)
    words = ["alpha", "béta", "γ", "delta", "x", "longer", "\U0001F600", "and", "so"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(length // 6 + i * length // 8)[:max(length - 2 + i, 10)] for i in range(5)] + [text(length) for _ in range(3)]
    rows = []
    for d in range(60):
        parts = [text(rng.randint(0, length // 4))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(1, 30))]
        rows.append((d, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(5, rows[5][1])] * 2 + [(None, rows[7][1]), (None, None), (201, None), (202, "")]
    base = rows[8][1] + text(length)
    rows += [(210 + i, base[:len(base) // 2] + f" edit{i} " + base[len(base) // 2:]) for i in range(6)]
    rows += [(300, "a" * (2 * length + 3)), (301, "a" * length), (302, "b" * (length - 1)), (303, "ab" * length), (304, "c" * (length + 1))]
    one = "y" + text(length)[:length - 1]
    rows += [(310, one), (311, "z" + one), (312, one[:-1] + "!")]
    return rows


@pytest.mark.parametrize("length,most", [(32, 20_000), (50, 20_000), (400, 20_000), (50, 1), (400, 2)])
def test_every_string(spark, length, most):
    rows = corpus(length)
    want = brute(rows, length)
    assert result(spark, rows, length=length, most=most) == want
    assert 10 < sum(bool(w[2]) for w in want) < len(want)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    shared = "".join(rng.choices("abcdef ", k=900))
    rows = [(1, "".join(rng.choices("ghij ", k=3000)) + shared + "".join(rng.choices("klmn ", k=500))), (2, shared[100:] + "tail"),
            (3, "".join(rng.choices("opqr ", k=700_000)) + shared)]
    want = brute([r for r in rows if r[0] < 3], 400)
    got = {r[0]: r for r in result(spark, rows)}
    assert [got[1], got[2]] != want  # the third holds all of the passage
    assert got[1][2] == ((3000, 3900),) and got[3][2] == ((700_000, 700_900),) and got[2][2] == ((0, 800),)


def test_pieces_hold_every_string_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 100)
    text = bytes(random.Random(1).choices(range(97, 103), k=1234))
    seen = Counter()
    for group in repeats._pieces([b"short", text, b"x" * 60], 50):
        sizes = [len(p) for _, _, p in group]
        at, first, last = repeats.triggers(b"".join(p for _, _, p in group), sizes, 50)
        begin = np.cumsum(sizes) - sizes
        for a, lo, hi in zip(at, first, last):
            i = int(np.searchsorted(begin, lo, "right")) - 1
            for p in range(lo, hi + 1):
                seen[group[i][0], group[i][1] + p - begin[i]] += 1
            assert hi - repeats.reach_of(50) < a - repeats.reach_of(50) + 1 <= lo + 1 and hi <= a
    assert seen == Counter([(1, p) for p in range(1234 - 49)] + [(2, p) for p in range(11)])


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], DOCS), length=10)
