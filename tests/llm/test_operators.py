"""Pipeline operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from veridata.llm import (ann, decontaminate, licences, linededup, packing, queries, secrets, sharding, simhash, toxicity,
                          urlfilter)
from veridata.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "\n".join(f"line {i} of a very long text" for i in range(3000))
    return [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "b", 10), (3, "same text", None, "a", 9),
            (3, "same text", None, "a", 9), (4, "same text", "en", None, 9), (5, long, "en", "c", len(long)), (6, " \t\n ", "en", "d", 4)]


def empty(spark):
    return documents(spark, [])


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- components -------------------------------------------------------------------

def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 30)}, 300: 200}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


# ---- 9 SimHash --------------------------------------------------------------------

def plain_fingerprint(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, bits):
    root = list(range(len(ids)))
    for _ in ids:
        for i, j in itertools.combinations(range(len(ids)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_ball_hashing_finds_every_link(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)}
    fps |= {0, 7, (1 << 64) - 1, 1 << 63, 3 << 62}
    rows = [(i, simhash._signed(f)) for i, f in enumerate(sorted(fps))]
    got = {r["fp"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"), bits).collect()}
    par = {i: i for i, _ in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, f % (1 << 64)) for i, f in rows], 2):
        if (a ^ b).bit_count() <= bits:
            par[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {f: find(i) for i, f in rows}


def test_fingerprints_match_the_definition():
    for text in ["", None, "One", "Two WORDS", "A B\tc\x0bd\u00a0e É É", "x y z " * 40]:
        assert simhash.fingerprint(text, 3) % (1 << 64) == plain_fingerprint(text)


def test_near_duplicates_on_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumn("fp", F.lit("clash"))
    got = rows_of(simhash.near_duplicates(docs))
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for doc, fp, component in got:
        by[doc].add((fp, component))
    assert by[1] == by[2] == by[6] == {("0" * 16, 1)}
    assert {c for _, c in by[3] | by[4]} == {3}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5]
    assert rows_of(simhash.near_duplicates(empty(spark))) == [] and simhash.keep_first(empty(spark)).count() == 0


# ---- 1 line dedup -----------------------------------------------------------------

def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text, site in rows:
        for no, line in enumerate((text or "").split("\n")):
            if s := line.strip(" \t\r"):
                sites[s].add(site)
                first.setdefault(s, (doc, no))
    out = {}
    for doc, text, _ in rows:
        if text is None:
            out[doc, text] = (None, 0)
            continue
        kept, gone = [], 0
        for no, line in enumerate(text.split("\n")):
            s = line.strip(" \t\r")
            if s and len(sites[s] - {None}) >= min_sites and first[s] != (doc, no):
                gone += 1
            else:
                kept.append(line)
        out[doc, text] = ("\n".join(kept), gone)
    return out


@pytest.mark.parametrize("lg_k", [4, 12])
def test_boilerplate_matches_brute_force(spark, lg_k):
    rng = random.Random(3)
    pool = [f"shared line {i}" for i in range(30)]
    rows = []
    for d in range(300):
        lines = [pool[min(29, int(rng.expovariate(0.15)))] + rng.choice(["", " ", "\r"]) for _ in range(4)] + [f"own {d}", ""]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), f"s{rng.randint(0, 24)}" if d % 10 else None))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = linededup.remove_boilerplate(docs, 8, lg_k=lg_k)
    want = brute_lines(rows, 8)
    assert got.count() == len(rows) and sum(v[1] for v in want.values()) > 100
    assert {r["doc_id"]: (r["text"], r["lines_removed"]) for r in got.collect()} == {k[0]: v for k, v in want.items()}


def test_boilerplate_on_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumn("lines_removed", F.lit("clash"))
    got = linededup.remove_boilerplate(docs, 2)
    assert got.columns == docs.columns + ["_lines_removed"]
    assert sorted(map(str, rows_of(got.select(docs.columns)))) == sorted(map(str, rows_of(docs)))
    two = documents(spark, [(1, "x\ny", "", "a", 3), (2, "x", "", "b", 1), (None, "x", "", "c", 1)])
    assert sorted(rows_of(linededup.remove_boilerplate(two, 2).select("text", "lines_removed"))) == [("", 1), ("", 1), ("x\ny", 0)]
    assert linededup.remove_boilerplate(empty(spark)).count() == 0


def test_line_dedup_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, text, lines_removed FROM ({queries.OP1_SQL})").fetchall()
    assert sorted(rows_of(queries.op1_line_dedup(spark, SF))) == sorted(map(tuple, want))


# ---- 2 toxicity -------------------------------------------------------------------

def toxic_corpus(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    docs, labels = [], []
    for d in range(n):
        low, bad = rng.random() < 0.3, rng.random() < 0.3
        text = rng.choices(words, k=60) + ["$$$", "!!!"] * low + ["zworm" + rng.choice("abcde")] * bad
        rng.shuffle(text)
        docs.append((d, " ".join(text), "en", "s", 1))
        labels.append((d, int(not low), int(bad)))
    return docs, labels


def test_chain_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    known = toxicity.label_categories(spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int"))
    chain = toxicity.train(documents(spark, docs), known, toxicity.CATEGORIES, max_labelled=250)
    assert [len(m["c"]) for m in chain["models"]] == [0, 1]  # the later model gets the earlier probability
    got = {r["doc_id"]: (r["p_low_quality"] >= 0.5, r["p_toxic"] >= 0.5) for r in toxicity.score(documents(spark, docs), chain).collect()}
    right = [got[d] == (not q, bool(t)) for d, q, t in labels[250:]]
    assert sum(right) / len(right) > 0.97


def test_chain_without_labels_or_classes(spark):
    docs = documents(spark, odd_rows()).withColumn("p_toxic", F.lit("clash"))
    none = toxicity.label_categories(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    chain = toxicity.train(docs, none, toxicity.CATEGORIES)
    got = toxicity.score(docs, chain)
    assert got.columns == docs.columns + ["p_low_quality", "_p_toxic"]
    assert {r["_p_toxic"] for r in got.collect()} == {0.0} and got.count() == len(odd_rows())
    one = toxicity.label_categories(spark.createDataFrame([(3, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, toxicity.train(docs, one, toxicity.CATEGORIES)).where("_p_toxic >= 0.5").count() == 0
    assert toxicity.score(empty(spark), chain).count() == 0


# ---- 3 decontamination ------------------------------------------------------------

def sellers(pattern, text):
    """Fewest edits of ``pattern`` against any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 14)))) for i in range(8)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(20)]
        if d % 2:
            part = list(items[rng.randrange(8)][1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(part))
                part[at:at + 1] = rng.choice([[], ["x"], [part[at], "y"]])
            text.insert(5, "".join(part))
        docs.append((d, " ".join(text)))
    options = {"q": 5, "window": 40, "edit_rate": 0.1}
    want = {}
    for d, text in docs:
        for i, item in items:
            t, p = decontaminate.normal(text), decontaminate.normal(item)
            n = min(40, len(p))
            best = min((sellers(p[s:s + n], t), s) for s in range(len(p) - n + 1))
            if n >= 5 and best[0] <= min(n // 10, (n - 5) // 5):
                want[d, i] = best
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"), **options)
    assert {(r["doc_id"], r["item_id"]): (r["edits"], r["window_start"]) for r in got.collect()} == want and 10 < len(want) < 40
    blocks = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string"), block_chars=100, **options)
    assert sorted(rows_of(blocks)) == sorted(rows_of(got))


def test_long_items_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    item = "".join(rng.choices("abcdefgh", k=700))
    docs = spark.createDataFrame([(s, "x" * 20 + item[s:s + 100] + "y" * 20) for s in range(0, 601, 60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    whole = sorted(rows_of(decontaminate.matches(docs, bench)))
    assert [r[:3] + r[5:] for r in whole] == [(s, 1, s, 0) for s in range(0, 601, 60)]
    monkeypatch.setattr(decontaminate, "ITEM_PIECE", 150)
    assert sorted(rows_of(decontaminate.matches(docs, bench, block_chars=200))) == whole


def test_passages_at_every_place():
    """Passages of 100 to 116 characters with up to 8 edits, from every place of a long item."""
    rng = random.Random(5)
    item = decontaminate.normal(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(90)))
    index = decontaminate.Index([(1, item)], 8, 100, 1, 0.08)
    for at in range(len(item) - 116):
        size, edits = rng.randint(100, 116), rng.randint(0, 8)
        part = list(item[at:at + size])
        for place in rng.sample(range(size), edits):
            part[place] = rng.choice(["", "z", part[place] + "z"])
        text = "y" * rng.randint(0, 90) + "".join(part) + "y" * 50
        (_, start, _, _, found), = index.matches(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert found <= edits and abs(start - at) <= 24


def test_band_equals_the_whole_rectangle():
    rng = np.random.default_rng(3)
    for most in (0, 1, 3, 8):
        m, width = 30, 2 * most + 2
        patterns = rng.integers(0, 3, (40, m), dtype=np.uint32)
        texts = rng.integers(0, 3, (40, m + width - 1), dtype=np.uint32)
        for r in range(0, 40, 2):  # near copies: a few places changed along a diagonal
            d = rng.integers(0, width)
            texts[r, d:d + m] = patterns[r]
            texts[r, rng.integers(0, m + width - 1, most)] = 2
        # a path that leaves the band by its edits is more than `most` off its diagonals
        got = decontaminate.band_edits(patterns, texts, most)
        for r in range(40):
            least = sellers(patterns[r].tolist(), texts[r].tolist())
            assert got[r] >= min(least, most + 1)
            if r % 2 == 0 or least > most:
                assert got[r] == min(least, most + 1)


def test_matches_over_pieces(monkeypatch):
    rng = random.Random(9)
    item = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    index = decontaminate.Index([(1, item)], 8, 100, 25, 0.08)
    for at in range(900, 1300, 37):
        text = "".join(rng.choices("abcdefgh ", k=at)) + item[:130] + "".join(rng.choices("abcdefgh ", k=500))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        overlap = 2 * index.margin
        found = [index.matches(codes[x:x + 1000 + overlap]) for x in range(0, max(1, len(codes) - overlap), 1000)]
        assert any(found)


def test_decontamination_on_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it runs away from all the hounds of the county of Kent."
    rows = odd_rows() + [(9, "before " + item.upper().replace(" ", "\n") + " after", "en", "a", 1)] * 2
    docs = documents(spark, rows).withColumn("row_key", F.lit(1))
    bench = spark.createDataFrame([(None, item), (5, None), (6, ""), (7, "short")], "item_id long, text string")
    assert [r[:2] + (r[5],) for r in rows_of(decontaminate.matches(docs, bench))] == [(9, -1, 0)] * 2
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, rows_of(kept.drop("row_key")))) == sorted(map(str, odd_rows()))
    assert decontaminate.matches(empty(spark), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


# ---- 4 URL filter -----------------------------------------------------------------

def test_viterbi_is_the_best_split():
    counts = {"the": 50, "them": 8, "me": 20, "park": 9, "theme": 2, "ark": 4, "p": 1}
    total = sum(counts.values())
    logs = {w: np.log(n / (total + 1)) for w, n in counts.items()}
    unseen = float(np.log(1e-3 / (total + 1)))
    for label in ["themepark", "themark", "xpark", "qqq", "t", "parkthe"]:
        def cost(words):
            return sum(logs.get(w, unseen * len(w) * 1.5) for w in words)
        splits = [[label[a:b] for a, b in zip((0, *c), (*c, len(label)))]
                  for n in range(len(label)) for c in itertools.combinations(range(1, len(label)), n)]
        assert cost(urlfilter.viterbi(label, logs, unseen)) == pytest.approx(max(map(cost, splits)))


def test_url_rules_and_parts(spark):
    rows = [(1, "http://A.Example.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "http://x.net/es/1"), (4, "http://net/fr/"),
            (5, "http://example.com/en"), (6, None), (7, "no scheme"), (8, "ftp://a.org#x/y"), (9, "http://notexample.com/en/"),
            (10, "http://h?a://b/c"), (1, "http://A.Example.com/en/x?q#f")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash"))
    counts = spark.createDataFrame([("exam", 3), ("example", 5)], "word string, n long")
    got = urlfilter.judge(pages, queries.RULES, counts)
    assert got.columns == ["page_id", "url", "score", "host", "path", "rule", "_score", "verdict"]
    by = {r["page_id"]: tuple(r)[3:6] + (r["verdict"],) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert by[3][1:] == ("/es/1", "net/es/", "block") and by[4] == ("net", "/fr/", "net/fr/", "block")
    assert by[5][2:] == ("com/", "allow") and by[9][2:] == ("com/", "allow")
    assert by[6][:3] == by[7][:3] == ("", "", None) and by[8][:3] == ("a.org", "", None) and by[10][:2] == ("h", "")
    assert all(v[3] in ("allow", "block") for v in by.values())
    assert urlfilter.judge(pages.limit(0), queries.RULES, counts).count() == 0


def test_bayes_on_held_out_urls(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{'badword' if i % 3 == 0 else 'garden'}{rng.choice(['shop', 'blog', 'site'])}{i % 50}.org/"
             f"{'buy' if i % 3 == 0 else 'read'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    counts = spark.createDataFrame([(w, 50) for w in ("badword", "garden", "shop", "blog", "site")], "word string, n long")
    rules = [(f"{'badword' if i % 3 == 0 else 'garden'}{k}{i % 50}.org/", "block" if i % 3 == 0 else "allow")
             for i in range(0, 12) for k in ("shop", "blog")]
    got = urlfilter.judge(pages, rules, counts, seeds=()).where("rule IS NULL").select("page_id", "verdict").collect()
    right = [(r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got]
    assert len(got) > 100 and sum(right) / len(right) > 0.97


# ---- 5 secrets, 6 licences --------------------------------------------------------

def secret_corpus():
    rng = random.Random(4)
    docs = []
    for d in range(200):
        words = ["".join(rng.choices("aeioustrn", k=6)) for _ in range(30)]
        token = "".join(rng.choices("0123456789abcdef", k=40))
        number = "".join(rng.choices("0123456789", k=16))
        extra = [f'token = "{token}"'] if d % 2 else [f"order {number}"]
        docs.append((d, " ".join(words[:10] + extra + words[10:]) + "\nplain line", "en", "src", 1))
    return docs


def test_secret_spans_and_held_out_accuracy(spark):
    docs = secret_corpus()
    found = secrets.scan(documents(spark, docs), findings=secrets_labels(spark, docs[:100])).collect()
    assert len(found) == 200
    by = dict((d[0], d[1]) for d in docs)
    for r in found:
        line = by[r["doc_id"]].split("\n")[r["line_no"]]
        assert line[r["start"]:r["start"] + len(r["candidate"])] == r["candidate"]
    held = [r for r in found if r["doc_id"] >= 100]
    assert sum(r["is_secret"] == (r["doc_id"] % 2 == 1) for r in held) / len(held) > 0.97


def secrets_labels(spark, docs):
    rows = [(d, m, float(d % 2)) for d, text, *_ in docs for m in re.findall(r"[A-Za-z0-9+/_=-]{16,}", text)]
    return spark.createDataFrame(rows, "doc_id long, candidate string, label double")


def test_secret_names_give_their_evidence(spark):
    token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    lines = [(f"API_KEY={token}", token, "api_key=", 1), (f'aws_secret_access_key = "{token}"', token, 'aws_secret_access_key = "', 1),
             (f'DATABASE_PASSWORD = "{token}"', token, 'database_password = "', 1), (f'client_secret: "{token}"', token, 'client_secret: "', 1),
             (f'clientSecret: "{token}"', token, 'clientsecret: "', 1), ("password=hunter22x", "hunter22x", "password=", 1),
             ("db_password: 'S3cretPw9'", "S3cretPw9", "db_password: '", 1), (f"x = {token}==", token + "==", "x = ", 0),
             (f'{{"token":"abc","sha":"{token}"}}', token, '{"token":"abc","sha":"', 0), ("monkey: abcdefg12", None, None, 0)]
    docs = spark.createDataFrame([(i, x[0], "a") for i, x in enumerate(lines)], "doc_id long, text string, source string")
    words = spark.createDataFrame([], "word string")
    got = {r["doc_id"]: r for r in secrets.with_features(secrets.candidates(docs), words).collect()}
    for i, (line, candidate, before, keyword) in enumerate(lines):
        if candidate is None:
            assert i not in got
            continue
        r = got[i]
        assert (r["candidate"], r["before"], r["keyword"], r["assigned"]) == (candidate, before, keyword, 1)
        assert line[r["start"]:r["start"] + len(candidate)] == candidate


def test_secrets_on_odd_rows(spark):
    docs = documents(spark, odd_rows() + [(8, "key: " + "aB3" * 5000 + " and 1234567890123456 x", None, None, 1)] * 2)
    got = secrets.scan(docs.withColumn("candidate", F.lit("clash")))
    assert sorted((r["doc_id"], r["start"]) for r in got.collect()) == [(8, 5), (8, 5), (8, 15010), (8, 15010)]
    assert secrets.scan(empty(spark)).count() == 0


def test_coverage_by_dictionary_words(spark):
    found = spark.createDataFrame([("gardenhouse12345x",), ("qqqqzzzz1234567890",)], "candidate string")
    words = spark.createDataFrame([("garden",), ("house",), ("use",)], "word string")
    assert dict(rows_of(secrets.coverage(found, words))) == {"gardenhouse12345x": pytest.approx(11 / 17), "qqqqzzzz1234567890": 0}


def test_dictionary_is_a_share_of_distinct_texts(spark):
    token = "abcdef" + "0123456789" * 3
    rows = [(i, f"garden number{i % 7} key {token} the same copy") for i in [1] * 9]
    rows += [(i, f"garden w{chr(97 + i % 26)}{chr(97 + i // 26)}x house getUserName{i}0123456789 {token}") for i in range(100)]
    docs = spark.createDataFrame(rows + [(999, None)], "doc_id long, text string")
    # the copies are one text, the token and the name with digits are candidates
    assert {r["word"] for r in secrets.dictionary(docs, 0.5).collect()} == {"garden", "house"}
    assert {r["word"] for r in secrets.dictionary(docs, 0.0).collect()} == {"garden", "house"}
    camel = spark.createDataFrame([(1, "getUserName authentication"), (2, "the getUserName authentication")], "doc_id long, text string")
    assert {r["word"] for r in secrets.dictionary(camel).collect()} == {"get", "user", "name", "authentication"}


def test_coverage_of_whole_names(spark):
    found = spark.createDataFrame([("getUserAccountName1",), ("authenticationProvider",), ("HTTPServerGardenHouse",)], "candidate string")
    words = spark.createDataFrame([(w,) for w in ("get", "user", "account", "name", "authentication", "provider", "http", "server",
                                                  "gardenh", "garden", "house")], "word string")
    assert dict(rows_of(secrets.coverage(found, words))) == {
        "getUserAccountName1": pytest.approx(18 / 19), "authenticationProvider": 1, "HTTPServerGardenHouse": 1}


def test_licences(spark):
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choices("aeioustrnl", k=6)) for _ in range(20))
    docs, want = [], {}
    families = sorted(licences.TEMPLATES)
    for d in range(180):
        family = families[d % len(families)] if d % 2 else None
        docs.append((d, "\n".join([filler(), licences.TEMPLATES[family][0] if family else "My driving license was " + filler(), filler()]), "en", "s", 1))
        want[d] = family
    got = licences.scan(documents(spark, docs)).collect()
    lines = [r for r in got if r["unit"] == "line" and r["paragraph_no"] == 1]
    assert len(lines) == 180 and not any(r["confirmed"] for r in got if r["unit"] == "line" and r["paragraph_no"] != 1)
    right = [(r["family"] if r["confirmed"] else None) == want[r["doc_id"]] for r in lines]
    assert sum(right) / len(right) > 0.97
    odd = documents(spark, odd_rows() + [(8, "All rights reserved.", None, None, 1)] * 2).withColumn("family", F.lit(1))
    assert [r["doc_id"] for r in licences.scan(odd).where("confirmed").collect()] == [8, 8]
    assert licences.scan(empty(spark)).count() == 0


WRAPPED = {
    1: ("gpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
                   "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n"
                   "(at your option) any later version."),
    2: (None, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
              "Public License as published by\nthe Free Software Foundation; version 2 of the License."),
    3: ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
               "the following conditions\nare met:"),
    4: (None, "This work is licensed under the GNU General Public License, version 2."),
    5: ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    6: ("mit", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated "
               "documentation files (the\n\"Software\"), to deal in the Software without restriction"),
}


def test_wrapped_licences_and_versions(spark):
    rng = random.Random(8)
    filler = lambda: " ".join("".join(rng.choices("aeioustrnl", k=6)) for _ in range(15))
    docs = [(d, f"{filler()}\n{filler()}\n\n{text}\n \n{filler()}", "en", "s", 1) for d, (_, text) in WRAPPED.items()]
    docs += [(100 + d, "\n".join(filler() for _ in range(4)), "en", "s", 1) for d in range(200)]
    got = licences.scan(documents(spark, docs)).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(d, f) for d, (f, _) in WRAPPED.items() if f}
    units = licences.paragraphs(documents(spark, [(1, "a\nb\n \t\nc\n\n\nd\ne\n", "en", "s", 1)])).collect()
    assert [r["text"] for r in units if r["unit"] == "line"] == list("abcde")
    assert [[x for x in r["text"].split("\n") if x] for r in units if r["unit"] == "block"] == [["a", "b"], ["d", "e"]]


def test_cue_of_every_paragraph_is_the_patterns(spark):
    texts = ["Licence A\nplain", "LICENSE", "licen", "COPYRIGHT x", "all Rights Reserved.", "rights\nreserved", "Creative  Commons",
             "creative Commons", "CC BY", "xcc by", "xcc byx", "cc-by 4", "accc-by", "PERMISSION IS", "redistributed", "\u0130 licen\u017fe",
             "licen\u212ae", "\u03a3 licenSe\u03a3", "cc by\nnothing", "", None, " \n ", "plain\n\nplain\nredistribut"]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "CC BY", None, None, 1)] * 2)
    for splitter in ("\n", "x"):
        want = licences.paragraphs(docs, splitter).withColumn("cue", F.col("text").rlike(licences.CUES).cast("double"))
        got = licences.cued(docs.withColumn("hint", F.lit(False)).withColumn("low", F.lit("")), splitter)
        assert got.columns == want.columns and sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(want)))
        assert 0 < got.where("cue = 1").count() < got.count()


def test_licence_sample_comes_from_one_pass(spark, monkeypatch):
    plans, write = [], licences.stage

    def watched(df, name):
        if name == "licence-sample":
            raise InterruptedError(name)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(licences, "stage", watched)
    with pytest.raises(InterruptedError):
        licences.scan(documents(spark, odd_rows()))
    assert sum("Generate explode" in p for p in plans) == 1


def test_licence_model_runs_once_a_paragraph(spark, monkeypatch):
    plans, write = {}, licences.stage

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(licences, "stage", watched)
    licences.scan(documents(spark, odd_rows()))
    tests = [x for x in plans["licence-scored"].splitlines() if "Filter" in x]
    assert any("best" in x for x in tests) and not any("UDF" in x for x in tests)


def test_licence_lines_parsed_once_are_the_paragraphs(spark):
    texts = ["", None, " \n ", "a\nb", "\n\n\na.\nB", "a\n \t\n\nb\r\n\r\nc\n", "a\n\n", "\na\n\x0b\nb\n\f\n\n\n...\n-\n", "a\n\n\n\nb\nlicence v. 2.0.\n",
             "\u0130\n\u03a3\u03a3\n\u03a3", "x\u2028\u0085y\n\u00a0\nz", "a\n" * 300 + "\n" + "CC BY\n" * 300]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "a\nCC BY", None, None, 1)] * 2)
    for splitter in ("\n", "a"):
        want = licences.cued(docs, splitter).select("doc_id", "unit", "paragraph_no", licences.words(F.col("text")).alias("words"), "cue")
        got = licences.parsed(docs.withColumn("hint", F.lit(False)).withColumn("blocks", F.lit("")), splitter).select(want.columns)
        assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(want))) and got.where("unit = 'block'").count() > 5


def test_licence_words_are_runs_without_edge_dots(spark):
    texts = ["", " ", "...", "v. 2.0.", ".a..b. c", "A.B-C_D", "x" + "." * 50_000 + "y z" + "." * 50_000, "1." * 50_000,
             "\u0130stanbul \u03a3\u03a3. e\u0301a", "\u00c4rger \u4f60\u597d.\U0001d7d8 \u00b2", "a\nb\r\n.\tc", None]
    text = F.col("text")
    parts = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.]+"), lambda w: F.btrim(w, F.lit(".")))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        licences.words(text).alias("got"), F.filter(parts, lambda w: w != "").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and sum(r["got"] is None for r in rows) == 1


def test_every_template_has_a_cue():
    import re as r
    for texts in licences.TEMPLATES.values():
        assert all(r.search(licences.CUES, t) for t in texts)


# ---- 7 nearest neighbours ---------------------------------------------------------

def test_probe_sequence_is_in_order():
    rng = np.random.default_rng(0)
    rest = rng.random(4)
    cost = lambda step: sum(r * r if s < 0 else (1 - r) ** 2 if s > 0 else 0 for r, s in zip(rest, step))
    got = ann.probe_sequence(rest, 81)
    assert len(set(got)) == 81 and [cost(s) for s in got] == pytest.approx(sorted(map(cost, itertools.product((-1, 0, 1), repeat=4))))


def test_recall_and_scores(spark):
    got = queries.op7_nearest(spark, SF).collect()
    con = duckdb.connect()
    rows = con.execute(f"SELECT vec_id, embedding FROM read_parquet('{SF}/embeddings.parquet') ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([list(r[1]) for r in rows], dtype=np.float64)
    at = {i: n for n, i in enumerate(ids)}
    hits = total = 0
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in ids[ids % 20 == 0]:
        score = x @ x[at[q]]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[2] for m in mine] == pytest.approx([score[at[m[1]]] for m in mine])
        hits += len({ids[i] for i in order} & {m[1] for m in mine})
        total += len(order)
    assert hits / total >= 0.9


def test_best_of_tiny_norms():
    x = np.array([[1.0, 0.0], [3.0, 0.0], [2.0, 0.0], [3.0, 0.0]]) * 1e-9
    best, score = ann._best(x[:1], x, np.arange(4), 3)
    assert best.tolist() == [[1, 3, 2]] and score[0] == pytest.approx([3e-18, 3e-18, 2e-18], rel=1e-9)


@pytest.mark.parametrize("norms", ["one long", "log-normal"])
def test_recall_on_uneven_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(600) == 7, 100.0, 1.0)[:, None] if norms == "one long" else rng.lognormal(0, 1.5, (600, 1))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    # narrow and few probes: many queries meet too few candidates by their buckets alone
    for options in ({}, {"width": 0.3, "probes": 1, "tables": 1}):
        by = defaultdict(set)
        for r in ann.search(v, F.col("vec_id") % 6 == 0, **options).collect():
            by[r["query_id"]].add(r["vec_id"])
        shares = []
        for q in range(0, 600, 6):
            order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
            assert len(by[q]) == 20
            shares.append(len(by[q] & set(order)) / 20)
        assert np.mean(shares) >= 0.9 and min(shares) >= 0.5


def test_large_buckets_in_blocks(spark):
    rng = np.random.default_rng(3)
    hot = [0.5, -1.0, 0.25]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.standard_normal(3)]) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ids, x = np.arange(300), np.array([r[1] for r in rows])
    # so wide that all share a few buckets and every query visits all of them
    options = {"k": 7, "tables": 2, "hashes": 2, "width": 50.0, "probes": 9}
    whole = sorted(rows_of(ann.search(v, F.col("vec_id") % 4 == 0, **options)))
    assert sorted(rows_of(ann.search(v, F.col("vec_id") % 4 == 0, most=10, **options))) == whole
    want = []
    for q in range(0, 300, 4):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:7]
        want += [(q, r + 1, int(i), pytest.approx(score[i])) for r, i in enumerate(order)]
    assert whole == want


def test_nearest_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100, [2.0, 4.0]), (101, None), (102, [0.0, 0.0]), (103, [nan, 1.0]), (104, [inf, 1.0]),
                                                       (105, [None, 1.0]), (None, [1.0, 1.0]), (100, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(v, F.col("vec_id") % 20 == 0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 100}
    assert sorted(got[0]) == [(1, 100, 10.0), (2, 1, 5.0), (3, 2, 5.0), (4, 3, 5.0), (5, 4, 5.0)]
    assert sorted(got[20])[1:] == [(2, 0, 5.0), (3, 1, 5.0), (4, 2, 5.0), (5, 3, 5.0)]
    assert ann.search(v.limit(0), F.lit(True)).count() == 0


# ---- 8 packing --------------------------------------------------------------------

def check_packing(rows, ids_of, capacity):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, got in pieces.items():
        ids, at = ids_of[doc], 0
        for start, length, crc, total in sorted(got):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids_of.values()))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in docs}
    got = queries.op8_packing(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want) and check_packing(got, want, 1024) < 0.01


def odd_texts():
    rng = random.Random(3)
    marks = ["<|endoftext|>", " ", "  ", "\n", "\t", "\0", "\u00a0", "\u2003", "\x1c", "\x85", "'ll", "'S", "12", "٣", "ß", "e\u0301", "中文",
             "\U0001F600", "!?", "word", "Wörd", "<|endof", "text|>"]
    return ["", "a b\nc\n\nd \n e\t f", "x\0y z", "don't 'll 12 34.5!! ß\u00a0é \u2003z", "a" * 300 + " b", "\nq r\n", "a\x1cb \x85c",
            "<|endoftext|>", " a <|endoftext|>\n<|endoftext|><|endoftext|> b", "z" * 200_000 + " " * 5000 + "\n" * 999] + [
        "".join(rng.choices(marks, k=rng.randint(1, 30))) for _ in range(3000)]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = packing.Encoder(path), Tokenizer.from_file(path)
    texts = odd_texts()
    assert encoder.ranked is not None
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = packing.Encoder(other), Tokenizer.from_file(other)
    assert encoder.ranked is None
    for text, got in zip(texts, encoder.encode(texts[:200])):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_of_special_tokens(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate(odd_texts()))
    docs = documents(spark, [(d, t, None, None, None) for d, t in texts.items()])
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_packing(got, {d: tokenizer.encode(t, add_special_tokens=False).ids + [0] for d, t in texts.items()}, 1024)
    assert any(50256 in r["ids"] for r in got)


def test_packing_on_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumn("ids", F.lit(1))
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, min_cut=8).collect()
    assert sorted((r["length"], r["doc_tokens"], r["ids"]) for r in got if r["doc_id"] in (1, 2)) == [(1, 1, [0]), (1, 1, [0])]
    assert {None, 1, 2, 3, 4, 5, 6} == {r["doc_id"] for r in got}
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 3)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 64 and [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))]
               for b in bins.values())
    assert packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ---- 10 sharding ------------------------------------------------------------------

def check_sharding(rows, shards):
    places, load = defaultdict(list), defaultdict(int)
    for r in rows:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(shards))
    return load


def test_sharding(spark):
    got = queries.op10_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    load = check_sharding(got, 8)
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    homes = defaultdict(set)
    for r in got:
        homes[texts[r["doc_id"]]].add(r["shard"])
    copies = Counter(texts.values())
    cold = [t for t, n in copies.items() if n * (len(t.encode()) + 1) <= 0.02 * sum(load.values()) / 8 and n < 3]
    assert len(cold) > 700 and all(len(homes[t]) == 1 for t in cold)


def test_hot_text_is_spread(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i}", None, None, 1) for i in range(6000)]
    got = sharding.assign(documents(spark, rows), 4, 512).collect()
    load = check_sharding(got, 4)
    assert max(load.values()) < 1.02 * min(load.values())


def test_maps_and_edits(spark, tmp_path):
    rng = random.Random(0)
    weights = [rng.randint(1, 100) for _ in range(512)]
    old = sharding.new_map(weights, 4)
    more = [w * rng.choice([1, 1, 3]) for w in weights]
    edited = sharding.rebalance(old, more, 4)
    loads = sharding._loads({s: t for s, t, _ in edited}, more, 4)
    assert max(loads) <= 1.01 * sum(more) / 4 and sum(a[1] != b[1] for a, b in zip(old, edited)) < 200
    grown = sharding.grow(old, weights, 4)
    assert all(a[1] == b[1] or b[1] == 4 for a, b in zip(old, grown))
    loads = sharding._loads({s: t for s, t, _ in grown}, weights, 5)
    assert max(loads) - min(loads) < 0.05 * sum(weights) / 5
    path = str(tmp_path / "map")
    sharding.write_map(spark, path, 0, old)
    sharding.write_map(spark, path, 1, grown)
    assert sorted(rows_of(sharding.read_map(spark, path))) == grown and sorted(rows_of(sharding.read_map(spark, path, 0))) == old


def test_rows_alike_are_spread(spark):
    for hot in (7, None):  # a third of all rows are one id and one text
        rows = [(hot if i % 3 == 0 else i, "one row again and again" if i % 3 == 0 else f"text number {i}", None, None, 1) for i in range(12_000)]
        got = sharding.assign(documents(spark, rows).repartition(3)).collect()
        load = check_sharding(got, 8)
        mean = sum(load.values()) / 8
        assert all(abs(x - mean) < 0.02 * mean for x in load.values())
        assert max(Counter(r["virtual_slot"] for r in got).values()) < 30


def test_the_stored_map_is_read_and_edited(spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "map")
    docs = documents(spark, [(i, "w" * rng.randint(1, 400) + str(i), None, None, 1) for i in range(4000)])
    first = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 4, 512, path).collect()}
    assert sharding.versions(spark, path) == [0, 1]  # the even map, and its edit for these bytes
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 4, 512, path).collect()}
    assert again == first and sharding.versions(spark, path) == [0, 1]  # nothing to edit
    old = sharding.stored_rows(spark, path, 1)
    assert 0 < sum(shard != slot % 4 for slot, shard, _ in old) < 200
    # growth: one version moves slots into the new shard alone, as grow does
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 5, 512, path).collect()}
    weights = sharding.slot_bytes(sharding.to_slots(docs, 5, 512), 512)
    assert sharding.stored_rows(spark, path, 2) == sharding.grow(old, weights, 4)
    assert sum(a != grown[d] for d, a in first.items()) < 0.3 * 4000 and set(grown.values()) == set(range(5))
    # other rows: few slots move, and the written shards follow the same map
    more = docs.union(documents(spark, [(9000 + i, "z" * 900 + str(i % 40), None, None, 1) for i in range(300)]))
    sharding.write_shards(more, str(tmp_path / "out"), 5, 512, map_path=path)
    last = sharding.versions(spark, path)[-1]
    moved = sum(a[1] != b[1] for a, b in zip(sharding.stored_rows(spark, path, last - 1), sharding.stored_rows(spark, path, last)))
    assert last > 2 and moved < 100
    back = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard").collect()}
    placed = {r["doc_id"]: r["shard"] for r in sharding.assign(more, 5, 512, path).collect()}
    assert back.keys() == placed.keys() and sharding.versions(spark, path)[-1] == last
    hot = {d for d in back if d >= 9000}
    assert all(back[d] == placed[d] for d in back if d not in hot)
    with pytest.raises(ValueError):
        sharding.assign(docs, 4, 512, path)


def test_sharding_on_odd_rows(spark, tmp_path):
    docs = documents(spark, odd_rows()).withColumn("virtual_slot", F.lit("clash"))
    got = sharding.assign(docs, 2, 64).collect()
    check_sharding(got, 2)
    assert len(got) == len(odd_rows()) and [(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 1] == [(1, 0)]
    assert sharding.assign(empty(spark)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 2, 64)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, rows_of(back.select(docs.columns)))) == sorted(map(str, rows_of(docs)))
