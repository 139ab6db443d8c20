"""The corpus pipeline on planted rows, stage by stage, and its registration."""

import random

import corpus_pipeline
from veridata.llm import queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(800)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = text(60), text(40)
    rows, labels = [], []
    for d in range(320):
        body = text(120)
        if d % 8 == 1:
            body += " zworm" + rng.choice("abc") + " " + text(5)
        if d % 8 == 2:
            body += "\n" + passage
        if d % 16 == 3:
            body = text(40) + " " + item + " " + text(40)
        rows.append((d, body, "en", f"s{d % 23}", len(body)))
        if d < 240:
            labels.append((d, 1, int(d % 8 == 1)))
    twin = rows[4][1]
    rows += [(1000 + i, twin if i % 2 else twin + " end", "en", f"s{i}", 0) for i in range(6)]
    return rows, labels, passage, item


def test_planted_rows_are_caught_and_clean_ones_stay(spark, tmp_path):
    rows, labels, passage, item = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r[0] for r in rows}]
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
        if name == "line_dedup":
            assert docs.where(docs["text"].contains(passage)).count() == 1
            assert docs.where("length(text) <> n_chars AND doc_id < 1000").count() == 0
    toxic = {d for d in range(320) if d % 8 == 1}
    assert ids[0] - ids[1] == toxic and ids[1] == ids[2]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.read.parquet(f"{sf}/line_dedup")).collect()}
    assert ids[3] == {d for d in ids[2] if groups[d] == d} and not any(d >= 1001 for d in ids[3])
    assert ids[3] - ids[4] == {d for d in range(320) if d % 16 == 3}
    assert ids[5] == ids[4]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    assert set(queries.ORACLE) <= set(queries.QUERIES) and "pipeline" in queries.QUERIES
