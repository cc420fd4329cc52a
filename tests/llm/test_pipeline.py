"""The stages of the pipeline on a small corpus whose right result is known."""

import random

import corpus_pipeline
import fixtures
from tallywatch.llm.packing import padding
from test_simhash import brute_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(folder, spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    texts = {i: " ".join(word() for _ in range(rng.randint(300, 420))).capitalize() + "." for i in range(60)}
    passage = " ".join(word() for _ in range(30))
    texts |= {100 + i: texts[i] + "  " for i in range(5)}                      # equal up to spaces; longer, so they stay
    texts |= {110 + i: texts[10 + i] + " " + word() for i in range(5)}         # near-copies
    texts |= {120 + i: f"{word()} {word()} {passage} {word()} {word()} {word()}" for i in range(3)}  # test items inside
    texts |= {200 + i: " ".join(f"{word().upper()}!!" for _ in range(80)) for i in range(40)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i >= 200 else 1, 0) for i in texts if i % 2 or i < 40]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage(spark, tmp_path):
    folder = str(tmp_path)
    corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, near = [], set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_dedup":  # by all pairs of fingerprints
            prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
            roots = fixtures.plain_components(prints, [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3])
            near = {i for i, root in roots.items() if i != root}
        kept = stage(spark, docs, folder)
        assert kept.columns == COLUMNS, name
        kept.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        gone.append({r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()})
        docs = kept
    assert gone == [set(range(200, 240)), set(range(5)), near, {120, 121, 122}]
    assert len(near) >= 3 and near <= set(range(110, 115))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()
    assert padding(pieces).first().sequences > 0
