"""The stages in a row, on a small table with planted cases."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, passage = prose(20), prose(80)
    rows = []
    for i in range(240):
        text = prose(60)
        if i % 8 == 0:
            text += " clotx scab " + prose(5)
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, rows[1][1], "en", "s", 1), (301, rows[1][1] + " more", "en", "s", 1), (302, prose(50) + " " + item, "en", "s", 1)]
    rows += [(303, prose(40) + " " + passage, "en", "s", 1), (304, prose(70) + " " + passage, "en", "s", 1), (305, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 == 0), 1) for i in range(240)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert set(kept["toxicity"]) == everyone - set(range(0, 240, 8))
    assert set(kept["near_copies"]) == set(kept["toxicity"]) - {300, 301}
    assert set(kept["repeated_passages"]) == set(kept["near_copies"])
    assert passage in kept["repeated_passages"][303] and passage not in kept["repeated_passages"][304]
    assert set(kept["decontamination"]) == set(kept["repeated_passages"]) - {302}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])
