"""The stages take effect on one another's results, and clean documents stay."""

import random

import corpus_pipeline
from bipartrix.llm import decontam


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    lex = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(lex, k=n)) + "."
    bad = ["vilkor", "gorpas", "zubent"]
    rows, labels = [], []
    for i in range(300):
        t = prose(80)
        if i % 5 == 0:
            w = t.split()
            for _ in range(8):
                w[rng.randrange(80)] = rng.choice(bad)
            t = " ".join(w)
        rows.append((i, t, "en", "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    item, passage = prose(30), prose(70)
    near = rows[1][1].split()
    near[40] = "changed"
    rows += [(1000, rows[1][1], "en", "s"), (1001, " ".join(near), "en", "s"), (1002, prose(50) + " " + item + " " + prose(50), "en", "s"), (1003, prose(60) + " " + passage + " " + prose(60), "en", "s"), (1004, prose(60) + " " + passage + " " + prose(60), "en", "s"), (1005, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i in range(300) if i % 5}
    assert clean | {1000, 1001, 1002, 1003, 1004, 1005} <= set(seen[0]) and len(set(seen[0]) & set(range(0, 300, 5))) <= 3
    assert clean | {1002, 1003, 1004} <= set(seen[1]) and not {1000, 1001} & set(seen[1])
    assert passage in seen[2][1003] and passage not in seen[2][1004] and seen[2][7] == seen[1][7]
    assert 1002 not in seen[3] and clean | {1003, 1004} <= set(seen[3])
    assert decontam.words_of(item)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(seen[3])
