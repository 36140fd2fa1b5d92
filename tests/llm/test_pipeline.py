"""The pipeline's stages, each on what its predecessor kept."""

import random

import corpus_pipeline
from palimpsest.llm.common import table


def test_stages(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "an", "er", "ing", "on", "es"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(25)) for i in range(4)]
    rows = [(i, text(80)) for i in range(150)]
    toxic = set(range(0, 150, 6))
    rows = [(i, t + " vileword nastyword" * 2 if i in toxic else t) for i, t in rows]
    rows += [(200 + i, rows[1][1]) for i in range(20)] + [(300 + i, f"{text(30)} {bench[i][1]} {text(30)}") for i in range(4)] + [(400, None), (401, "")]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs = table(spark, str(tmp_path), "documents")
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert d.columns == docs.columns
        ids.append([x.doc_id for x in d.select("doc_id").collect()])
    scored = toxic
    assert set(ids[0]) == {i for i, _ in rows} - scored
    assert set(ids[1]) == set(ids[0]) - {200 + i for i in range(20)} - {401} and len(ids[1]) == len(set(ids[1]))
    assert set(ids[2]) == set(ids[1]) - {300, 301, 302, 303}
    assert set(ids[3]) <= set(ids[2])
    assert sorted(ids[4]) == sorted(ids[3])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x.doc_id for x in final.select("doc_id").collect()) == sorted(ids[4])
