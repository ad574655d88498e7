"""The pipeline against its stages applied one by one by plain rules."""

import duckdb

from corpusloom.llm import decontaminate, neardup, pieces, quality, secrets

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # quality, by the model on each text alone
    model = quality.fit_ratings(docs, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    made = quality.Features()
    import numpy as np

    score = np.array([float(np.sort(model.weights[made((t or "").encode())]).sum(dtype=np.float64)) for _, t in rows])
    rows = [r for r, tail in zip(rows, model.tails(score)[:, 1], strict=True) if tail >= quality.KEEP_FROM]
    kept = {d for d, _, _, k in neardup.brute_components(rows, 5, 80) if k}
    rows = [r for r in rows if r[0] in kept]
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    c.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    bad = {r[0] for r in c.sql(decontaminate.ORACLE_SQL).fetchall() if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    assert set(out) == {d for d, _ in rows}
    table = pieces.Encoder(*pieces.load_pieces())
    for d, t in rows:
        assert out[d].round_trip and table.decode(np.asarray(out[d].piece_ids, "<i4").tobytes()) == out[d].text
        if not secrets.base_spans(t) and "<SECRET>" not in out[d].text:
            assert out[d].text == t
        assert not secrets.base_spans(out[d].text) and out[d].n_chars == len(out[d].text)
