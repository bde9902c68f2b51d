"""The pipeline's stages, each against its operator on its own input, and the whole run."""

import corpus_pipeline
from conftest import HARD, prose

from memlake.shared import stash


def test_stages(spark, make):
    item = " ".join(f"b{i}" for i in range(30))
    key = "Zk3Qp9xLm2Vt7Rb4Wd8Yc1Nf6"
    rows = [(100 + i, prose(90, 50 + i, 3000), "en", "ok", 1) for i in range(20)]
    rows += [(200, prose(60, 90, 3000) + " " + item, "en", "ok", 1), (201, rows[3][1], "en", "ok", 1), (202, f"{prose(80, 91, 3000)} {key} end", "en", "ok", 1), (203, "too short", "en", "ok", 1)]
    d = make(documents=rows + HARD, benchmark=[(1, item), (2, None)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, d), name)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == cols
    ids = lambda n: {r["doc_id"] for r in kept[n]}
    assert {100 + i for i in range(20)} | {200, 201, 202} <= ids("quality_rules") and not {1, 2, 3, 203, 6, 8, 10} & ids("quality_rules")
    assert 201 not in ids("near_duplicates") and {100 + i for i in range(20)} | {200, 202, 4} <= ids("near_duplicates") and 5 not in ids("near_duplicates")
    assert ids("near_duplicates") - ids("decontamination") == {200}
    text = {r["doc_id"]: r["text"] for r in kept["secret_scan"]}
    assert ids("secret_scan") == ids("decontamination") and key not in text[202] and "[SECRET]" in text[202] and text[100] == rows[0][1]
    assert ids("best_fit_packing") == ids("secret_scan")
    run = corpus_pipeline.run(spark, d)
    keys = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert keys(run.collect()) == keys(kept["best_fit_packing"])


def test_empty(spark, make):
    assert corpus_pipeline.run(spark, make()).count() == 0
