"""Stages that drop rows tell them apart by more than their doc_id."""

from conftest import BENCH, DOCS, prose

from memlake.llm import decontam, packing, simhash


def test_clean_rows_stay(spark):
    item = " ".join(f"b{i}" for i in range(30))
    leak, clean = prose(40, 1) + " " + item, [prose(60, 10 + i) for i in range(4)]
    rows = [(None, leak), (None, clean[0]), (None, clean[1]), (1, leak), (1, clean[2]), (2, clean[3]), (3, None), (None, None), (4, leak)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = decontam.keep_clean(df, spark.createDataFrame([(7, item)], BENCH))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(repr(x) for x in rows if x[1] != leak)


def test_near_copies_by_row(spark):
    a, b, c, d, e = (prose(80, 30 + i, 3000) for i in range(5))
    rows = [(None, a), (None, b), (None, c), (5, c), (6, d), (6, e), (1, d), (9, e), (9, e), (9, b + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(repr((r["doc_id"], r["text"])) for r in simhash.keep_one(df).collect())
    assert got == sorted(map(repr, [(None, a), (5, c), (1, d), (6, e), (9, b + " end")]))


def test_packing_deals_by_row(spark, monkeypatch):
    """Pieces of no doc_id and of one doc_id are dealt like others: no task gets many more than its share."""
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 40)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    df = spark.createDataFrame([(None, 0, 0, 100 + i % 900, i) for i in range(3_000)] + [(7, 0, 0, 100 + i % 900, i) for i in range(600)], kind)
    items = df.selectExpr("monotonically_increasing_id() AS uid", "length AS fill").cache()
    tasks = packing._pack_round(items, 90, 1, 2048).selectExpr("shiftright(bin, 28) % 1048576 AS task").groupBy("task").count()
    assert tasks.agg({"count": "max"}).first()[0] <= 80
    got = packing.pack(df).collect()
    assert sorted(r["ids_crc32"] for r in got) == sorted([*range(3_000), *range(600)])
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        ends = [0]
        for o, n in sorted(parts):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 2048
    assert len(seqs) <= 1.03 * sum(r["length"] for r in got) / 2048 + 1


def test_packing_sends_few_rows_at_once(spark):
    """Tasks that make pieces run inside pack() and get at most ROWS rows at once; the setting is as before afterwards."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([0]), pa.array([b.num_rows]), pa.array([0])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    found = spark.range(5000).coalesce(1).mapInArrow(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = [r["length"] for r in packing.pack(found, 1_000_000).collect()]
    assert sum(got) == 5000 and max(got) <= packing.ROWS and spark.conf.get(key) == before
