"""The pipeline stage by stage against plain versions, and the queries against their SQL."""

import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as cp
from souklens.functions.storage import materialise
from souklens.llm import bpe, pii, queries
from souklens.llm import textbytes as tb

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    planted = [(10**6, "123 456 !!! ---", "en", "x", 0), (10**6 + 1, None, "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    (_, identify), (_, dedup), (_, clean), (_, redact), (_, encode) = cp.STAGES

    kept = materialise(identify(spark, docs, ROOT))
    assert kept.columns == COLUMNS and set(texts(docs)) - set(texts(kept)) == {10**6, 10**6 + 1}

    unique = materialise(dedup(spark, kept, ROOT))
    want = brute.components(list(texts(kept).items()), cp.SIMILARITY)
    assert unique.columns == COLUMNS and set(texts(unique)) == {i for i, (_, c) in want.items() if c == i}

    cleaned = materialise(clean(spark, unique, ROOT))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    before, after = texts(unique), texts(cleaned)
    hits = {i: hit for i, _, hit, _ in brute.leaks(list(before.items()), items)}
    assert any(hits.values())
    for i, text in before.items():
        left = [w for k, w in enumerate(brute.words(text)) if k not in hits[i]]
        assert brute.words(after.get(i, "")) == left and (hits[i] or after[i] == text)
    assert not any(hit for _, _, hit, _ in brute.leaks(list(after.items()), items))

    private = materialise(redact(spark, cleaned, ROOT))
    found = {r["doc_id"]: r["spans"] for r in pii.find(cleaned).collect()}
    for i, text in texts(private).items():
        assert not brute.personal(text)
        if not found[i]:
            assert text == after[i]
    assert private.columns == COLUMNS and private.filter(F.col("n_chars") != F.length("text")).count() == 0

    last = encode(spark, private, ROOT).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: brute.sha(t) for i, t in texts(private).items()} and all(r["same"] for r in last)


def test_run(spark):
    got = cp.run(spark, ROOT)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() <= 200


def test_awkward_rows(spark, edge, none):
    """Extra columns that are named like the operators' own come through; nothing crashes."""
    for docs in (edge, none.withColumn("k0", F.lit(1))):
        out = docs
        for _, stage in cp.STAGES[:-1]:
            out = materialise(stage(spark, out, ROOT))
            assert out.columns == docs.columns
        assert cp.STAGES[-1][1](spark, out, ROOT).count() == out.count()
    kept = cp.drop_near_duplicates(spark, edge, ROOT)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    once = cp.drop_near_duplicates(spark, edge.filter("doc_id = 9"), ROOT)
    assert once.count() == 1


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = queries.QUERIES[name](spark, ROOT).toArrow()
    want = con.sql(queries.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in names])))
    assert rows(got) == rows(want)


def test_texts_travel_once_to_be_cleaned(spark):
    """No second copy of a text stands beside the one that is searched; nulls stay."""
    from souklens.llm import fmindex

    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, None), (3, "plain"), (4, "")], "doc_id long, text string")
    out = fmindex.remove(docs, spark.createDataFrame([("i", words)], "item_id string, text string"))
    assert {r["doc_id"]: (r["text"], r["n_hit"]) for r in out.collect()} == {1: ("before \n after", 12), 2: (None, 0), 3: ("plain", 0), 4: ("", 0)}
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().apply(0)
    sent = node.children().apply(0).schema()
    assert [f.dataType().simpleString() for f in sent.fields()].count("string") == 1


def test_tokenizer_tables_reach_the_workers_built():
    with open(queries.tokenizer_file(), "rb") as f:
        built = bpe.Bpe(f.read())
    block = next(tb.blocks(pa.array(["One two two, <|endoftext|>'ll 日本 🙂", None, "", "  \n x1"])))
    want = [x.tolist() for x in built.encode(block)]
    data = built.packed()
    tracemalloc.start()
    try:
        own = bpe.worker_bpe((b"key", data))
        assert tracemalloc.get_traced_memory()[1] < 30e6  # 67 MB are needed to build them
    finally:
        tracemalloc.stop()
    assert not own._known and own is bpe.worker_bpe((b"key", data))
    assert [x.tolist() for x in own.encode(block)] == want
    tb.give_back("another")
    assert bpe.worker_bpe((b"key", data)) is not own


def test_round_trip_takes_small_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word %d é " % i * 30 if i % 7 else None) for i in range(200)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, bpe.round_trip(docs, queries.tokenizer_file()).collect()))
    want = rows()
    assert len(want) == 200 and all(r[-1] for r in want)
    assert bpe.ROUND_TRIP_BYTES < tb.BLOCK_BYTES
    monkeypatch.setattr(bpe, "ROUND_TRIP_BYTES", 100)
    assert rows() == want
