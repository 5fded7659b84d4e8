"""The pipeline's stages on the smallest tables: what each keeps, and that the last packs it whole."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.4 * len(ids)
        ids = left
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontam.contaminated(docs, bench).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p["doc_id"] for p in pieces} == ids


def test_run_packs_what_the_stages_keep(spark):
    a = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert a == {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} and len(a) > 50


def test_stages_take_odd_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"score": F.lit("s"), "component_id": F.lit(1), "drop": F.lit("d"), "th": F.lit(2), "words": F.lit(None).cast("string")})
    good = docs.where("length(text) > 300").limit(1).first()["text"]
    odd = [(None, good), (None, None), (10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, good + " but this one is its own"), (10_003, good), (10_004, good)]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    whole = docs.unionByName(extra, allowMissingColumns=True)
    for source in (whole, whole.limit(0)):
        rows = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, DATA).cache()
            assert rows.columns == whole.columns
        left = [r["doc_id"] for r in rows.collect()]
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect()
        assert {p["doc_id"] for p in pieces} == set(left)
        assert (None in left) == (source is whole)


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_of_the_given_texts_are_found(spark):
    """Of all pairs of resemblance 0.8 or more, 0.97 or more are in one group; members have a relative of 0.5 or more there."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    by = defaultdict(list)
    for i, s in texts.items():
        for x in s:
            by[x].append(i)
    shared = Counter((a, b) for ids in by.values() if len(ids) < 200 for n, a in enumerate(ids) for b in ids[n + 1 :])
    alike = {p: n / len(texts[p[0]] | texts[p[1]]) for p, n in shared.items()}
    pairs = [p for p, x in alike.items() if x >= 0.8]
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    found = sum(group[a] == group[b] for a, b in pairs)
    print(found, len(pairs))
    assert len(pairs) > 100 and found >= 0.97 * len(pairs)
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    for ids in members.values():
        if len(ids) > 1 and all(texts[i] for i in ids):
            assert all(any(alike.get((min(a, b), max(a, b)), alike.get((max(a, b), min(a, b)), 0)) >= 0.5 for b in ids if b != a) for a in ids)
