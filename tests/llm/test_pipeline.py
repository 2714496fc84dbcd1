"""The corpus pipeline's stages, one by one, against plain Python on a small folder of tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from sieveline.llm import jaccard_join, quality_rules, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    common = quality_rules.COMMON_WORDS["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice("bcdefglmnr") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    clean = {i: sentence(rng, rng.randrange(60, 160)) for i in range(120)}
    toxic = {i: " ".join(x for w in sentence(rng, 80).split() for x in ([w, rng.choice(["stupid", "moron", "scum"])] if rng.random() < 0.15 else [w])) for i in range(200, 240)}
    copies = {300: clean[3], 301: clean[3] + " end", 302: clean[5]}
    junk = {400: "a b c", 401: "buy now " * 60, 402: "", 403: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (clean | toxic | copies | junk).items()]
    rows += [(7, clean[7], "en", "s", len(clean[7])), (None, sentence(rng, 90), None, None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in (clean | toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, clean, toxic


def test_stages_and_run(spark, folder):
    path, clean, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "near duplicates", "packing"]

    fine = stages["quality rules"](spark, docs, path)
    assert fine.columns == docs.columns
    fine = fine.collect()
    kept = {r["doc_id"] for r in quality_rules.judged(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in fine if r["doc_id"] is not None) == sorted([i for i in kept if i is not None] + [7])
    assert None in {r["doc_id"] for r in fine}
    assert not {400, 401, 402, 403} & kept
    assert clean.keys() <= kept

    mild = stages["toxicity"](spark, spark.createDataFrame(fine, COLUMNS), path)
    assert mild.columns == docs.columns
    mild = mild.collect()
    left = {r["doc_id"] for r in mild}
    assert len(toxic.keys() & left) <= 2
    assert len(clean.keys() - left) <= 2

    one = stages["near duplicates"](spark, spark.createDataFrame(mild, COLUMNS), path)
    assert one.columns == docs.columns
    one = one.collect()
    sets = {}
    for r in one:
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    ids = list(sets)
    assert len(ids) == len(one)
    assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i])
    assert sorted(left - set(ids)) == sorted(i for i in (300, 301, 302) if i in left)

    pieces = stages["packing"](spark, spark.createDataFrame(one, COLUMNS), path).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in whole) == sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in pieces)


def test_no_documents(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_texts_that_are_not_utf8(spark, folder, tmp_path):
    """Bytes cut inside a character, as writers that count bytes leave them: such rows pass each stage with all their bytes."""
    path, clean, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    raw = {600: clean[9].encode() + b" caf\xc3", 601: clean[10].encode() + b" \xff\xfe", 602: clean[10].encode() + b" \xff\xfd", 603: b"\xe2\x82 " * 3}
    broken = spark.createDataFrame([(i, bytearray(t)) for i, t in raw.items()], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text", "'en' lang", "'s' source", "60L n_chars")
    folder_of = str(tmp_path)
    docs.unionByName(broken).write.parquet(f"{folder_of}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    labels.unionByName(spark.createDataFrame([(600, 1, 0), (601, 1, 0)], labels.schema)).write.parquet(f"{folder_of}/labels.parquet")
    rows = spark.read.parquet(f"{folder_of}/documents.parquet")
    model = toxicity.fit(rows, spark.read.parquet(f"{folder_of}/labels.parquet"))
    assert toxicity.score(rows, model).where("doc_id between 600 and 603").count() == 4
    mild = toxicity.without_toxic(rows, model)
    assert {r["doc_id"]: bytes(r["t"]) for r in mild.where("doc_id between 600 and 603").selectExpr("doc_id", "cast(text as binary) t").collect()} == raw
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(rows).collect()}
    assert found[600][1] == 9  # a word more than 9
    assert found[601][1] == found[602][1] == 10
    exact = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked_components(rows, num=100, den=100).collect()}
    assert (exact[601], exact[602]) == (601, 602)  # they differ in a byte that is not UTF-8
    pieces = corpus_pipeline.run(spark, folder_of).collect()
    assert {9, 10} <= {r["doc_id"] for r in pieces}
    assert not {600, 601, 602} & {r["doc_id"] for r in pieces}
