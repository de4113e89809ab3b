import re
from collections import Counter

import pytest
from llm_cases import documents, empty, rows

import corpus_pipeline
from tidewash.llm import decontaminate, quality, simhash
from tidewash.llm.registry import table

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_in_order():
    assert list(STAGES) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's result, each written and read as the next one's documents."""
    folder = tmp_path_factory.mktemp("pipeline")
    found = {"documents": table(spark, FOLDER, "documents")}
    docs = found["documents"]
    for name, stage in STAGES.items():
        stage(spark, docs, FOLDER).write.parquet(str(folder / name))
        docs = found[name] = spark.read.parquet(str(folder / name))
    return found


def test_all_but_the_last_return_documents(results):
    for name in list(STAGES)[:-1]:
        assert results[name].schema == results["documents"].schema


def test_quality_rejects_by_the_tail_probability(spark, results):
    docs = results["documents"]
    model = quality.fit_quality(docs, quality.graded_labels(table(spark, FOLDER, "labels")))
    scored = quality.score_quality(docs, model).collect()
    kept = Counter(r.doc_id for r in scored if r.tails[0] >= 0.5)
    assert Counter(r.doc_id for r in results["quality"].collect()) == kept
    labels = table(spark, FOLDER, "labels").where("quality = 1 AND toxic = 0")
    good = {r.doc_id for r in labels.collect()}
    assert good <= set(kept)


def test_one_of_equal_texts_stays(results):
    smallest = {}
    for r in results["quality"].collect():
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        smallest[text] = min(r.doc_id, smallest.get(text, r.doc_id))
    got = Counter(r.doc_id for r in results["exact_dedup"].collect())
    assert got == Counter(smallest.values())


def test_one_of_near_texts_stays(results):
    named = simhash.near_duplicates(results["exact_dedup"]).collect()
    got = Counter(r.doc_id for r in results["near_dedup"].collect())
    assert got == Counter({r.component_id for r in named})


def test_clean_documents_stay(spark, results):
    hits = decontaminate.benchmark_hits(results["near_dedup"], table(spark, FOLDER, "benchmark"))
    clean = Counter(r.doc_id for r in hits.collect() if not r.contaminated)
    assert Counter(r.doc_id for r in results["decontaminate"].collect()) == clean


def test_every_kept_document_is_packed_without_gaps(results):
    packed = results["pack"].collect()
    kept = {r.doc_id for r in results["decontaminate"].collect()}
    assert {r.doc_id for r in packed} == kept
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_is_the_stages(spark, results):
    found = Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert found == Counter(tuple(r) for r in results["pack"].collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_and_empty_tables(spark, name):
    docs = documents(spark)
    found = STAGES[name](spark, docs, FOLDER)
    if name != "pack":
        assert found.schema.names == docs.schema.names
        given = {(r[0], r[1]) for r in rows()}
        assert {(r[0], r[1]) for r in found.collect()} <= given
    else:
        assert found.select("doc_id").distinct().count() == len({r[0] for r in rows()})
    assert STAGES[name](spark, empty(spark), FOLDER).count() == 0
