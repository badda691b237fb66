import corpus_pipeline
from noticelake.llm import decontaminate, pii, queries, repetition, simhash
from noticelake.llm.words import folded


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]

    kept = stages[names[0]](spark, docs, sf)
    assert kept.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in repetition.verdicts(docs).collect()}
    good = [r for r in rows if verdict[r.doc_id]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in good)

    one = stages[names[1]](spark, kept, sf)
    groups = simhash.reachable([simhash.fingerprint(r.text.encode()) for r in good])
    least = sorted({min(good[i].doc_id for i in g) for g in groups})
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == least

    clean = stages[names[2]](spark, one, sf)
    items = [bytes(folded(r.text.encode())).split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: b" ".join(bytes(folded(r.text.encode())).split()) for r in one.collect()}
    dirty = {d for d, text in left.items() if any(b" ".join(i) in text for i in items)}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(left) - dirty

    private = stages[names[3]](spark, clean, sf)
    assert private.columns == docs.columns
    changed = {r.doc_id: r for r in private.collect()}
    for r in clean.collect():
        assert changed[r.doc_id].n_chars == len(changed[r.doc_id].text)
    assert len(changed) == clean.count()

    packed = stages[names[4]](spark, private, sf).collect()
    assert {r.doc_id for r in packed} == set(changed)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_stages_meet_awkward_rows(spark, sf, documents, nothing):
    for docs in (documents, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, sf)
            assert docs_out.columns == docs.columns and docs_out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_every_operator_has_a_query():
    numbers = [name.split("_")[0] for name in queries.QUERIES]
    assert numbers == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert decontaminate and pii
