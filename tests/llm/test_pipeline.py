"""The pipeline, stage by stage, against what each stage promises."""

import pytest

import corpus_pipeline
from tabweave.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, out[-1][1], FOLDER).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_rows(stages):
    names = list(stages)
    assert [n for n, _ in corpus_pipeline.STAGES] == names[1:]
    for before, after in zip(names, names[1:-1]):
        assert stages[after].schema.simpleString() == stages["documents"].schema.simpleString()
        assert set(texts(stages[after])) <= set(texts(stages[before]))


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = texts(stages["documents"]), texts(stages["quality_classifier"])
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.95 * len(good)
    assert all(after[d] == before[d] for d in after)


def test_lines(stages):
    before, after = texts(stages["quality_classifier"]), texts(stages["line_dedup"])
    seen = [x.strip().lower() for t in after.values() for x in (t or "").split("\n") if x.strip()]
    assert len(seen) == len(set(seen))
    lines = lambda t: {x.strip().lower() for x in (t or "").split("\n")}
    assert all(lines(after[d]) <= lines(before[d]) for d in after)


def test_groups(stages):
    """No two kept documents are similar; whatever went was similar to another."""
    before, after = texts(stages["line_dedup"]), texts(stages["jaccard_join"])

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {d: grams(t) for d, t in before.items()}
    like = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = list(after)
    assert not any(like(a, b) for i, a in enumerate(kept) for b in kept[:i])
    assert all(any(like(d, e) for e in before if e != d) for d in before if d not in after)


def test_decontamination(spark, stages):
    from tabweave.llm import decontaminate
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    left = decontaminate.match_items(stages["jaccard_join"], items).where("size(spans) > 0").count()
    assert left > 0 or stages["jaccard_join"].count() == stages["decontamination"].count()
    clean = {r.doc_id for r in decontaminate.match_items(stages["jaccard_join"], items).where("size(spans) = 0").collect()}
    before, after = texts(stages["jaccard_join"]), texts(stages["decontamination"])
    assert all(after[d] == before[d] for d in clean)


def test_packing(stages):
    pieces = stages["packing"].collect()
    kept = texts(stages["decontamination"])
    assert {r.doc_id for r in pieces} == set(kept)
    for doc in kept:
        own = sorted((r for r in pieces if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in own) == own[0].doc_tokens
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
