"""The pipeline against plain versions of its stages, over awkward rows with extra columns and over no rows."""

from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, duck
from frostline.llm.queries import ORACLE, QUERIES

from .docs import awkward, frame, sentence
from .test_operators import PLANTED, plain_groups, plain_hits, plain_quality, plain_secrets


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import random

    folder, r = tmp_path_factory.mktemp("corpus"), random.Random(8)
    rows = awkward(3) + [(20_000 + i, f"{sentence(r, 40)} {t}", "en", "a", None) for i, t in enumerate(PLANTED)]
    items = [(i, " ".join(row[1].split()[2:20])) for i, row in enumerate(rows[:12]) if row[1]] + [(99, None)]
    frame(spark, rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages(spark, sf):
    folder, rows, items = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, Counter(r[1] for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        after = Counter(tuple(r) for r in docs.select("doc_id", "text").collect())
        if name == "quality_rules":  # no host of these rows is bad enough to be rejected
            measured = {t: plain_quality(t) for t in texts}
            good = lambda t: measured[t][0] >= 10 and 100 * measured[t][-1] <= 20 * measured[t][0]
            assert after == Counter(b for b in before if good(b[1]))
        elif name == "near_dedup":
            groups = plain_groups(before)
            least = {g: d for (d, _), g in groups.items() if d == g}
            assert {d for d, _ in after if d is not None} == set(least)
            assert max(Counter(d for d, _ in after.elements() if d is not None).values()) == 1
        elif name == "decontaminate":
            assert after == Counter(b for b in before if not plain_hits(b[1], items)[-1])
        else:
            assert sum(after.values()) == len(before)
            assert all(plain_secrets(t)[-1] == "" for _, t in after)
            assert Counter(b for b in before if not plain_secrets(b[1])[-1]) <= after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert Counter(r.doc_id for r in packed.collect() if r.start == 0) == Counter(d for d, _ in after.elements())
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_no_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf[0]}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and len(QUERIES) == 13
    assert set(ORACLE) <= set(oracle_sql()) and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf_dir, name):
    ok, note = compare(spark, duck(sf_dir), name, sf_dir)
    assert ok, note
