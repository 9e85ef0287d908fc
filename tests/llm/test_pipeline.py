"""The stages on the smallest tables, each against brute force on its own input."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from tablescope.llm.common import numbered, stored
from tablescope.llm.queries import QUERIES
from tablescope.llm.simhash import fingerprint

from ..conftest import SF_DIR
from ..oracle import compare, duck
from .helpers import no_docs, odd_docs
from .test_mixing import targets
from .test_quality_rules import base
from .test_sharding import check


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF_DIR), "test")
        out[name] = docs.collect(), after.collect(), docs.columns, after.columns
        docs = after
    return out


def test_columns(stages):
    assert list(stages) == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
    for name, (_, _, before, after) in stages.items():
        assert after[:len(before)] == before and (name == "sharding" or after == before)


def test_quality_stage(stages):
    before, after, *_ = stages["quality rules"]
    kept = {r.doc_id for r in after}
    for r in before:
        b = base(r.text)
        if b[0] < 10 or 100 * b[4] > 20 * b[0]:
            assert r.doc_id not in kept
    assert len(kept) > 0.75 * len(before)


def test_dedup_stage(stages):
    before, after, *_ = stages["near-dedup"]
    left = [fingerprint(r.text) for r in after]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(left) for b in left[:i])
    for r in before:
        assert any((fingerprint(r.text) ^ b).bit_count() <= 4 for b in left) or r in after


def test_decontamination_stage(stages, spark):
    before, after, *_ = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    leaked = {r.doc_id for r in before if any(plain(i) in plain(r.text) for i in items)}
    assert leaked and {r.doc_id for r in before} - {r.doc_id for r in after} == leaked


def test_mixing_stage(stages):
    before, after, *_ = stages["mixing"]
    size, taken = {}, {}
    for rows, sums in ((before, size), (after, taken)):
        for r in rows:
            sums[r.source] = sums.get(r.source, 0) + len(r.text.split())
    for source, want in targets(size).items():
        assert abs(taken.get(source, 0) - want) <= max(300, 0.1 * want)
    copies = [r.doc_id for r in after]
    assert all(copies.count(d) <= 3 for d in set(copies))


def test_sharding_stage(stages):
    before, after, *_ = stages["sharding"]
    assert len(before) == len(after)
    check(after, 24)


def test_row_numbers_outlast_a_change_of_cores(spark, tmp_path):
    """Two plans over the same numbered rows agree when the files are split for another number of cores."""
    spark.range(4000).repartition(16).write.parquet(f"{tmp_path}/t")
    setting = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(setting, "64")
        rows, row = numbered(spark.read.parquet(f"{tmp_path}/t"))
        before = {r[row]: r.id for r in rows.collect()}
        spark.conf.set(setting, "1")
        after = {r[row]: r.id for r in rows.select(row, "id").collect()}
    finally:
        spark.conf.unset(setting)
    assert len(before) == 4000 and after == before


def test_odd_tables(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            after = stored(stage(spark, docs, SF_DIR), "odd")
            assert after.columns[:len(docs.columns)] == docs.columns
            docs = after


def test_registration(spark):
    queries = __spark_entry__.queries()
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in queries and set(QUERIES) <= set(queries)
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_warc_twin(spark):
    key = "op4_content_addressed_warc"
    assert compare(QUERIES[key](spark, SF_DIR), duck(SF_DIR), __spark_entry__.oracle_sql()[key]) is None
