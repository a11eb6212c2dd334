"""Registered text queries against their SQL, and the pipeline's stages on a small table."""

import os

import pytest

import corpus_pipeline
from mirrortab.llm.load import load_all

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    queries, sql = load_all()
    for name, text in sql.items():
        df = queries[name](spark, SF_DIR)
        rows = con.execute(text)
        columns = [d[0] for d in rows.description]
        assert sorted(columns) == sorted(df.columns)
        want = [tuple(r[columns.index(c)] for c in df.columns) for r in rows.fetchall()]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert done.count() == before and {"ids", "decoded", "n_tokens"} <= set(done.columns)


def test_pipeline_equals_its_stages_in_plain_steps(spark):
    """Near-duplicates, contamination and tokens of the result, checked one by one."""
    from mirrortab.llm import bpe, decontaminate, simhash

    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert not decontaminate.report(out, bench).where("contaminated").count()
    near = simhash.near_duplicates(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert max(r["count"] for r in near.join(out.select("doc_id"), "doc_id").groupBy("component_id").count().collect()) == 1
    model = bpe.Model(open(bpe.default_path(), encoding="utf-8").read())
    assert all(list(r.ids) == model.encode(r.text) and r.decoded == model.decode(r.ids) for r in rows)


def test_stages_on_odd_input(spark):
    """Null, empty, blank and very long texts, repeated rows, rows without an id, columns with clashing names."""
    prose = " ".join(f"word{i} follows another" for i in range(200))
    texts = [None, "", " ", prose, prose, "x " * 200_000, "mail me at a.person@example.com about this", "y" * 300_000]
    rows = [(i, t, None, 1, "s", True, 0.5) for i, t in enumerate(texts)] + [(3, prose, None, 1, "s", True, 0.5), (None, "no id", "en", 1, "s", True, 0.5)]
    kind = "doc_id bigint, text string, lang string, n_chars int, kept string, contamination boolean, score double"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, out = docs.count(), corpus_pipeline.stored(stage(spark, docs, SF_DIR), f"odd-{name}")
            assert out.columns == docs.columns and out.count() <= before
            docs = out
        done = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
        if before:
            assert sorted((r.doc_id is None, r.doc_id) for r in done if r.doc_id in (0, 3, 5, 6, 7, None)) and {3, 6} <= {r.doc_id for r in done}
            assert [r.doc_id for r in done].count(3) == 1 and 4 not in {r.doc_id for r in done}
            assert not any("a.person@" in (r.text or "") for r in done)
        else:
            assert done == []
