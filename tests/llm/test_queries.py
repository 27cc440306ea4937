"""The registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from conftest import SF001
from newsweave.llm import decontam, mixing, neardup, packing, queries, toxicity
from newsweave.llm.common import table

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF001)
    want = con.sql(queries.ORACLE[name])
    assert sorted(out.columns) == sorted(want.columns)
    names = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in out.collect()), key=str)
    assert got == sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in names) for r in want.fetchall()), key=str)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, tmp_out):
    docs = table(spark, SF001, "documents")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, SF001).write.parquet(f"{tmp_out}/{name}")
        before, kept = kept, spark.read.parquet(f"{tmp_out}/{name}")
        ids = [r.doc_id for r in kept.select("doc_id").collect()] if "doc_id" in kept.columns else None
        if name == "toxicity":
            chain = toxicity.judged(before, table(spark, SF001, "labels"))
            assert sorted(ids) == sorted(r.doc_id for r in chain.where("NOT toxic").collect())
        elif name == "near_duplicates":
            assert sorted(ids) == sorted(r.doc_id for r in neardup.near_duplicates(before).where("kept").collect())
        elif name == "decontamination":
            assert sorted(ids) == sorted(r.doc_id for r in decontam.scan(before, table(spark, SF001, "benchmark")).where("NOT contaminated").collect())
        elif name == "mixing":
            assert sorted(ids) == sorted(x for r in mixing.mix(before).collect() for x in [r.doc_id] * r.copies)
        else:
            assert sum(r.n_tokens for r in kept.collect()) == sum(r.n_tokens for r in packing.pack(before).collect())
        assert name == "packing" or kept.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "packing"]


def test_first_stage_rejects_toxic_documents(spark, tmp_out):
    """At sf0.001 too few labels are there to reject anything; here they are."""
    rows = [(i, f"{'vile scum' if i % 4 == 0 else 'kind words'} of text number{i % 50}", "en", "s", 30) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_out}/labels.parquet")
    docs = table(spark, tmp_out, "documents")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, tmp_out)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]


@pytest.mark.parametrize("some", [False, True])
def test_run_on_odd_tables(spark, tmp_out, some):
    """Empty tables, nulls in every column, repeated rows and ids."""
    docs = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (1, "another text of this id", None, "a", None), (2, None, None, None, None),
            (3, "", "en", None, 0), (None, "nobody knows this id", "en", "b", 20), (4, "x" * 30000, "en", "b", 30000), (5, "a b c d e f g h i j k l", "en", "b", 23)]
    labels = [(1, 1, 0), (1, 0, None), (None, None, None), (9, 0, 1)]
    items = [(1, "a b c d e f g h i j"), (2, None), (None, "")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows if some else [], schema).write.parquet(f"{tmp_out}/{name}.parquet")
    out = packing.unpack(corpus_pipeline.run(spark, tmp_out)).collect()
    if not some:
        assert out == []
        return
    ids = {r.doc_id for r in out}
    assert ids <= {1, 4, None} and 5 not in ids and 2 not in ids  # contaminated, and without ids
    assert {1, None} & ids


def test_run_gives_packed_rows(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert "input_ids" in out.columns and out.count() > 0
