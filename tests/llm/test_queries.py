"""The queries of the subpackage and the pipeline over the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from agoralens.llm.checks import CHECKS
from agoralens.llm.queries import QUERIES
from agoralens.llm import hyperminhash
from agoralens.session import materialize


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries()) and set(CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, sf_dir, database, name):
    df = QUERIES[name](spark, sf_dir)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    result = database.execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    other = sorted(range(len(columns)), key=lambda i: columns[i])
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([r[i] for i in order]) for r in df.collect()) == sorted(
        str([r[i] for i in other]) for r in result.fetchall()
    )


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, sf_dir), "stage")
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in before.collect())
    left = hyperminhash.near_duplicates(docs.join(found.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    assert left.filter("not kept").count() == 0


def test_stages_of_awkward_tables(spark, sf_dir):
    schema = "doc_id long, text string, kept string, n_words string, n_chars long, items string, contaminated string, _doc string"
    rows = [(1, None, "k", "n", 0, "i", "c", "d"), (None, "", "k", "n", 0, "i", "c", "d"), (2, " \n", "k", "n", 3, None, None, None)]
    text = " ".join(f"the w{i} of" for i in range(40))
    rows += [(3, text, "k", "n", 1, "i", "c", "d"), (3, text, "k", "n", 1, "i", "c", "d"), (None, text, "k", "n", 1, "i", "c", "d")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert set(out.columns) >= set(schema.replace(",", "").split()[::2]), name
            out.collect()
