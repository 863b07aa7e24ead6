"""Every registered query against its SQL, and the ones without SQL for shape."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert differences(queries()[name](spark, FOLDER), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4


def test_import_takes_every_new_entry(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    said = turns.where("role = 'assistant' and text <> ''").selectExpr("conv_id", "turn - 1 as turn")
    asked = turns.where("role = 'user'").join(said, ["conv_id", "turn"]).select("text").distinct().count()
    # No document of these tables holds such a text, so all of them are new.
    assert queries()["tm_import"](spark, FOLDER).count() == asked > 0


def test_contents_labels_are_whole_lines(spark):
    lines = queries()["align_cascade"](spark, FOLDER).select("book_id").count()
    labels = queries()["toc_translate"](spark, FOLDER)
    assert labels.count() > lines
    assert labels.where("target_label not like 'Chapter %'").count() == lines


def test_link_match_searches_every_hundredth_link(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    asked = {r.doc_id for r in docs.where("doc_id % 100 = 0").collect()}
    got = queries()["link_match"](spark, FOLDER).collect()
    assert sorted(r.link_id for r in got) == sorted(asked)
