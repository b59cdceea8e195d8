import pyspark
import pytest

import __spark_entry__ as driver
from chatloom.plans.oracle import oracle_queries, stop_words
from chatloom.plans.queries import REGISTRY
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
#: Trained and randomly started models; their tests hold them to invariants, or to exact results by recall.
NOT_IN_SQL = {
    "neighbor_descent", "spectral_layout", "spectral_sweep", "hashed_vectors", "pca_coords", "layout_sweep", "super_clusters", "topic_model", "unigram_vocab", "encode_unigram",
}


def test_every_query_has_its_sql(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(REGISTRY) - set(driver.oracle_sql()) == NOT_IN_SQL


def test_flagship_runs(spark):
    assert driver.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in NOT_IN_SQL])
def test_queries_match_sql(spark, name):
    assert compare(REGISTRY[name](spark, SMALL), connect(SMALL), oracle_queries()[name]) is None


def test_word_list_needs_no_jar_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark" / "__init__.py"))
    assert len(stop_words()) > 200 and {"the", "and", "les", "pour"} <= set(stop_words())
