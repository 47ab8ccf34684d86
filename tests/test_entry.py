import pytest

import __spark_entry__
from quernstone.plans import retrieval
from tests.empty import empty_tables


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["chunk_documents", "bm25_saved_index", "fused_top_k", "bm25_grid", "passage_search", "split_ceil", "upsample_balance", "dense_saved_index", "nll_loss", "train_encoders"])
def test_empty_tables(spark, nothing, name):
    assert len(retrieval.queries()[name](spark, nothing).collect()) in (0, 2)  # train_encoders has a row an epoch
