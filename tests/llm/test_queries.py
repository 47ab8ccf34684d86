import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quernstone.llm import queries as Q
from tests.empty import SMALL, empty_tables

COLUMNS = {
    "p1_found": [("field", "string"), ("docid_a", "string"), ("docid_b", "string")],
    "p2_found": [("tbl", "string"), ("rec_id", "string"), ("found_lang", "string")],
    "p3_found": [("item_id", "bigint"), ("cut_kind", "string")],
    "p4_found": [("plan_id", "int"), ("lang", "string")],
    "p5_found": [("query_id_a", "bigint"), ("query_id_b", "bigint")],
    "p7_found": [("doc_id", "bigint")],
    "p8_found": [("mix_id", "int"), ("source", "string")],
    "p9_found": [("doc_id", "bigint"), ("kind", "string")],
}


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", Q.queries())
def test_empty_tables(spark, nothing, name):
    rows = Q.queries()[name](spark, nothing).collect()
    assert len(rows) == (1 if name == "p7_fill" else 0)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    df = Q.queries()[name](spark, SMALL)
    assert df.dtypes == COLUMNS[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("doc_embeds", "doc_encodes", "token_dataset", "vocab", "train", "sample_targets", "languages", "corpus_df", "sources", "documents", "mix_targets"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    names = sorted(want.columns)
    a = sorted(tuple(str(r[c]) for c in names) for r in Q.queries()[name](spark, SMALL).collect())
    b = sorted(tuple(str(x) for x in r) for r in want.project(", ".join(names)).fetchall())
    assert a == b


def test_segments_of_both_tables(spark):
    """Every record with a text has stretches that together hold its words, numbered from 1."""
    got = Q.queries()["p2_segments"](spark, SMALL).collect()
    for tbl, key, text in (("corpus_df", "docid", "text"), ("train", "query_id", "query")):
        rows = spark.read.parquet(f"{SMALL}/{tbl}.parquet").selectExpr(f"cast({key} as string) as rec_id", f"{text} as text").collect()
        words = {r["rec_id"]: r["text"].split() for r in rows if r["text"] and r["text"].split()}
        of = {}
        for r in sorted((r for r in got if r["tbl"] == tbl), key=lambda r: r["seg_no"]):
            of.setdefault(r["rec_id"], []).append(r)
        assert of.keys() == words.keys()
        for rec_id, stretches in of.items():
            assert [r["seg_no"] for r in stretches] == list(range(1, len(stretches) + 1))
            assert sum(r["n_chars"] for r in stretches) + len(stretches) - 1 == len(" ".join(words[rec_id]))
    assert any(r["seg_no"] > 1 for r in got if r["tbl"] == "train")


def planted_pairs(at, cosine, n=3000):
    """Tables of ``n`` random pairs of vectors with the given cosine."""
    for seed, (name, field) in enumerate((("doc_embeds", "embeds"), ("doc_encodes", "encode"))):
        r = np.random.default_rng(seed)
        a, b = r.standard_normal((2, n, 64))
        a /= np.sqrt((a * a).sum(1, keepdims=True))
        b -= (a * b).sum(1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.sqrt((b * b).sum(1, keepdims=True))
        x = np.concatenate((a, b)).astype(np.float32)
        pq.write_table(pa.table({"docid": [f"{i % n:05}{'ab'[i // n]}" for i in range(2 * n)], field: pa.array(list(x), pa.list_(pa.float32()))}), f"{at}/{name}.parquet")
    return str(at)


def test_near_pairs_at_the_limit_are_found(spark, tmp_path):
    got = Q.queries()["p1_found"](spark, planted_pairs(tmp_path, 0.901)).collect()
    assert all(r["docid_a"][:5] == r["docid_b"][:5] for r in got)
    assert len(got) >= 0.975 * 6000
