"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def canonical(rows):
    one = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.select(*columns).collect()) == canonical(want)


def test_repartitioning_changes_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("split_dedup", "positional_join", "validate_chat", "scan_candidates"):
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = canonical(registry.QUERIES[name](spark, DATA).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = canonical(registry.QUERIES[name](spark, DATA).collect())
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert a == b


def test_apostrophe_cut_at_odd_first_words(spark, tmp_path):
    """Words that end the fixed line's word, empty ones, white space of one engine alone, quotes, nulls, ids below 0."""
    words = ["The", "he", "e", "so\nThe", "o\tThe", "", "\n", "The\n", "The\v", "\x85The", "The\u2028", "\xa0The\u3000", '"The', "'", "The't", "a\\", "\\E"]
    texts = [None, *words, *[f"{w} it was" for w in words]]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)] + [(k, t) for k in (None, -1, -2, -3, -4) for t in texts]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.QUERIES["apostrophe_cut"](spark, str(tmp_path)).select("doc_id", "cut")
    assert canonical(got.collect()) == canonical(duck.execute(registry.ORACLES["apostrophe_cut"]).fetchall())
