import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusloom.llm import pii  # noqa: E402
from tests.llm.test_decontaminate import brute as contaminated  # noqa: E402
from tests.llm.test_jaccard_join import brute as components  # noqa: E402

DATA = "/root/testdata/sf0.01"


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, kept[-1], DATA).write.parquet(out)
        kept.append(spark.read.parquet(out))
    rows = [{r.doc_id: r for r in d.collect()} for d in kept[:-1]]
    assert all(d.columns == docs.columns for d in kept[:-1])

    good = [i for i, q in labels.items() if q == 1 and i in rows[0]]
    bad = [i for i, q in labels.items() if q == 0 and i in rows[0]]
    assert sum(i in rows[1] for i in good) > 0.98 * len(good) and sum(i in rows[1] for i in bad) < 0.1 * len(bad)

    want = {c for _, _, c in components([(i, r.text) for i, r in rows[1].items()], size=5, num=4, den=5)}
    assert set(rows[2]) == want

    leaked = {i for i, _, _, _ in contaminated([(i, r.text) for i, r in rows[2].items()], items)}
    assert set(rows[3]) == set(rows[2]) - leaked

    find = pii.finder()
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not find(r.text) and r.n_chars == len(r.text)
        if not find(rows[3][i].text):
            assert r.text == rows[3][i].text
    assert any(re.search("<(EMAIL|IP|CARD|PHONE)>", r.text) for r in rows[4].values())

    pieces = kept[-1].toPandas()
    assert set(pieces.doc_id) == set(rows[4]) and pieces.groupby("sequence_id").length.sum().max() <= 4096


def test_odd_rows(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30)), "en", "s", 9, "x") for i in range(40)]
    rows += [(50, None, None, None, None, None), (51, "", "en", "s", 0, "y"), (3, rows[3][1], "en", "s", 9, "x"), (52, "a@b.co " * 9000, "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns, n = table.columns, table.count()
            out = str(tmp_path / f"{name}{n}")
            stage(spark, table, DATA).write.parquet(out)
            table = spark.read.parquet(out)
            assert name == "best_fit_packing" or table.columns == columns
        assert n == 0 or {50, 51, 52} <= {r.doc_id for r in table.collect()}


def test_long_texts_without_an_id(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(60))
    table = spark.createDataFrame([(i if i < 20 else None, text(), "en", "s", 9) for i in range(24)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, table, DATA).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in table.collect()} == set(range(20))
