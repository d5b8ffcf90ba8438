import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retries


def flaky(folder, failures):
    """A model that notes what it is asked and fails the first ``failures[prompt]`` times."""

    def predict(prompts):
        if len(prompts) > 1:
            raise RuntimeError("one by one")
        (p,) = prompts
        seen = sum(f.startswith(f"{p or 'empty'}-") for f in os.listdir(folder))
        open(f"{folder}/{p or 'empty'}-{seen}", "w").close()
        if seen < failures.get(p, 0):
            raise RuntimeError(f"busy {seen}")
        return [f"re {p}"]

    return predict


def counts(folder):
    names = [f.rsplit("-", 1)[0] for f in os.listdir(folder)]
    return {n: names.count(n) for n in names}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "seen").mkdir()
    return str(tmp_path / "seen")


def test_failed_rows_come_back(spark, tmp_path, folder):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, None), (None, "e")], "id int, p string")
    path = str(tmp_path / "answers")
    # asking two at once fails and is asked again one by one, which is no try of its own
    run = lambda: retries.answered(df, ["id"], "p", flaky(folder, {"b": 2, "c": 9}), path, tries=3, shares=2, at_once=2)
    rows = sorted(map(tuple, run().collect()), key=repr)
    want = [(1, "a", 1, "re a", None), (2, "b", 3, "re b", None), (3, "c", 3, None, "request failed: busy 2"), (3, "c", 3, None, "request failed: busy 2"), (4, None, 1, "re ", None), (None, "e", 1, "re e", None)]
    seen = counts(folder)
    assert {k: v for k, v in seen.items() if k in "abce"} == {"a": 1, "b": 3, "c": 3, "e": 1} and seen["empty"] == 1
    assert rows == sorted(want, key=repr)
    assert sorted(map(tuple, run().collect()), key=repr) == sorted(want, key=repr) and counts(folder) == seen  # nothing is asked again
    more = retries.answered(df, ["id"], "p", flaky(folder, {}), path, tries=4).where("id = 3").collect()
    assert [tuple(r) for r in more] == [(3, "c", 4, "re c", None)] * 2
    lines = retries.answers(spark, path)
    assert lines.count() == lines.select("request", "try").distinct().count() == 10


def test_a_run_that_dies(spark, tmp_path, folder):
    df, path = spark.range(40).select("id", F.concat(F.lit("q"), "id").alias("p")), str(tmp_path / "answers")
    good = flaky(folder, {})

    def dies(prompts):
        if "q17" in prompts:
            os._exit(1)  # the worker is gone, and with it the task and the job
        return good(prompts)

    with pytest.raises(Exception):
        retries.answered(df, ["id"], "p", dies, path, shares=4, at_once=2)
    kept = {r.request for r in retries.answers(spark, path).collect()}
    rows = retries.answered(df, ["id"], "p", good, path, shares=4, at_once=2).collect()
    assert sorted((r.id, r.tries, r.reply, r.error) for r in rows) == [(k, 1, f"re q{k}", None) for k in range(40)]
    lines = retries.answers(spark, path)
    assert lines.count() == 40 and kept <= {r.request for r in lines.collect()}
    assert not [f for f in os.listdir(path) if f.startswith("_staged")]


def test_no_candidates(spark, tmp_path):
    none = spark.createDataFrame([], "id int, p string")
    assert retries.answered(none, ["id"], "p", lambda _: 1 / 0, str(tmp_path / "x")).count() == 0
