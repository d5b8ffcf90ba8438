"""Gates, the predictor boundary, and operators without a query of their own."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import contract, text
from corpusloom.operators import arena, cost, extract, gates, leakage, review, rows, split, tensors, validate
from corpusloom.sources import readers, writers


def test_leak_gate_fails_closed(spark):
    rows_ = [("a", "screens/Cal_S1.png", None, b"one", "x"), ("b", "s/ok.png", "made of CAL_s1", b"two", "x"), ("c", "s/c.png", "", b"three", "me@x.org"), ("d", "s/d.png", "", b"four", "y")]
    df = spark.createDataFrame(rows_, "id string, image string, planted_from string, content binary, notes string")
    known = spark.createDataFrame([("train/z.png", b"four"), ("train/q.png", b"four"), ("train/b.png", b"nope")], "path string, content binary")
    found = gates.problems(df, ["Cal_S1"], known=known, text_fields=["notes"])
    assert {(r.id, r.rule, r.detail) for r in found.collect()} == {
        ("a", "name", "screens/Cal_S1.png"), ("b", "substrate", "made of CAL_s1"), ("c", "personal", "notes"), ("d", "content", "train/q.png"),
    }
    with pytest.raises(leakage.GateError, match="d: content train/q.png"):
        gates.enforce(found)
    with pytest.warns(UserWarning, match="not compared"):
        rest = gates.problems(df, ["Cal_S1"])
    assert {r.rule for r in rest.collect()} == {"name", "substrate"}
    gates.enforce(gates.problems(df.where("id = 'd'"), ["Cal_S1"], known=known.where("path LIKE '%b.png'")))
    with pytest.raises(leakage.GateError, match="q.png"):
        gates.admitted(df, known)
    assert gates.admitted(df, known.limit(0)).count() == 4


def test_runs_and_drift(spark):
    runs = spark.createDataFrame([("a", True), ("b", None)], "run string, complete boolean")
    assert cost.complete_runs(runs.where("complete")).count() == 1
    with pytest.raises(leakage.GateError, match="unfinished"):
        cost.complete_runs(runs)
    df = spark.createDataFrame([("M1", "x:1"), ("M1", "y:2"), ("C", "z:3")], "mode string, place string")
    cost.assert_counts(df, "mode", {"M1": 2, "C": 1}, ("place", ["x:1"]))
    with pytest.raises(leakage.GateError, match="drifted"):
        cost.assert_counts(df, "mode", {"M1": 3})
    with pytest.raises(leakage.GateError, match="anchors"):
        cost.assert_counts(df, "mode", {"M1": 2}, ("place", ["x:9"]))
    rates = cost.rates(df, [], F.col("mode") == "M1", F.lit(900)).first()
    assert rates.scaled_share == 600 and rates.scaled_low < 600 < rates.scaled_high


def test_predictors(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(["hi", "fail", "prose", "code", None])], "id int, p string").repartition(2)

    def model(prompts):
        if "fail" in prompts:
            raise ValueError("down")
        return [{"prose": "no json", "code": '{"rewrite": "<b>x</b>"}'}.get(p) or json.dumps({"rewrite": p.upper(), "reason": "r"}) for p in prompts]

    got = {r.id: (r.suggested_copy, r.reason, r.risk) for r in review.review(df, "p", model, batch=2).collect()}
    assert got == {
        0: ("HI", "r", ""), 1: ("", "request failed: down", "endpoint_error"), 2: ("", "no json", review.NOT_JSON), 3: ("<b>x</b>", "", "contract_escape"), 4: ("", "r", ""),
    }
    assert {r.suggested_copy for r in review.review(df, "p").collect()} == {""}
    kept = review.predictions(review.asked(df, review.identity, "p")).collect()
    assert {r.rewrite for r in kept} == {"hi", "fail", "prose", "code", ""}
    read = spark.createDataFrame([('{"rewrite": "a"}',), ('{"rewrite": "a"} x',), (None,)], "reply string").select(review.replied(F.col("reply")).alias("r")).select("r.*").collect()
    assert [(r.rewrite, r.reason, r.risk) for r in read] == [("a", None, None), ("", '{"rewrite": "a"} x', review.NOT_JSON), ("", "", review.NOT_JSON)]


def test_rows_of_both_modalities(spark):
    schema = "id int, messages array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>, modality string, task string, image string, provenance struct<source_policy_ids:array<string>,license:string,url:string>"
    good = json.dumps({"rewrite": "r", "reason": "r"})
    issues = json.dumps({"inventory": ["a"], "issues": []})
    copied = " ".join(f"word{chr(97 + k)}" for k in range(16))
    chat = lambda user, answer, parts=None: [("system", "s", None), ("user", user, parts), ("assistant", answer, None)]
    both = [("image", None), ("text", "t")]
    data = [
        (1, chat("u", good), None, None, None, (["p"], None, None)), (2, chat("u", json.dumps({"rewrite": f"So {copied}.", "reason": "r"})), "text", None, None, (["p"], None, None)),
        (3, chat(None, issues, both), None, None, "i.png", (None, "mit", None)), (4, chat(None, good, both), "vision", None, None, ([], "", "")),
        (5, chat("u", issues), "text", None, None, None), (6, None, None, None, None, None), (7, chat("u" * 900, good), None, None, None, (["p"], None, None)),
    ]
    sources = spark.createDataFrame([(f"x y {copied} z",)], "text string")
    got = {r.id: r.errors for r in validate.row_errors(spark.createDataFrame(data, schema), 100, sources).collect()}
    assert got == {1: [], 2: ["copy"], 3: [], 4: ["image", "contract:inventory", "provenance"], 5: ["contract:rewrite missing", "provenance"], 6: ["messages"], 7: ["tokens"]}


def test_types_of_outputs(spark):
    issue = lambda t: {"type": t, "strings": ["a"], "problem": "p", "fix": "f"}
    out = json.dumps({"issues": [issue("Tone, casing"), issue("casing")]})
    df = spark.createDataFrame([(out,), (out + " x",), (None,), ("{'issues': []}",)], "c string")
    assert [r.t for r in df.select(contract.raw_types(F.col("c")).alias("t")).collect()] == [["casing", "tone"], [], [], []]
    assert [r.e for r in df.select(contract.filtered_output(F.col("c")).parse_error.alias("e")).collect()] == [False, True, True, True]
    assert [contract.has_rewrite(t) for t in ('{"rewrite": ""}', "<think>{</think> {}", 'x {"rewrite": "a"} y', None, '{"rewrite": 1}')] == [True, False, True, False, False]
    ok = spark.createDataFrame([(json.dumps({"inventory": [], "issues": [issue("t")]}),), ("[]",)], "c string")
    assert [r.e for r in ok.select(contract.issues_contract(F.col("c")).alias("e")).collect()] == ["", "not an object"]
    assert [r.k for r in spark.createDataFrame([('{"id": 1}',), ("nope",)], "c string").select(validate.missing_keys(F.col("c"), ["id", "url"]).alias("k")).collect()] == [["missing:url"], ["missing:id", "missing:url"]]


def test_ranks_and_firsts(spark):
    names = spark.createDataFrame([(n,) for n in ("b.png", "a.png", "é.png", "Z.png")], "name string").repartition(3)
    ranked = {r["name"]: r.r for r in split.ranked(names, "name", "r").collect()}
    assert ranked == {n: k + 1 for k, n in enumerate(sorted(ranked))}
    skewed = spark.range(500).select(F.when(F.col("id") < 499, F.col("id")).otherwise(10**12).alias("v")).repartition(7)
    assert [r.r for r in split.ranked(skewed, "v", "r", buckets=8).orderBy("v").collect()] == list(range(1, 501))
    df = spark.createDataFrame([("x", 1, "p"), ("y", 1, "q"), ("y", 2, "r"), ("y", 1, "q"), (None, 3, "s")], "k string, o int, v string")
    assert sorted((r.k or "", r.o, r.v) for r in split.first_by(df, [F.col("k")], "o").collect()) == [("", 3, "s"), ("x", 1, "p"), ("y", 1, "q")]
    a, b = names.withColumnRenamed("name", "p"), names.withColumnRenamed("name", "q")
    assert split.by_position(a, "p", b, "q", agree=("p", "q")).count() == 4
    with pytest.raises(leakage.GateError):
        split.by_position(a, "p", b.where("q <> 'a.png'"), "q", agree=("p", "q"))
    totals = cost.running_totals(spark.range(1000).repartition(5), "id", ["id"]).orderBy("id").collect()
    assert [r.total_id for r in totals] == [k * (k + 1) // 2 for k in range(1000)]
    assert {r.s for r in spark.range(2000).select(split.hash_split(F.col("id"), 0.25, "s").alias("s")).collect()} == {"test", "train"}
    assert 400 < spark.range(2000).where(split.hash_split(F.col("id"), 0.25, "s") == "test").count() < 600
    assert sorted(r.o for r in split.capped(df, ["k"], "o", 1).collect()) == [1, 1, 3]


def test_orders_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, ids in (("b", "cd"), ("a", "ab")):
        (tmp_path / f"in/{name}.jsonl").write_text("".join(f'{{"id": "{i}"}}\n\n' for i in ids))
    assert [r.id for r in readers.jsonl_head(spark, str(tmp_path / "in"), "id string", 3).collect()] == ["a", "b", "c"]
    (tmp_path / "in/b.jsonl").write_text('{"id": "c"}\n\n\n{"id": \n{"id": "d"}\n')
    with pytest.raises(readers.BadLine, match=r"b\.jsonl:4: "):
        readers.jsonl(spark, str(tmp_path / "in"), "id string")
    root = tmp_path / "tree"
    for name in ("tree/x.js", "x.js", "build/y.js", "a/node_modules/b/z.ts", "q.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("<p>Please try it again</p><p>Then do it once more</p>")
    files = readers.source_tree(spark, str(root))
    assert sorted(r.path for r in files.collect()) == ["tree/x.js", "x.js"]
    assert [(r.path, r.current_copy) for r in extract.candidates(files, most=3).collect()] == [("tree/x.js", "Please try it again"), ("tree/x.js", "Then do it once more"), ("x.js", "Please try it again")]
    (tmp_path / "png").mkdir()
    (tmp_path / "png/a.png").write_bytes(b"one")
    assert [(r["name"], r.sha256[:4]) for r in readers.images(spark, str(tmp_path / "png")).collect()] == [("a.png", "7692")]


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([("1", [("user", "u")], {"a": "b"}, ("x",)), ("2", [("user", "v")], {}, ("y",))], "id string, messages array<struct<role:string,content:string>>, metadata map<string,string>, provenance struct<license:string>")
    made = rows.tagged(base, "rewrite", "text", F.lit("s"), "train", image=F.lit("a/b/c.png")).withColumn("split", F.when(F.col("id") == "1", "train").otherwise("test"))
    writers.by_split(made, str(tmp_path / "rows"))
    back = readers.split_rows(spark, str(tmp_path / "rows"), task="rewrite", split="test")
    assert [(r.id, r.image) for r in back.collect()] == [("2", "screens/c.png")] and "split" in back._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert readers.split_rows(spark, str(tmp_path / "rows"), modality="vision").count() == 0
    writers.report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n == 1
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.jsonl").write_text('{"w": "a"}\n{"w": "b"}')
    run = lambda cp: writers.checkpointed(readers.votes(spark, str(tmp_path / "v"), "w string"), str(tmp_path / "out"), str(tmp_path / cp)).awaitTermination()
    run("c1")
    run("c2")  # the first batch once more
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_small_pieces(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    parts = F.lit(None).cast("array<struct<type:string,text:string>>")
    assert get(text.flat_content(parts, F.lit("plain"))) == "plain" and get(text.flat_content(parts, F.lit(None).cast("string"))) == ""
    assert get(text.flat_content(F.array(F.struct(F.lit("text").alias("type"), F.lit("a").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))) == "a"
    assert get(text.base_name(F.lit("a/b/c.d"))) == "c.d"
    cands = spark.createDataFrame([("p.js", 3, "error", "Oops", "3: Oops")], "path string, line int, kind string, current_copy string, context string")
    (row,) = rows.placeholder_rows(cands, ["path", "line"]).collect()
    assert row.prompt == "Path: p.js\nType: error\nCurrent copy: Oops\nContext: 3: Oops" and len(row.id) == 36
    (norm,) = rows.normal_prediction(spark.createDataFrame([(7, " a ", None)], "id int, rewrite string, reason string"), "id").collect()
    assert tuple(norm) == ("7", "a", "", "", "")
    index = spark.createDataFrame([("a",)], "name string")
    assert [r["name"] for r in leakage.missing(spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), index, "name").collect()] == ["b"]
    votes = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("z", 1, "no")], "key string, at int, v string")
    assert [(r.key, r.v) for r in arena.pinned(votes, spark.createDataFrame([("k",)], "key string"), ["key"], "at").collect()] == [("k", "new")]
    message = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "u"), ("assistant", "a"), ("assistant", "b"))])
    assert get(rows.gold_answer(message)) == "a" and [m.content for m in get(rows.without_answers(message))] == ["u"]
    cells = spark.createDataFrame([(0, "q", 1.0, 0.25), (1, "k", 4.0, 1.0)], "layer int, module string, norm double, intensity double")
    assert tensors.hottest(cells).first().module == "k"
    assert tuple(tensors.extent(cells).first()) == (2, 2)
    assert [r.share for r in tensors.peak_share(cells, "module").collect()] == [1.0, 1.0]
