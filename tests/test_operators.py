import json
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import contract, text
from corpusloom.operators import arena, cost, extract, leakage, rows, score, split, tensors, validate
from corpusloom.sources import readers, writers
from corpusloom.streaming import votes


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_scalar_functions(spark):
    assert one(spark, text.stable_id(F.col("a"), F.col("b")), a="é", b="x") == str(uuid.uuid5(uuid.NAMESPACE_URL, "é::x"))
    assert one(spark, text.words(F.col("a")), a="Don't X-ray A b c'") == ["don't", "x-ray", "c'"]
    assert one(spark, text.phrases(text.words(F.col("a")), 3), a="aa bb") == []
    assert one(spark, text.phrases(text.words(F.col("a")), 2), a="aa bb cc") == ["aa bb", "bb cc"]
    assert one(spark, text.collapse(F.col("a")), a="  a\t\nb c ").split(" ") == ["a", "b", "c"]
    assert one(spark, text.labelled_line(F.col("a")), a="x\nCurrent copy:  Save it \nmore") == "Save it"
    assert one(spark, text.labelled_line(F.col("a")), a="none") == ""
    assert one(spark, text.after_thinking(F.col("a")), a="<think>a</think>b</think> c ") == "c"
    assert one(spark, text.thinking(F.col("a")), a="<think>a b</think>c") == "a b"
    assert one(spark, text.finished_answer(F.col("a")), a="<think>going on") == ""
    assert one(spark, text.html_escaped(F.col("a")), a="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert one(spark, text.ellipsis(F.col("a"), 3), a="abcd") == "abc…"
    assert one(spark, text.stem(F.col("a")), a="x/y.z/Name.v1.png") == "Name.v1"


def test_contracts():
    good = json.dumps({"rewrite": "a {{x}} b", "reason": "r"})
    assert contract.check_rewrite(good)["ok"] and not contract.check_rewrite(good + " x")["ok"]
    for bad in (None, "", "[]", "42", '{"rewrite": 42, "reason": "r"}', '{"rewrite": " ", "reason": "r"}', '{"rewrite":"a","reason":"b","risk":1}'):
        assert not contract.check_rewrite(bad)["ok"]
    two = f"x {{ {good} <think> </think> {good} and {json.dumps({'rewrite': 'last'})} {{"
    assert contract.last_object(two)["rewrite"] == "last" and not contract.widest_object(two)["ok"]
    assert contract.last_object('{"outer": {"rewrite": "in"}}')["ok"] is False
    assert contract.widest_object("say " + good + " ok")["rewrite"] == "a {{x}} b"
    issue = {"type": "t", "strings": ["a"], "problem": "p", "fix": "f"}
    assert contract.check_issues(json.dumps({"inventory": ["a"], "issues": [issue]})) == ""
    assert contract.check_issues(json.dumps({"inventory": [1], "issues": []})) == "inventory"
    assert contract.check_issues(json.dumps({"inventory": [], "issues": [issue | {"fix": ""}]})) == "issue fields"


def test_issues(spark):
    issue = lambda kind, *s: {"type": kind, "strings": list(s), "problem": "p", "fix": "f"}
    raw = {"inventory": ["a"], "issues": [issue("Casing", "A", "a"), issue("casing", "A ", " A"), issue("tone", "x", "x"), issue("brand", "x"), issue("inconsistent", "y", "y")]}
    got = one(spark, contract.filtered_output(F.col("a")), a=json.dumps(raw))
    assert [i.type for i in got.issues] == ["Casing", "tone", "brand"] and not got.parse_error
    assert one(spark, contract.filtered_output(F.col("a")), a="nope").parse_error and one(spark, contract.filtered_output(F.col("a")), a="[1]").parse_error
    assert one(spark, contract.all_types(F.col("a")), a="Brand terminology") == ["brand", "terminology"]
    assert one(spark, contract.all_types(F.col("a")), a="brand consistency") == ["brand"]


FILES = [
    ("src/a.tsx", "const x = 1\n<B title=\"Don't worry about it\">\n  Save all changes now\n</B>\n<p>Please try it again</p>\nlabel: 'Say \"hi\" to us'", 100),
    ("src/b.json", '{\n "k_1": "Hello there friend",\n "n": 3}', 100),
    ("src/c.ts", "Wizard = 'Wizard'\nMAX_EMPTY_STATE = 'sql editor empty'\ntype: 'String'\nx: 'flex-1 p-2 m-3'\ny = 'Delete'", 100),
    ("src/tests/d.tsx", "<p>Never to be seen here</p>", 100),
    ("build/e.js", "<p>Not to be read here</p>", 100),
    ("src/f.py", "<p>Not an extension</p>", 100),
    ("src/g.js", "<p>Too large a file</p>", 1_000_001),
    ("src/h.js", "x = 'unterminated " + "a" * 20_000, 100),
]


def test_candidates(spark):
    files = extract.scannable(spark.createDataFrame(FILES, "path string, text string, length long"))
    got = {(r.path, r.line, r.kind, r.current_copy) for r in extract.candidates(files).collect()}
    assert got == {
        ("src/a.tsx", 2, "button_or_label", "Don't worry about it"),
        ("src/a.tsx", 5, "button_or_label", "Please try it again"),
        ("src/a.tsx", 6, "button_or_label", 'Say "hi" to us'),
        ("src/b.json", 2, "i18n_string", "Hello there friend"),
        ("src/c.ts", 5, "button_or_label", "Delete"),
    }
    context = next(r.context for r in extract.candidates(files).collect() if r.path == "src/b.json")
    assert context == '1: {\n2:  "k_1": "Hello there friend",\n3:  "n": 3}'


def test_escape_and_cuts(spark):
    cases = {"{a ? 'b' : 'c'}": True, "x === y": True, "<b>x</b>": True, "{name}": True, "{{ user.name }} hi": False, "{{x}}": False, "": False, None: False, "{{ a ? b : c }}": True}
    for value, want in cases.items():
        assert one(spark, extract.escape(F.col("a")), a=value) is want, value
    assert one(spark, extract.cut_at_apostrophe(F.col("a"), F.col("b")), a="Don (x", b="it: Don (x't") is True
    assert one(spark, extract.constant_value(F.col("a"), F.col("b")), a=r"a\Eb", b=r"KEY_A = 'a\Eb'") is True
    assert one(spark, extract.changed(F.col("a"), F.col("b")), a="a  b", b="a b") is False
    assert one(spark, extract.changed(F.col("a"), F.col("b"), exact=True), a="a  b", b="a b") is True


def test_rewrite_metrics(spark):
    df = spark.createDataFrame([("old", "Submit", "x"), ("old", "save the invalid one " * 4, "x"), ("old", "bad", "inline_error"), ("ok", "OK", "x"), ("old", "", "x")], "c string, r string, k string")
    got = [(r.not_generic, round(r.concise, 3), r.specific_action, r.no_blame, r.changed_when_needed) for r in score.rewrite_metrics(df, F.col("c"), F.col("r"), F.col("k")).collect()]
    assert got == [(0, 1, 0.5, 1, 1), (1, 0.667, 1, 0, 1), (1, 1, 0.5, 1, 1), (0, 1, 0.5, 1, 0), (1, 1, 0.5, 1, 1)]


def test_votes_and_costs(spark):
    picks = {"A": "a", "both bad": "both_bad", "Both": "both_bad", "B": "b", "tie": "tie", "": None, "banana": None}
    for said, want in picks.items():
        assert one(spark, arena.choice(F.col("a")), a=said) == want
    cast = spark.createDataFrame([("finetune",), ("finetune",), ("base",), ("unknown",), (None,)], "winner string")
    tallied = arena.tally(cast)
    assert {r.winner: r.n for r in tallied.collect()} == {"finetune": 2, "base": 1, "tie": 0, "both_bad": 0}
    assert abs(arena.win_rate(tallied).first().win_rate - 2 / 3) < 1e-9 and arena.win_rate(arena.tally(cast.limit(0))).first().win_rate is None
    low, high = text.wilson(F.lit(11), F.lit(60))
    a, b = spark.range(1).select(low, high).first()
    assert abs(a - 0.1055) < 1e-3 and abs(b - 0.2992) < 1e-3
    run = spark.createDataFrame([(1_000_000, 100_000, 1000, 2.0)], "prompt_tokens long, completion_tokens long, strings long, measured_usd double")
    prices = spark.createDataFrame([("b", 10.0, 20.0), ("a", 1.0, 10.0)], "model string, input double, output double")
    assert [tuple(r) for r in cost.at_list_prices(run, prices).collect()] == [("a", 2.0, 2.0, 1.0), ("b", 12.0, 12.0, 6.0)]


def test_norms_and_tensor_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 6)).astype("<f4"), rng.normal(size=(5, 4)).astype("<f4")
    half = (b.view("<u4") >> 16).astype("<u2")
    parts = {"m.layers.3.q.lora_A.weight": ("F32", a), "m.layers.3.q.lora_B.weight": ("BF16", half), "steps": ("I64", np.array([1], "<i8"))}
    head, body = {"__metadata__": {"x": "y"}}, b""
    for name, (kind, x) in parts.items():
        head[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [len(body), len(body) + x.nbytes]}
        body += x.tobytes()
    raw = json.dumps(head).encode()
    (tmp_path / "x.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + body)
    factors = tensors.pair_factors(readers.tensors(spark, str(tmp_path)))
    got = tensors.intensities(factors.select("layer", "module", tensors.low_rank_norm(F.col("a"), F.col("b"), 4).alias("norm"))).first()
    rounded = (half.astype("<u4") << 16).view("<f4")
    assert (got.layer, got.module, got.intensity) == (3, "q", 1.0) and abs(got.norm - np.linalg.norm(rounded @ a)) < 1e-4


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "rows")
    df = spark.createDataFrame([("a", "é"), ("b", "x")], "id string, text string")
    writers.jsonl(df, p)
    assert sorted(r.text for r in readers.jsonl(spark, p, "id string, text string").collect()) == ["x", "é"]
    writers.append_missing(df.union(spark.createDataFrame([("c", "y")], df.schema)), p, "id")
    assert readers.jsonl(spark, p, "id string, text string").count() == 3
    assert readers.jsonl_or_empty(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    with pytest.raises(readers.BadLine, match="bad.jsonl"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "id string")
    (tmp_path / "tree/src").mkdir(parents=True)
    (tmp_path / "tree/node_modules").mkdir()
    (tmp_path / "tree/src/A.TSX").write_bytes(b"ok \xff\xfe<")
    (tmp_path / "tree/node_modules/b.js").write_text("x")
    assert [tuple(r) for r in readers.source_tree(spark, str(tmp_path / "tree")).collect()] == [("src/A.TSX", "ok <")]
    (tmp_path / "g.json").write_text('{"derived_rules": [{"theme": "t", "source_policy_ids": ["p"]}], "markdown": "", "content": "body"}')
    assert readers.rules(spark, str(tmp_path / "g.json")).first().theme == "t"
    assert readers.guides(spark, str(tmp_path / "g.json")).first().text == "body"
    blinded = arena.blind(df.withColumn("b", F.lit("other")), "id", "text", "b", "m1", "m2")
    writers.sheets(blinded, str(tmp_path / "sheet"), str(tmp_path / "key"), "id", [])
    back = readers.csv(spark, str(tmp_path / "sheet")).join(readers.csv(spark, str(tmp_path / "key")), "id").collect()
    assert len(back) == 2 and all((r.option_a == "other") == (r.a_is == "m2") for r in back)
    assert writers.markdown(df.orderBy("id")).split("\n")[2] == "| a | é |"


def test_stream_goes_on(spark, tmp_path):
    (tmp_path / "votes").mkdir()
    put = lambda k, *w: (tmp_path / f"votes/{k}.jsonl").write_text("\n".join(json.dumps({"winner": x}) for x in w))
    seen = []
    for k, w in enumerate((("a", "b"), ("b",))):
        put(k, *w)
        stream = readers.votes(spark, str(tmp_path / "votes"), "winner string")
        writers.checkpointed(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b, n: seen.append(b.count())).awaitTermination()
    assert seen == [2, 1] and spark.read.parquet(str(tmp_path / "out")).count() == 3
    tally = votes.drained(votes.running_tally(readers.votes(spark, str(tmp_path / "votes"), "winner string")), "complete", str(tmp_path / "cp2"))
    assert {r.winner: r.n for r in tally.collect()} == {"a": 1, "b": 2}


def test_validation_and_gates(spark):
    chat = [("system", "s"), ("user", "u"), ("assistant", " ")]
    df = spark.createDataFrame([(1, [("system", "s")]), (2, chat), (3, [("user", "u"), ("user", "x" * 4000), ("assistant", "y")])], "id long, messages array<struct<role:string,content:string>>")
    got = {r.id: r.e for r in df.select("id", validate.chat_errors(F.col("messages"), 900).alias("e")).collect()}
    assert got == {1: ["messages"], 2: ["empty:2"], 3: ["roles", "tokens"]}
    parts = spark.createDataFrame([([("image", None)],), ([("text", "t"), ("image", None)],), (None,)], "p array<struct<type:string,text:string>>")
    e = [r.e for r in parts.select(validate.vision_errors(F.lit("s"), F.col("p"), F.lit("a"), F.lit("i")).alias("e")).collect()]
    assert e == [["no text part"], [], ["parts"]]
    with pytest.raises(leakage.GateError):
        leakage.assert_empty(df, "rows")
    leakage.assert_empty(df.limit(0), "rows")
    assert one(spark, validate.modality(F.lit(None).cast("string"), F.lit("rewrite"), F.lit(True))) == "text"


def test_split_and_rows(spark):
    df = spark.createDataFrame([(i, "c", "" if i < 3 else f"t{i % 4}") for i in range(20)], "id long, cat string, copy string")
    out = split.split_dedup(df, F.col("cat"), F.col("copy"), "id", eval_size=2, cap=3).collect()
    held = {r.copy for r in out if r.split == "eval"}
    assert len(held) == 2 and "" not in held and not held & {r.copy for r in out if r.split == "train"}
    assert sum(r.copy == "" for r in out) == 3 and max(sum(r.copy == c for r in out if r.split == "train") for c in {r.copy for r in out}) == 3
    assert rows.existing(df, ["id", "nope"]).columns == ["id"]
    assert split.cycled(df.limit(3), "id", 7).count() == 7 and split.by_position(df, "id", df.limit(0), "id").count() == 0
