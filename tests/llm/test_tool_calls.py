import json
import random

from pyspark.sql import functions as F

from corpusloom.llm import tool_calls as T

SCHEMAS = {"add": {"a": ("number", True), "b": ("number", False), "note": ("string", False)}, "now": {}}


def call(i, name, **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_links_orders_and_validates(spark):
    say = lambda *calls: json.dumps({"tool_calls": list(calls)})
    answer = lambda i, x: json.dumps({"tool_call_id": i, "content": x})
    rows = [
        (1, 0, "user", "hi", 0),
        (1, 1, "assistant", say(call("x", "add", b=2, a=1.5), call("y", "now")), 0),
        (1, 2, "tool", answer("y", {"z": 1, "a": "é\n"}), 0),
        (1, 3, "tool", answer("x", None), 0),
        (1, 4, "assistant", say(call("w", "add", a={"$ref": "x"})), 0),
        (1, 5, "assistant", say(call("v", "add", a={"$ref": "w"}, b={"$ref": "y"})), 0),
        (2, 0, "assistant", say(call("x", "add", note=3), call("q", "nope"), call("p", "add", a=1, c=2)), 0),
        (2, 1, "tool", answer("lost", "?"), 0),
        (2, 2, "assistant", '{"tool_calls": [{"id": "bad", "name": "add", "arguments": [1]}]}', 0),
        (2, 3, "assistant", '{"tool_calls": not json', 0),
        (3, 0, "assistant", say(call("m", "add", a={"$ref": "n"}), call("n", "add", a={"$ref": "m"}), call("o", "add", a={"$ref": "gone"})), 0),
        (4, 0, "assistant", say(call("x", "now")), 0),
        (4, 0, "assistant", say(call("x", "now")), 0),
        (4, 1, "tool", answer("x", 7), 0),
        (None, 1, "tool", answer("x", 7), 0),
        (5, 0, "assistant", None, 0),
        (5, 1, "assistant", "", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int").repartition(3)
    got = {(r.conv_id, r.call_id): r for r in T.link(*T.events(df), SCHEMAS).collect()}
    assert {k: (r.status, r.level, r.errors) for k, r in got.items()} == {
        (1, "x"): ("linked", 0, ""),
        (1, "y"): ("linked", 0, ""),
        (1, "w"): ("open", 1, "type:a"),
        (1, "v"): ("open", 2, "type:a;type:b"),
        (2, "x"): ("open", 0, "missing:a;type:note"),
        (2, "q"): ("open", 0, "tool:unknown"),
        (2, "p"): ("open", 0, "unknown:c"),
        (2, "lost"): ("orphan", None, ""),
        (2, "bad"): ("open", 0, "arguments:not an object"),
        (3, "m"): ("open", None, "type:a;order:circle"),
        (3, "n"): ("open", None, "type:a;order:circle"),
        (3, "o"): ("open", 0, "type:a"),
        (4, "x"): ("linked", 0, ""),
        (None, "x"): ("orphan", None, ""),
    }
    assert got[1, "y"].record == '{"arguments":{},"conversation":1,"id":"y","name":"now","result":{"a":"é\\n","z":1}}'
    assert got[1, "x"].record == '{"arguments":{"a":1.5,"b":2},"conversation":1,"id":"x","name":"add","result":null}'
    assert got[4, "x"].copies == 3
    assert T.link(*T.events(df.limit(0)), SCHEMAS).count() == 0


def test_braces_are_no_envelopes(spark, tmp_path):
    import duckdb

    from corpusloom.llm import q_tool_calls as Q

    plain = [
        (1, 0, "user", '{"a": 1}'), (1, 1, "assistant", "sure"), (1, 2, "user", "{% if x %}"), (1, 3, "assistant", '{"b": [2'),
        (2, 0, "user", "give me json"), (2, 1, "assistant", '\n {"tool_calls": []}'), (2, 2, "user", '{"tool_calls": [{"id": "u"}]}'),
        (3, 0, "user", None), (3, 1, "assistant", '{"tool_calls": not json'), (4, 1, "assistant", "{"),
    ]
    tools = [
        (5, 0, "assistant", '{"tool_calls": [{"id": "k", "name": "reply", "arguments": {"prompt": "p", "turn": 0}}]}'),
        (5, 1, "tool", '{"tool_call_id": "k", "content": 1}'), (5, 2, "tool", '{"tool_call_id": '), (5, 3, "tool", '{"content": 2}'),
        (5, 4, "tool", "oh"), (5, 4, "tool", "oh"), (5, 5, "tool", None),
    ]
    spark.createDataFrame(plain + tools, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in Q.op5_tool_call_linking(spark, str(tmp_path)).collect() if r.conv_id < 5)
    with duckdb.connect() as c:
        c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", plain)
        assert got == sorted(c.execute(Q.ORACLE).fetchall())
    rest = [r for r in Q.op5_tool_call_linking(spark, str(tmp_path)).collect() if r.conv_id == 5]
    assert [(r.call_id, r.errors) for r in rest if r.status == "linked"] == [("k", "")]
    broken = sorted((r.result_turn, r.status, r.errors, r.copies, json.loads(r.record)["result"]) for r in rest if r.call_id is None)
    e = "result:no envelope"
    assert broken == [(2, "orphan", e, 1, '{"tool_call_id": '), (3, "orphan", e, 1, '{"content": 2}'), (4, "orphan", e, 2, "oh"), (5, "orphan", e, 1, "")]


def leveled(deps):
    """Levels by waiting for all that a call refers to; calls in or after a circle are missing."""
    known = {}
    while True:
        new = {k: 1 + max((known[d] for d in ds if d in deps), default=-1) for k, ds in deps.items() if k not in known and all(d in known for d in ds if d in deps)}
        if not new:
            return known
        known |= new


def test_levels_equal_brute_force(spark):
    rng = random.Random(6)
    calls, want = [], {}
    for conv in range(60):
        n = rng.choice((1, 4, 12, 40))
        deps = {f"c{k}": sorted({f"c{rng.randrange(n)}" if rng.random() < 0.02 else f"c{rng.randrange(k)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))} if k else []) for k in range(n)}
        if conv % 9 == 0:
            deps["c0"] = [f"c{n - 1}"]
        want |= {(conv, k): v for k, v in leveled(deps).items() if any(d in deps for d in deps[k])}
        calls += [(conv, k, 0, 0, "f", json.dumps({"a": [{"$ref": d} for d in ds], "b": {"$ref": "gone"}})) for k, ds in deps.items()]
    calls += [(100, f"c{k}", 0, 0, "f", json.dumps({"a": {"$ref": f"c{k - 1}"}})) for k in range(300)]
    want |= {(100, f"c{k}"): k for k in range(1, 300)}
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, place int, name string, arguments string").repartition(5)
    got = {(r.conv_id, r.call_id): r.level for r in T.levels(df).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(want) > 500
    assert not {(0, "c0")} & set(got)


def test_envelopes_are_strict(spark):
    texts = ['{"a":1}', ' {"a":[1,2]}', '{"a":1} x', '{"a":1},2', '{"a":1}]', "{'a':1}", '{"a":1', "", None, '{"a":1},0] y', "7", '{"a":"]"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k for r in df.select("k", F.expr(T.strict("t")).alias("v")).where("v IS NOT NULL").select("k").collect()}
    assert got == {0, 1, 10, 11}


def test_a_very_long_turn_and_ties(spark):
    long = "x" * 3_000_000
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("k", "add", a=1, note=long), call("j", "add", a=1)]})), (1, 1, "tool", json.dumps({"tool_call_id": "k", "content": long}))]
    rows += [(1, 1, "tool", json.dumps({"tool_call_id": "j", "content": c})) for c in ("b", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in T.link(*T.events(df), SCHEMAS).collect()}
    assert len(got["k"].record) > 6_000_000 and got["k"].errors == "" and json.loads(got["j"].record)["result"] == "a" and got["j"].copies == 3


def test_references_with_escapes(spark):
    odd = ['a"1', "b\\", "\\", "c\n\t", 'é"$ref":"x"', "/"]
    calls = [call(i, "now") for i in odd] + [call(f"to {k}", "now", a={"$ref": i}) for k, i in enumerate(odd)]
    calls += [call("key", "now", **{'x"$ref': "/"}), call("text", "now", a='"$ref":"/"')]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r.level for r in T.link(*T.events(df), {"now": {}}).collect()}
    assert got == {i: 0 for i in [*odd, "key", "text"]} | {f"to {k}": 1 for k in range(len(odd))}
