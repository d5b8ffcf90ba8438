"""Query and SQL of tool-call linking.

Turns that are tool envelopes are linked as they are. The plain turns of the conversations are put in envelopes: a user
turn calls ``reply`` with its prompt and, as ``after``, a reference to the call before it; a system turn calls
``rules``; the assistant turn after a call is its result. So that every outcome occurs, the length of a text
decides on faults: a prompt that is missing, a turn of the wrong type, an argument that is unknown, a tool that is
unknown, and rules that refer to the first reply, which refers to them. Plain are all user and system turns and
all assistant turns without a tool call, whatever their text starts with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.tool_calls import canonical, events, holds_calls, link, quoted

SCHEMAS = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True), "after": ("object", False)},
    "rules": {"text": ("string", True), "for": ("object", False)},
}


def envelopes(messages: DataFrame) -> DataFrame:
    """The messages, plain turns as calls and results."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    size = F.length(text)
    to = lambda n: F.concat(F.lit('{"$ref":"t'), n.cast("string"), F.lit('"}'))
    reply = canonical(
        {
            "after": F.when(F.col("turn") >= 1, to(F.greatest(F.col("turn") - 2, F.lit(0)))),
            "mood": F.when(size % 7 == 2, F.lit("null")),
            "prompt": F.when(size % 7 != 0, quoted(text)),
            "turn": F.when(size % 7 == 1, quoted(turn)).otherwise(turn),
        }
    )
    rules = canonical({"for": F.when(size % 2 == 0, to(F.col("turn") + 1)), "text": quoted(text)})
    user = F.col("role") == "user"
    name = F.when(user, F.lit('"reply"')).when(size % 5 == 0, F.lit('"law"')).otherwise(F.lit('"rules"'))
    one = canonical({"id": quoted(F.concat(F.lit("t"), turn)), "name": name, "arguments": F.when(user, reply).otherwise(rules)})
    call = canonical({"tool_calls": F.concat(F.lit("["), one, F.lit("]"))})
    result = canonical({"tool_call_id": quoted(F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))), "content": quoted(text)})
    asks = user | (F.col("role") == "system")
    says = (F.col("role") == "assistant") & ~holds_calls()
    return messages.select(
        "conv_id", "turn",
        F.when(asks, F.lit("assistant")).when(says, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(asks, call).when(says, result).otherwise(F.col("text")).alias("text"),
    )


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No turn, and no level: -1.
    return link(*events(envelopes(table(spark, sf_dir, "conversations"))), SCHEMAS).fillna(-1, ["turn", "result_turn", "level"])


ORACLE = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
c AS (SELECT conv_id, 't' || turn AS call_id, turn,
             CASE WHEN role = 'user' THEN 'reply' WHEN n % 5 = 0 THEN 'law' ELSE 'rules' END AS name,
             CASE WHEN role = 'user' AND turn >= 1 THEN 't' || greatest(turn - 2, 0) WHEN role = 'system' AND n % 2 = 0 THEN 't' || (turn + 1) END AS dep,
             CASE WHEN role = 'user'
                  THEN '{' || CASE WHEN turn >= 1 THEN '"after":{"$ref":"t' || greatest(turn - 2, 0) || '"},' ELSE '' END || CASE WHEN n % 7 = 2 THEN '"mood":null,' ELSE '' END
                           || CASE WHEN n % 7 <> 0 THEN '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END
                           || '"turn":' || CASE WHEN n % 7 = 1 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}'
                  ELSE '{' || CASE WHEN n % 2 = 0 THEN '"for":{"$ref":"t' || (turn + 1) || '"},' ELSE '' END || '"text":' || CAST(to_json(text) AS VARCHAR) || '}' END AS args,
             CASE WHEN role = 'system' THEN CASE WHEN n % 5 = 0 THEN 'tool:unknown' END
                  WHEN n % 7 = 0 THEN 'missing:prompt' WHEN n % 7 = 1 THEN 'type:turn' WHEN n % 7 = 2 THEN 'unknown:mood' END AS fault
      FROM m WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, 't' || (turn - 1) AS call_id, turn AS result_turn, min(CAST(to_json(text) AS VARCHAR)) AS content, count(*) AS copies FROM m WHERE role = 'assistant' GROUP BY ALL),
e AS (SELECT c.conv_id, c.call_id, c.dep FROM c JOIN c d ON d.conv_id = c.conv_id AND d.call_id = c.dep),
l(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) FROM c WHERE (conv_id, call_id) NOT IN (SELECT conv_id, call_id FROM e)
  UNION SELECT e.conv_id, e.call_id, l.level + 1 FROM l JOIN e ON e.conv_id = l.conv_id AND e.dep = l.call_id)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
       CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.result_turn IS NULL THEN 'open' ELSE 'linked' END AS status,
       coalesce(c.turn, -1) AS turn, coalesce(r.result_turn, -1) AS result_turn, coalesce(l.level, -1) AS level,
       concat_ws(';', c.fault, CASE WHEN c.turn IS NOT NULL AND l.level IS NULL THEN 'order:circle' END) AS errors,
       CAST(CASE WHEN c.turn IS NULL THEN 0 ELSE 1 END + coalesce(r.copies, 0) AS BIGINT) AS copies,
       '{' || CASE WHEN c.turn IS NULL THEN '' ELSE '"arguments":' || c.args || ',' END
           || '"conversation":' || coalesce(c.conv_id, r.conv_id) || ',"id":"' || coalesce(c.call_id, r.call_id) || '"'
           || CASE WHEN c.turn IS NULL THEN '' ELSE ',"name":"' || c.name || '"' END
           || CASE WHEN r.result_turn IS NULL THEN '' ELSE ',"result":' || r.content END || '}' AS record
FROM c LEFT JOIN l USING (conv_id, call_id) FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
