"""Chat formatting by perspective rotation: every participant is the assistant once.

All native: a conversation's turns are gathered once, and a row per participant renders them. The mask is kept as one
run per turn: so many characters to skip, then so many to train on; the runs of a row add up to its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
END = "<|end|>\n"


def header(me: Column, name: Column, context: Column) -> Column:
    return (
        F.when(me, F.lit("<|assistant|>\n"))
        .when(context, F.concat(F.lit("<|"), name, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )


def rotate(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per conversation and participant: conv_id, assistant, n_turns, n_trained, text, runs (array of skip, train).

    Participants are the conversation's different speakers but for context_roles, whose turns are context for all. The
    trained characters are the participant's texts with their end marks. Turns are in order of turn, null turns first, then speaker and
    text; repeated rows are turns of their own. A null or empty speaker is 'unknown', a null text is empty, a very long one is rendered whole. Rows with a
    null id are one conversation. No rows, or only context, give no rows; other columns are not read.
    """
    name = F.coalesce(F.nullif(F.col(role_col).cast("string"), F.lit("")), F.lit("unknown"))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), name.alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    known = F.array(*[F.lit(r) for r in context_roles]).cast("array<string>")
    speakers = F.array_except(F.array_distinct(F.transform("turns", lambda t: t["name"])), known)
    each = talks.withColumn("assistant", F.explode(speakers))
    me = lambda t: t["name"] == F.col("assistant")
    head = lambda t: header(me(t), t["name"], F.array_contains(known, t["name"]))
    own = lambda t: F.length(t["text"]) + len(END)
    runs = F.transform(
        "turns",
        lambda t: F.struct(
            (F.length(head(t)) + F.when(me(t), 0).otherwise(own(t))).alias("skip"), F.when(me(t), own(t)).otherwise(0).alias("train")
        ),
    )
    return each.select(
        "conv_id", "assistant", F.size("turns").alias("n_turns"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["train"]).alias("n_trained"),
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "").alias("text"),
        runs.alias("runs"),
    )


#: The same in DuckDB's SQL, with the runs as 'skip:train' text.
ROTATE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, name AS assistant FROM t WHERE name <> 'system'),
r AS (SELECT p.conv_id, p.assistant, t.turn, t.name, t.text, t.name = p.assistant AS me,
        CASE WHEN t.name = p.assistant THEN '<|assistant|>' WHEN t.name = 'system' THEN '<|system|>' ELSE '<|user name=' || t.name || '|>' END || chr(10) AS head
      FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, assistant, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(sum(CASE WHEN me THEN length(text) + 8 ELSE 0 END) AS BIGINT) AS n_trained,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, name, text) AS text,
       string_agg((length(head) + CASE WHEN me THEN 0 ELSE length(text) + 8 END) || ':' || (CASE WHEN me THEN length(text) + 8 ELSE 0 END), ' '
                  ORDER BY turn NULLS FIRST, name, text) AS runs
FROM r GROUP BY conv_id, assistant
"""
