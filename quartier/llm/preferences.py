"""Preference formatting in DataFrame functions only.

A pair of conversations, chosen and rejected, is rendered as one prompt and two completions: the prompt is their
longest common prefix of turns (equal role and text), rendered once, and each completion is what follows.
A completion's mask is a run-length string, `0:n` for n characters that are not trained on and `1:n` for n that
are: texts and end marks of assistant turns are trained on, everything else is not.

A null role or text is rendered as empty, and two nulls are equal. Equal conversations give a prompt and empty
completions, as do conversations without turns; a null conversation is one without turns. Turns are ordered by
`turn`, then role and text, nulls first, so repeated rows stay. A turn with a null conv_id is a conversation of its own. Extra columns stay
as they are; those named like the new ones are replaced. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm.store import fresh, quoted

NEW = ("n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _tail(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("\n" + END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def mask(turns: Column) -> Column:
    trained = F.transform(turns, lambda t: F.concat(F.lit("0:"), F.char_length(_head(t)), F.when(t["role"] == "assistant", F.lit(",1:")).otherwise(F.lit(",0:")), F.char_length(_tail(t))))
    return F.array_join(trained, ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs with `n_prompt_turns`, `prompt`, and for each side the completion and its mask.

    Both columns are arrays of structs that have `role` and `text`.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def turns(name: str) -> Column:
        return F.coalesce(F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty)

    c, r, n = fresh(pairs.columns, "__c", "__r", "__n")
    two = pairs.withColumns({c: turns(chosen), r: turns(rejected)})
    least = F.least(F.size(c), F.size(r))
    # zip gives null where the shorter one has ended, so the first difference is found in one pass
    same = F.zip_with(c, r, lambda x, y: x.eqNullSafe(y))
    common = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(least).cast("int")
    cut = two.withColumn(n, F.least(common, least))
    rest = {side: F.slice(side, F.col(n) + 1, F.greatest(F.size(side) - F.col(n), F.lit(0))) for side in (c, r)}
    stay = quoted(x for x in pairs.columns if x.lower() not in (chosen.lower(), rejected.lower(), *NEW))
    new = (F.col(n), render(F.slice(c, F.lit(1), F.col(n))), render(rest[c]), mask(rest[c]), render(rest[r]), mask(rest[r]))
    return cut.select(*stay, *(x.alias(name) for x, name in zip(new, NEW, strict=True)))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations.

    Chosen is the conversation up to its last assistant turn. Rejected is the same with that turn's text replaced by the
    assistant's turn before, an answer to something else; if there is none, by the first half of the text's characters. A conversation
    without an assistant turn is paired with itself. Turns with a null conv_id aren't gathered: each is a conversation of its own. A conversation is one
    training example and has to fit into a row.
    """
    turn = F.struct("turn", "role", "text")
    whole = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    whole = whole.union(conversations.filter("conv_id IS NULL").select("conv_id", F.array(turn)))
    answers = F.filter(F.transform("t", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == "assistant")
    found = whole.withColumn("a", answers).withColumn("last", F.try_element_at("a", F.lit(-1))).withColumn("before", F.try_element_at("a", F.lit(-2)))
    upto = F.when(F.col("last").isNull(), F.col("t")).otherwise(F.slice("t", F.lit(1), F.coalesce(F.col("last.i"), F.lit(0)) + 1))
    text = F.col("last.text")
    other = F.when(F.col("before").isNotNull(), F.col("before.text")).otherwise(F.substring(text, F.lit(1), F.floor(F.char_length(text) / 2).cast("int")))
    swapped = F.transform("chosen", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("last.i"), other).otherwise(t["text"]).alias("text")))
    return found.withColumn("chosen", upto).withColumn("rejected", swapped).select("conv_id", "chosen", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(conversation_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


ORACLE = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
a AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS n FROM t WHERE role = 'assistant'),
k AS (SELECT c.conv_id, l.i AS last_i, CASE WHEN b.conv_id IS NOT NULL THEN b.text ELSE substr(l.text, 1, length(l.text) // 2) END AS other
      FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN a l ON l.conv_id = c.conv_id AND l.n = 1 LEFT JOIN a b ON b.conv_id = c.conv_id AND b.n = 2),
c AS (SELECT t.conv_id, i, coalesce(role, '') AS role, coalesce(text, '') AS x, coalesce(CASE WHEN i = last_i THEN other ELSE text END, '') AS y,
             last_i IS NOT NULL AND i = last_i AND text IS DISTINCT FROM other AS differs
      FROM t JOIN k USING (conv_id) WHERE last_i IS NULL OR i <= last_i),
p AS (SELECT conv_id, coalesce(min(CASE WHEN differs THEN i END), max(i) + 1) AS first FROM c GROUP BY conv_id),
r AS (SELECT conv_id, i, i < first AS common, '<|' || role || '|>' || chr(10) AS h, x || chr(10) || '<|end|>' || chr(10) AS cx, y || chr(10) || '<|end|>' || chr(10) AS rx,
             CASE WHEN role = 'assistant' THEN ',1:' ELSE ',0:' END AS m FROM c JOIN p USING (conv_id))
SELECT conv_id, (count(*) FILTER (WHERE common))::INTEGER AS n_prompt_turns,
       coalesce(string_agg(h || cx, '' ORDER BY i) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(h || cx, '' ORDER BY i) FILTER (WHERE NOT common), '') AS chosen,
       coalesce(string_agg('0:' || length(h) || m || length(cx), ',' ORDER BY i) FILTER (WHERE NOT common), '') AS chosen_mask,
       coalesce(string_agg(h || rx, '' ORDER BY i) FILTER (WHERE NOT common), '') AS rejected,
       coalesce(string_agg('0:' || length(h) || m || length(rx), ',' ORDER BY i) FILTER (WHERE NOT common), '') AS rejected_mask
FROM r GROUP BY conv_id
"""
