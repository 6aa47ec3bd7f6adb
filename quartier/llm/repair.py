"""Repair of conversation structure by the cheapest edits.

A conversation is right if the first letters of its roles read `(s?(ua)+)?`: an optional system turn, then turns of user and assistant in
alternation, or nothing. A turn is kept for nothing, given the role user or assistant for 3, or deleted for 4; an empty turn of user or
assistant is inserted anywhere for 3. Blank and repeated turns have to be deleted; a truncated turn that isn't deleted adds 3. Of edits that
cost the same, those whose letters (D, I, K, R, in the order of the turns) come first in ASCII are taken.

Windows give each turn its faults. The sorted turns are folded by SQL's aggregate(): four structs of cost and audit, one for each state of the
pattern (nothing yet, after system, after user, after assistant), go from turn to turn, and least() keeps the cheaper, then the ASCII-least, of what leads to the same
state. Audits of the same cost and turn are never prefixes of each other, as letters alone decide the cost, so the least audit so far stays the least.

No task holds more than SEGMENT turns of a conversation. A longer one is cut into segments, each of which is folded from every state it may begin in; a second
aggregate() over the segments' results carries the same four structs. What repeats over segments is looked up by digest, and the digest of a
repaired text of several segments is taken as they stream past in order. Audits, which are returned, have to fit into a row.

A null conv_id is a conversation of its own; the null turn comes first. A null role or text is one space: such a turn is blank, or has a role that cannot be kept, as has one whose role is empty.
Turns with equal numbers are ordered by role and a digest of the text; repeated rows are repeated turns. A conversation without turns has zeros, an empty audit and
the digest of the empty text. Texts are read whole. An empty table gives none. Extra columns aren't returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quartier.llm.ordering import placed
from quartier.llm.store import written

SEGMENT = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What separates words, for the trimming of ends.
BLANKS = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "assistant")
_STATE = "struct<cost:bigint,audit:string>"


def _none(kind: str = _STATE) -> Column:
    return F.lit(None).cast(kind)


def _plus(state: Column, cost: int | Column, letter: str | Column) -> Column:
    """The state after an edit; null stays null."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _states(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The four states with turns inserted after them where that is cheaper."""
    user = F.least(user, *(_plus(s, INSERT, "I") for s in (none, system, assistant)))
    return F.struct(*(s.alias(n) for n, s in zip(STATES, (none, system, user, F.least(assistant, _plus(user, INSERT, "I"))), strict=True)))


def _next(states: Column, turn: Column) -> Column:
    none, system, user, assistant = (states[n] for n in STATES)
    dead, extra = turn["dead"], F.when(turn["truncated"], TRUNCATED).otherwise(0)

    def kept(state: Column, initial: str) -> Column:
        same = turn["initial"] == initial
        return F.when(~dead, _plus(state, F.when(same, 0).otherwise(REROLE) + extra, F.when(same, "K").otherwise("R")))

    delete = lambda s: _plus(s, DELETE, "D")
    begun = F.when(~dead & (turn["initial"] == "s"), _plus(none, extra, "K"))
    return _states(delete(none), F.least(delete(system), begun), F.least(delete(user), kept(F.least(none, system, assistant), "u")), F.least(delete(assistant), kept(user, "a")))


def _begin(state: str) -> Column:
    own = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*(F.when(F.lit(n == state), own).otherwise(_none()).alias(n) for n in STATES))


def faults(rows: DataFrame) -> DataFrame:
    """Segments (key, seg) of turns (key, seg, again, gone, turn, role, text, copy): the sorted `turns`, and counts of what the windows found in them.

    `again` says that an earlier segment has the same role and text. Rows that are gone only say that there is such a conversation.
    """
    own = W.partitionBy("key", "seg").orderBy("gone", "turn", "role", "tie", "copy")
    same = W.partitionBy("key", "seg", "gone", "tie").orderBy("i")
    end = F.expr(f"trim(TRAILING '{BLANKS}' FROM text)")
    marked = rows.withColumns({"i": F.row_number().over(own), "initial": F.substring("role", 1, 1), "blank": end == "", "last": F.substring(end, -1, 1)})
    before = {c: F.lag(c).over(own) for c in ("turn", "initial")}
    marked = marked.withColumns({"repeated": (F.row_number().over(same) > 1) | F.col("again"), "new": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before["turn"]), "clash": F.coalesce(~F.concat(before["initial"], "initial").isin("su", "ua", "au"), F.lit(False))})
    blank, repeated = F.col("blank"), F.col("repeated")
    truncated = ~blank & ~repeated & ~F.col("last").isin(".", "!", "?")
    turn = F.struct("i", "turn", "role", "text", "initial", (blank | repeated).alias("dead"), truncated.alias("truncated"))
    live = lambda c: F.count_if(~F.col("gone") & c)
    return marked.groupBy("key", "seg").agg(
        F.array_sort(F.collect_list(F.when(~F.col("gone"), turn))).alias("turns"),
        F.min(F.when(~F.col("gone"), F.col("turn"))).alias("least"),
        F.max(F.when(~F.col("gone"), F.col("turn"))).alias("most"),
        live(F.col("new")).alias("turn_numbers"),
        live(blank).alias("blank"),
        live(~blank & repeated).alias("duplicate"),
        live(truncated).alias("truncated"),
        live(F.col("clash")).alias("illegal"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _gaps(least: Column, most: Column, numbers: Column) -> Column:
    return F.coalesce(most - least + 1 - numbers, F.lit(0)).cast("long")


def _repaired(audit: Column, start: Column | str) -> Column:
    """The lines of a segment's turns after its edits, from the state that it begins in."""
    start = F.lit(STATES.index(start)) if isinstance(start, str) else start
    letters = F.when(F.length(audit) == 0, F.array().cast("array<string>")).otherwise(F.split(audit, ""))
    letters = F.filter(letters, lambda x: x != "")
    steps = F.transform(letters, lambda x, p: F.struct(x.alias("edit"), (p - F.length(F.translate(F.substring(audit, F.lit(1), p), "KRD", ""))).cast("int").alias("at"), F.length(F.translate(F.substring(audit, F.lit(1), p), "D", "")).alias("kept")))
    left = F.filter(steps, lambda s: s["edit"] != "D")
    first = F.get(left, F.lit(0))
    system = (start == 0) & F.coalesce((first["edit"] == "K") & (F.get(F.col("turns"), first["at"])["initial"] == "s"), F.lit(False))
    # after a system turn, or where an assistant's is due, the first place is taken already
    odd = (system | (start == 2)).cast("int")

    def line(s: Column) -> Column:
        turn = F.get(F.col("turns"), s["at"])
        due = F.when((s["kept"] + odd) % 2 == 0, "user").otherwise("assistant")
        return F.concat(F.when(s["edit"] == "K", turn["role"]).otherwise(due), F.lit(":"), F.when(s["edit"] == "I", "").otherwise(turn["text"]))

    return F.transform(left, line)


def _short(segments: DataFrame) -> DataFrame:
    """Conversations of one segment each."""
    states = F.aggregate("turns", _states(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), _none(), _none(), _none()), _next)
    done = segments.withColumn("states", states).withColumn("best", F.least("states.none", "states.assistant"))
    text = F.array_join(_repaired(F.col("best.audit"), "none"), "\n")
    return done.select("key", _gaps(F.col("least"), F.col("most"), F.col("turn_numbers")).alias("gaps"), *COUNTS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's texts, which come in order, joined by line feeds; nothing is held but the running digest."""
    now, digest, any_yet, number = None, hashlib.sha256(), False, 0
    for batch in batches:
        out: list[tuple[int, str]] = []
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if number != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest, any_yet = number, hashlib.sha256(), False
            if text:
                digest.update((b"\n" if any_yet else b"") + text.encode())
                any_yet = True
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["number", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["number", "repaired_sha256"])


def _long(segments: DataFrame) -> DataFrame:
    """Conversations of several segments: each is folded from every state, the results are combined in order, and each is repaired by its share of the audit."""
    own = written(segments, "long-conversations")
    closed = _states(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), _none(), _none(), _none())
    starts = F.when(F.col("seg") == 0, F.array(closed)).otherwise(F.array(*(_begin(s) for s in STATES)))
    table = F.transform(starts, lambda s: F.aggregate("turns", s, _next))
    part = F.struct("seg", table.alias("table"), F.size("turns").alias("size"), F.get("turns", F.lit(0)).getField("turn").alias("first_turn"), F.get("turns", F.lit(0)).getField("initial").alias("first"), F.try_element_at("turns", F.lit(-1)).getField("turn").alias("last_turn"), F.try_element_at("turns", F.lit(-1)).getField("initial").alias("last"))
    each = own.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("turn_numbers").alias("turn_numbers"), *(F.sum(c).alias(c) for c in COUNTS))
    whole = "struct<cost:bigint,audit:string,pieces:array<struct<start:int,audit:string>>>"

    def onward(states: Column, part: Column) -> Column:
        def reached(end: str) -> Column:
            ways = []
            for k, start in enumerate(STATES):
                before, after = states[start], F.get(part["table"], F.lit(k))[end]
                piece = F.array(F.struct(F.lit(k).alias("start"), after["audit"].alias("audit")))
                ways.append(F.when(before.isNotNull() & after.isNotNull(), F.struct((before["cost"] + after["cost"]).alias("cost"), F.concat(before["audit"], after["audit"]).alias("audit"), F.concat(before["pieces"], piece).alias("pieces"))))
            return F.least(*ways)

        return F.struct(*(reached(n).alias(n) for n in STATES))

    at_first = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<struct<start:int,audit:string>>").alias("pieces"))
    begin = F.struct(at_first.alias("none"), *(_none(whole).alias(n) for n in STATES[1:]))
    folded = each.withColumn("states", F.aggregate("parts", begin, onward)).withColumn("best", F.least("states.none", "states.assistant"))
    # where segments meet, a turn number may go on and roles may clash
    live = F.filter("parts", lambda p: p["size"] > 0)
    folded = folded.withColumn("live", live)
    met = F.zip_with(F.slice("live", F.lit(1), F.greatest(F.size("live") - 1, F.lit(0))), F.slice("live", F.lit(2), F.greatest(F.size("live") - 1, F.lit(0))), lambda a, b: F.struct((a["last_turn"] == b["first_turn"]).alias("on"), (~F.concat(a["last"], b["first"]).isin("su", "ua", "au")).alias("clash")))
    folded = folded.withColumn("met", met)
    count = lambda field: F.size(F.filter("met", lambda m: F.coalesce(m[field], F.lit(False))))
    # a number for each conversation, by which its segments stream in order
    done = written(folded.select("key", F.monotonically_increasing_id().alias("number"), _gaps(F.col("least"), F.col("most"), F.col("turn_numbers") - count("on")).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + count("clash")).alias("illegal"), "best"), "long-audits")
    pieces = done.select("key", "number", F.posexplode("best.pieces").alias("seg", "piece"))
    lines = own.join(pieces, ["key", "seg"]).select("number", "seg", F.array_join(_repaired(F.col("piece.audit"), F.col("piece.start")), "\n").alias("text"))
    texts = lines.repartition("number").sortWithinPartitions("number", "seg").select("number", "text").mapInArrow(_streamed, "number bigint, repaired_sha256 string")
    return done.join(texts, "number").select("key", "gaps", *COUNTS, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "repaired_sha256")


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For turns (conv_id, turn, role, text, copy, gone): conv_id, gaps, the counts of faults, cost, audit and repaired_sha256 of each conversation.

    Turns that are equal but for `copy` are repeats; a row that is `gone` has no turn but names its conversation.
    """
    key = F.struct(F.col("conv_id"))
    kept = rows.withColumns({"key": key, "role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    # role and text as one digest, to find repeats by
    kept = kept.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).select("key", "gone", "turn", "role", "text", "tie", "copy")
    large = written(kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment).select("key"), "long-keys")
    if large.isEmpty():
        return _short(faults(kept.withColumns({"seg": F.lit(0), "again": F.lit(False)}))).select("key.conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")
    short = _short(faults(kept.join(large, "key", "left_anti").withColumns({"seg": F.lit(0), "again": F.lit(False)})))
    many = placed(kept.join(large, "key", "left_semi"), "key", ("gone", "turn", "role", "tie", "copy"), "long-turns").withColumn("seg", F.floor(F.col("pos") / segment).cast("int"))
    # one row for each role and text of a segment, so even a text that fills a conversation has few rows
    held = many.filter("NOT gone").groupBy("key", "tie", "seg").agg(F.lit(True).alias("again"))
    first = held.groupBy("key", "tie").agg(F.min("seg").alias("first"))
    later = held.join(first, ["key", "tie"]).filter("seg > first").drop("first")
    marked = many.join(later, ["key", "tie", "seg"], "left").withColumn("again", F.coalesce("again", F.lit(False)) & ~F.col("gone"))
    return short.unionByName(_long(faults(marked))).select("key.conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with seeded damage, for tests of the repair: by crc32 of `conv_id:turn` a row goes, loses its text or its
    full stops, is repeated, or gets the role user. Rows that go stay as `gone`."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(d == 1, "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (d == 0).alias("gone"), d.alias("d"))
    return own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("d") == 3, 1).otherwise(0)))).drop("d")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
#: The same edits as a search, turn by turn: states and what leads to them are rows, and the least of each stays.
ORACLE = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE d <> 0),
o AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS ini,
             lag(left(role, 1)) OVER w AS ini0, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy)),
f AS (SELECT *, t = '' OR dup AS dead, t <> '' AND NOT dup AND right(t, 1) NOT IN ('.', '!', '?') AS trunc FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM o)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE t = '') AS blank, count(*) FILTER (WHERE t <> '' AND dup) AS duplicate,
             count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE ini0 IS NOT NULL AND ini0 || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m FROM f GROUP BY conv_id),
ins(a, b, cost, letters, turns) AS (VALUES ('0', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']), ('0', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])),
s AS (
  SELECT conv_id, 0::BIGINT AS i, m, b AS st, {{'cost': cost::BIGINT, 'audit': letters, 'out': turns}} AS v FROM n, (SELECT '0' AS b, 0 AS cost, '' AS letters, []::VARCHAR[] AS turns UNION ALL SELECT b, cost, letters, turns FROM ins WHERE a = '0')
  UNION ALL
  SELECT conv_id, i, m, st, min(v) FROM (
    SELECT conv_id, i, m, coalesce(ins.b, st) AS st, CASE WHEN ins.a IS NULL THEN v ELSE {{'cost': v.cost + ins.cost, 'audit': v.audit || ins.letters, 'out': list_concat(v.out, ins.turns)}} END AS v
    FROM (SELECT s.conv_id, f.i, s.m, e.st, {{'cost': s.v.cost + e.cost, 'audit': s.v.audit || e.letter, 'out': CASE WHEN e.role IS NULL THEN s.v.out ELSE list_append(s.v.out, e.role || ':' || f.text) END}} AS v
          FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1,
          LATERAL (SELECT unnest([
            {{'st': s.st, 'cost': 4, 'letter': 'D', 'role': NULL, 'ok': true}},
            {{'st': 's', 'cost': CASE WHEN trunc THEN 3 ELSE 0 END, 'letter': 'K', 'role': f.role, 'ok': NOT dead AND ini = 's' AND s.st = '0'}},
            {{'st': 'u', 'cost': CASE WHEN trunc THEN 3 ELSE 0 END, 'letter': 'K', 'role': f.role, 'ok': NOT dead AND ini = 'u' AND s.st <> 'u'}},
            {{'st': 'u', 'cost': CASE WHEN trunc THEN 6 ELSE 3 END, 'letter': 'R', 'role': 'user', 'ok': NOT dead AND s.st <> 'u'}},
            {{'st': 'a', 'cost': CASE WHEN trunc THEN 3 ELSE 0 END, 'letter': 'K', 'role': f.role, 'ok': NOT dead AND ini = 'a' AND s.st = 'u'}},
            {{'st': 'a', 'cost': CASE WHEN trunc THEN 6 ELSE 3 END, 'letter': 'R', 'role': 'assistant', 'ok': NOT dead AND s.st = 'u'}}], recursive := true)) e WHERE e.ok)
    LEFT JOIN (SELECT * FROM ins UNION ALL SELECT NULL, NULL, 0, '', []) ins ON ins.a IS NULL OR ins.a = st) GROUP BY conv_id, i, m, st)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(array_to_string(v.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN (SELECT conv_id, min(v) AS v FROM s WHERE i = m AND st IN ('0', 'a') GROUP BY conv_id) b ON b.conv_id IS NOT DISTINCT FROM q.conv_id
"""
