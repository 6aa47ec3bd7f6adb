"""Substring dedup, Merkle manifest and conversation repair against brute force, on nulls, ties, repeated rows, long and empty texts, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quartier.llm import merkle, repair, substrings
from quartier.llm.ordering import placed

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- substring dedup ---


def passages_table():
    r = random.Random(2)
    vocabulary = [f"w{i}é" for i in range(400)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [line(n) for n in (19, 20, 21, 25, 33, 60)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, " \n\t")]
    for i in range(4, 100):
        t = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(shared)
            t += line(r.randint(0, 30)) + p[r.randint(0, 2) :]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(t)))
    rows += [(200, rows[50][1]), (201, " ".join(["same"] * 100)), (202, "\n".join(" ".join(line(9)) for _ in range(4000))), (203, rows[51][1].upper())]
    # nulls and repeats in doc_id, and rows that repeat whole
    return rows + [(None, rows[52][1]), (None, rows[52][1]), (None, " ".join(line(30))), (60, rows[53][1]), (60, rows[60][1])]


def kept_words(texts, window=substrings.WINDOW):
    """Of texts in order: words, removed words and what is left."""
    seen, out = set(), []
    for t in texts:
        w, gone = WORD.findall(t or ""), set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone |= set(range(p, p + window))
            seen.add(k)
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup(spark):
    rows = passages_table()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id bigint, text string, __row string, n_removed string, at string").repartition(6)
    got = substrings.dedup_substrings(docs)
    assert got.columns == ["doc_id", "text", "__row", "at", "n_words", "n_removed", "removed"]
    # rows of one doc_id come in the order of their hash, equal rows in any
    order = {(x.doc_id, x.text): x.h for x in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    inside = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, order[x]))
    want = sorted((str(i), *k) for (i, t), k in zip(inside, kept_words([t for _, t in inside]), strict=True))
    found = got.collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.text or "") for x in found) == want
    assert all(x.at == "c" and x["__row"] == "a" and x.n_removed == sum(r.end - r.start for r in x.removed) for x in found)
    assert sum(x.text is None for x in found) == 1
    assert sum(n for _, _, n, _ in want) > 3000


@pytest.mark.parametrize("window, period", [(20, 7), (20, 20), (8, 5), (3, 1)])
def test_substring_dedup_of_other_windows(spark, window, period, monkeypatch):
    """Other covers, and tasks that pass on what they hold again and again."""
    monkeypatch.setattr(substrings, "HELD", 500)
    rows = [x for x in passages_table() if x[0] is not None and x[0] not in (60, 202)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), window, period)
    want = dict(zip([i for i, _ in sorted(rows)], kept_words([t for _, t in sorted(rows)], window), strict=True))
    assert {x.doc_id: (x.n_words, x.n_removed, x.text or "") for x in got.collect()} == want


def test_difference_covers():
    for period in range(1, 16):
        cover = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(substrings.difference_cover(13)) == 4


def test_substring_dedup_of_an_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_substring_query(spark, sf_dir):
    from quartier.llm.registry import QUERIES

    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, gone, sha(t)) for (i, _), (n, gone, t) in zip(sorted(rows), kept_words([t for _, t in sorted(rows)]), strict=True)}
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in QUERIES["op11_substring_dedup"](spark, sf_dir).collect()} == want
    assert any(gone for _, gone, _ in want.values())


# --- Merkle manifest ---


def one_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest_rows(rows):
    """By brute force, from rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, one_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = one_leaf((*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))) if tampered else leaf
            siblings = []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run, own = level[at // 8 * 8 :][:8], at % 8
                    siblings += run[:own] + run[own + 1 :]
                    node, at = sha("".join([*run[:own], node, *run[own + 1 :]])), at // 8
            out.append((str(r[0]), leaf, trees[g][-1][0], top[-1][0], sha("".join(siblings)), node, node == top[-1][0]))
    return sorted(out)


def manifest_table():
    r = random.Random(4)
    rows = [(i, r.choice(["s", None, "é"]), r.choice(["en"] * 9 + ["de", None, "", "fr"]), r.choice([None, i]), r.choice([None, "", "Text É", "text", "A b C", "x" * 40000])) for i in range(300)]
    return rows + [(7, "s", "en", 1, "twice"), (7, "s", "en", 1, "twice"), (7, "s", "en", 2, "other"), (None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 3, "t"), (900, "s", "xx", 1, "Alone")]


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest(spark, levels):
    """Blocks of 8 and 64 nodes need several rounds."""
    rows = manifest_table()
    docs = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, leaf string, pos string").repartition(5)
    got = merkle.manifest(merkle.document_leaves(docs), levels)
    assert got.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((str(x[0]), *x[1:]) for x in got.collect())
    assert got == manifest_rows(rows)
    assert 0 < sum(not x[-1] for x in got) < len(got)


def test_manifest_of_small_tables(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert merkle.manifest(merkle.document_leaves(spark.createDataFrame([], schema))).collect() == []
    rows = [(5, "s", None, 1, "only")]
    got = merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, schema))).collect()
    assert [(str(x[0]), *x[1:]) for x in got] == manifest_rows(rows)
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == sha("")


def test_many_groups(spark):
    """More groups than a block holds."""
    rows = [(i, "s", f"l{i % 90}", i, "T") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert sorted((str(x[0]), *x[1:]) for x in merkle.manifest(merkle.document_leaves(docs), 1).collect()) == manifest_rows(rows)


def test_places_in_groups(spark):
    rows = [(g, v) for g in ("a", None, "b") for v in [None, *range(50), 7, 7]]
    got = placed(spark.createDataFrame(rows, "g string, v int").repartition(7), "g", ("v",), "t").collect()
    for g in ("a", "b"):
        own = sorted((x for x in got if x.g == g), key=lambda x: x.pos)
        assert [x.pos for x in own] == list(range(53)) and {x.n for x in own} == {53}
        assert [x.v for x in own] == [None, *sorted([*range(50), 7, 7])]


# --- conversation repair ---


def is_right(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def blank(t):
    return not WORD.search(t)


def cheapest(turns):
    """All edits of a few turns, tried one by one: turns are (turn, role, text) in order."""
    dead, cut, seen = [], [], set()
    for _, role, text in turns:
        dead.append(blank(text) or (role, text) in seen)
        cut.append(not dead[-1] and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?")
        seen.add((role, text))
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    for ops in itertools.product("KDua", repeat=len(turns)):
        if any(d and o != "D" for d, o in zip(dead, ops, strict=True)):
            continue
        for gaps in itertools.product(inserts, repeat=len(turns) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(turns) + 1):
                for x in gaps[i]:
                    cost, audit = cost + 3, audit + "I"
                    out.append(("user" if x == "u" else "assistant", ""))
                if i == len(turns):
                    break
                o = ops[i]
                if o == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                cost += 3 * cut[i] + 3 * (o != "K")
                audit += "K" if o == "K" else "R"
                out.append(({"K": turns[i][1], "u": "user", "a": "assistant"}[o], turns[i][2]))
            if is_right("".join(r[:1] or " " for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    roles = [r[:1] for _, r, _ in turns]
    numbers = [n for n, _, _ in turns if n is not None]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        sum(blank(t) for _, _, t in turns),
        sum(d and not blank(t) for d, (_, _, t) in zip(dead, turns, strict=True)),
        sum(cut),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        best[0],
        best[1],
        sha(best[2]),
    )


def after_damage(rows):
    """Turns of each conversation after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own, d = out.setdefault(conv, []), zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest())
    return {c: sorted(own, key=key) for c, own in out.items()}


def turns_table(r, n_conversations, longest):
    texts = ["Hello there.", "Yes!", "No?", "and then", "", " \n ", None, "Fine. ", "é日本。", "Well.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", ""]
    out = []
    for c in range(n_conversations):
        for t in range(r.randint(0, longest)):
            out.append((c, r.choice([t, t, t, t + 3, None]), r.choice(roles), r.choice(texts)))
    return out


def test_repair(spark):
    r = random.Random(11)
    rows = turns_table(r, 70, 4) + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "Yes.")]
    rows = [x for x in rows if len(after_damage([y for y in rows if y[0] == x[0]])[x[0]]) <= 4]
    table = spark.createDataFrame([(*x, "a", "b") for x in rows], "conv_id bigint, turn bigint, role string, text string, key string, copy string").repartition(4)
    want = {c: cheapest(turns) for c, turns in after_damage(rows).items()}
    got = {x[0]: tuple(x)[1:] for x in repair.repair(repair.damaged(table)).collect()}
    assert got == want
    assert {"D", "I", "K", "R"} <= set("".join(x[6] for x in want.values()))


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_repair_of_long_conversations(spark, segment):
    """Conversations in segments are repaired as in one, and as by the SQL."""
    rows = turns_table(random.Random(segment), 25, 30) + [(None, i, "user", "Same.") for i in range(40)] + [(99, 5, "user", "Same.")] * 9
    spark_rows = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    db = duckdb.connect()
    db.register("conversations", spark_rows.toArrow())
    want = sorted(map(str, db.execute(repair.ORACLE).fetchall()))
    assert sorted(str(tuple(x)) for x in repair.repair(repair.damaged(spark_rows)).collect()) == want
    assert sorted(str(tuple(x)) for x in repair.repair(repair.damaged(spark_rows), segment).collect()) == want


def test_repair_of_an_empty_table_and_of_dropped_turns(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert repair.repair(repair.damaged(spark.createDataFrame([], schema))).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"1:{i}".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(spark.createDataFrame([(1, dropped, "user", "x")], schema))).collect()
    assert [tuple(x) for x in got] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]
    got = repair.repair(repair.damaged(spark.createDataFrame([(1, dropped + 1, "user", "word. " * 60000)], schema))).collect()
    assert (got[0].cost, got[0].audit) == (3, "KI")
