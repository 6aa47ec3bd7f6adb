"""Name matching, renumbering and span labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce
from operator import add, mul

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quartier.operators.relational import latest_per_key, once_per_value, spread
from quartier.sources.tables import shared_path


def cascade_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, steps: Sequence[tuple[Column, Column]]) -> DataFrame:
    """The right row of each left one by the first step that has any, of several the one of least id; `step` from 1.

    Each step is an equality of an expression of the left and one of the right table; all steps go through one hash join,
    on the step's number and value. Null values match nothing. Left rows without a match are left out.
    """
    keys = lambda cols: F.inline(F.array(*[F.struct(F.lit(i).alias("step"), c.alias("value")) for i, c in enumerate(cols, 1)]))
    a = left.select(left_id, keys([x for x, _ in steps])).filter("value IS NOT NULL")
    b = right.select(right_id, keys([y for _, y in steps])).groupBy("step", "value").agg(F.min(right_id).alias(right_id))
    return latest_per_key(a.join(b, ["step", "value"]), [left_id], [F.col("step")]).select(left_id, right_id, "step")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased text with two spaces before and one behind."""
    # the text is bound, or what it is derived by would run again for each trigram
    all_of = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3))))
    return F.get(F.transform(F.array(F.concat(F.lit("  "), F.lower(c), F.lit(" "))), all_of), F.lit(0))


#: Similarities that the search for the most similar may go down by, round by round, and the pairs of names that a round may meet at least, and for each name; all decide on the work alone, not on what is found.
BOUNDS, PAIRS, PAIRS_EACH = (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0), 1 << 19, 64
#: Trigrams that two names meet by at most where a single one would meet too many, and the pairs that a name's entry for such a combination costs as much as.
TOGETHER, ENTRY = 3, 8


def trigram_top1(left: DataFrame, right: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """For each left (id, name) the right (id, name) of most similar trigrams, ties by id; only names that share one meet.

    Tables of three columns have a version between, and only names of one version meet. Left names of equal trigrams are a class that is looked up once, and of right ones those of the two least ids
    stand for all, as the best two ids of a class hold the best other id of each of its members. Trigrams are ordered from rare to frequent. A round finds all pairs of at
    least its similarity by the few rare trigrams that such pairs must share; a class that has its two, or one that isn't an id of its own, is done, whatever less similar ones there are, and only the others go
    on to the next round. A round goes down to the least similarity at which the classes that are left meet few names by single trigrams; where that is none, to the next one, and names meet by up to TOGETHER
    trigrams at once, which hardly any but similar ones share. So frequent trigrams are met by names alone that nothing resembles.
    """
    spark = left.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    a, b = (x if len(x.columns) == 3 else x.toDF("id", "n").select("id", F.lit(0).alias("v"), "n") for x in (left, right))
    plain = lambda x: x.toDF("id", "v", "n").select("id", "v", F.array_sort(trigrams(F.col("n"))).alias("t")).filter("id IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL")
    # names may be derived by many steps, which run once
    a, b = plain(written(a.toDF("id", "v", "n"), "left-names")), plain(written(b.toDF("id", "v", "n").distinct(), "right-names"))
    b = b.distinct().withColumn("rn", F.row_number().over(W.partitionBy("v", "t").orderBy("id"))).filter("rn <= 2").drop("rn")
    classes = written(a.select("v", "t").distinct().withColumn("c", F.monotonically_increasing_id()), "trigram-classes")
    members = written(a.join(classes.hint("merge"), ["v", "t"]).select("c", "id").distinct(), "trigram-members")
    sides = classes.select(F.lit(0).alias("side"), F.col("c").alias("id"), "v", "t").unionByName(b.select(F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), "v", "t"))
    # a right id may have several names, so the table's rows are told apart by a number
    sides = written(sides.withColumn("row", F.monotonically_increasing_id()), "trigram-sides")
    tokens = sides.select("row", "side", "id", "v", F.explode("t").alias("g"))
    ranks = numbered(tokens.filter("side = 1").groupBy("v", "g").agg(F.count(F.lit(1)).alias("n")), "n", "v", "g", name="at").select("v", "g", F.col("at").cast("int").alias("at"))
    # trigrams that no right name has are the rarest; they count in the size alone
    ordered = tokens.join(ranks, ["v", "g"], "left").groupBy("row", "side", "id", "v").agg(F.count(F.lit(1)).cast("int").alias("size"), F.array_sort(F.collect_list("at")).alias("t"))
    sets = written(ordered.filter(F.size("t") > 0), "trigrams")
    open_, others, found = sets.filter("side = 0").drop("side", "row"), sets.filter("side = 1").drop("side", "row"), None
    rest, n_open, n_others = list(bounds), open_.count(), others.count()
    while found is None or (rest and n_open):
        if n_open * n_others <= PAIRS // 16:
            bound, together = rest[-1], 1
        else:
            met, few = _met_by_one(open_, others, rest), max(PAIRS, PAIRS_EACH * (n_open + n_others))
            bound, together = next(((r, 1) for r, n in zip(rest[::-1], met[::-1], strict=True) if n <= few), (rest[0], 0))
            together = together or _together(sets, _least(bound), met[0])
        rest = rest[rest.index(bound) + 1 :]
        scored = _alike(open_, others, bound, together).groupBy("c", "match").agg(F.max("score").alias("score"))
        best = scored.withColumn("rn", F.row_number().over(W.partitionBy("c").orderBy(F.desc("score"), "match"))).filter("rn <= 2")
        if bound > 0:
            best = written(best, "trigram-matches")
            first = best.filter("rn = 1").select("c", F.col("match").alias("id"))
            alone = first.join(members.hint("merge"), ["c", "id"], "left_anti").select("c")
            done = best.filter("rn = 2").select("c").unionByName(alone).distinct()
            best, open_ = best.join(done, "c", "left_semi"), written(open_.join(done.withColumnRenamed("c", "id"), "id", "left_anti"), "trigrams-open")
            n_open = open_.count()
        found = best if found is None else found.unionByName(best)
    each = members.join(found.hint("merge"), "c").filter(F.col("id") != F.col("match"))
    return latest_per_key(each, ["id"], [F.desc("score"), F.col("match")]).select("id", "match", "score")


def _least(bound: float) -> float:
    """What a similarity is at least that rounds to the bound, as scores are compared as rounded ones."""
    return max(bound - 2e-6, 0.0)


def _need(size: Column, least: float) -> Column:
    """Trigrams that a set of a size shares with any that is so similar; also the least size of such a one."""
    return F.greatest(F.lit(1), F.ceil(size * least - 1e-9)).cast("int")


def _prefix(least: float, together: int = 1) -> Column:
    """How many of a row's trigrams, from the rarest, hold `together` of those that it shares with any that is so similar."""
    return F.greatest(F.lit(0), F.least(F.size("t"), F.size("t") - _need(F.col("size"), least) + together))


def _met_by_one(open_: DataFrame, others: DataFrame, bounds: Sequence[float]) -> list[float]:
    """Pairs of rows that meet by single trigrams, for each bound."""

    def counted(df: DataFrame, side: str) -> DataFrame:
        each = df.select("size", "t", F.posexplode("t").alias("i", "g"))
        # a lower bound's prefix holds that of a higher one
        first = reduce(add, [(F.col("i") >= _prefix(_least(b))).cast("int") for b in bounds])
        return each.groupBy("g", first.alias(f"{side}k")).agg(F.count(F.lit(1)).cast("double").alias(f"{side}n"))

    both = counted(open_, "x").join(counted(others, "y"), "g").groupBy(F.greatest("xk", "yk").alias("k")).agg(F.sum(F.col("xn") * F.col("yn")).alias("n")).collect()
    return [sum(r.n for r in both if r.k <= k) for k in range(len(bounds))]


def _together(sets: DataFrame, least: float, met: float) -> int:
    """As many trigrams for names to meet by as cost less to write down than the pairs that single ones meet."""
    entries = {k: reduce(mul, [F.greatest(_prefix(least, k) - i, F.lit(0)).cast("double") / (i + 1) for i in range(k)]) for k in range(1, TOGETHER + 1)}
    n = sets.agg(*[F.sum(e) for e in entries.values()]).first()
    return max([k for k, x in zip(entries, n, strict=True) if ENTRY * (x or 0) <= met], default=1)


def _combinations(t: Column, k: int) -> Column:
    """Structs of a number for each choice of k places of an array, in order, and the last of the places, from 1."""
    n = F.size(t)
    after = lambda i, f: F.transform(F.slice(t, i + 1, n), f)
    entry = lambda at, *x: F.struct(F.xxhash64(F.array(*x)).alias("key"), at.cast("int").alias("at"))
    if k == 1:
        return after(F.lit(0), lambda a, i: entry(i + 1, a))
    if k == 2:
        return F.flatten(after(F.lit(0), lambda a, i: after(i + 1, lambda b, j: entry(i + j + 2, a, b))))
    return F.flatten(F.flatten(after(F.lit(0), lambda a, i: after(i + 1, lambda b, j: after(i + j + 2, lambda c, m: entry(i + j + m + 3, a, b, c))))))


def _alike(open_: DataFrame, others: DataFrame, bound: float, together: int) -> DataFrame:
    """All (c, match, score) that score the bound or more. Two rows meet by as many of their trigrams at once as `together` says, or as the smaller of them must share where that are fewer, and
    count only where these are the rarest that they share, so that each pair is compared once."""
    least = _least(bound)
    level = lambda size: F.least(F.lit(together), _need(size, least))

    def entries(df: DataFrame) -> DataFrame:
        low, high = level(_need(F.col("size"), least)), level(F.col("size"))
        some = [F.when((low <= k) & (high >= k), _combinations(F.slice("t", F.lit(1), _prefix(least, k)), k)).otherwise(F.array().cast("array<struct<key:bigint,at:int>>")) for k in range(1, together + 1)]
        return df.select("id", "v", "size", "t", F.inline(F.concat(*some))).withColumn("after", F.size("t") - F.col("at")).drop("at")

    x = entries(open_).toDF("c", "v", "na", "ta", "key", "pa")
    y = entries(others).toDF("match", "v", "nb", "tb", "key", "pb")
    by, total = level(F.least("na", "nb")), F.col("na") + F.col("nb")
    may = x.join(y.hint("merge"), ["v", "key"]).filter(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9).filter(by + F.least("pa", "pb") >= least / (1 + least) * total - 1e-9)
    shared = F.array_intersect("ta", "tb")
    enough = lambda s: F.size(s) >= least / (1 + least) * total - 1e-9
    if together > 1:  # where most pairs share too few, a filter of its own is faster
        may = may.filter(enough(shared))
    fits = lambda s: enough(s) & (F.xxhash64(F.slice(s, F.lit(1), by)) == F.col("key"))
    # what is shared is bound, and goes through a generator, or it would be worked out again for each use
    score = F.filter(F.transform(F.array(shared), lambda s: F.when(fits(s), F.round(F.size(s) / (total - F.size(s)), 6))), lambda x: (x >= bound) & (x > 0))
    return may.select("c", "match", F.explode(score).alias("score"))


def jaccard_join(df: DataFrame, id_: str, tokens: str, percent: int, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) of rows, a < b, whose token sets have a Jaccard similarity of at least `percent` of a hundred; with `by`, only rows that agree in these columns.

    Rows of equal sets are a class, and classes are compared instead of rows; what similar ones stand for is dealt out last, so the work beyond that follows the number of different sets. Tokens
    are ordered from rare to frequent, and classes meet only by the tokens of the prefix that similar sets must share, and only if their sizes allow it.
    """
    rows = df.filter(F.size(tokens) > 0).select(F.col(id_).alias("id"), *by, F.array_sort(F.array_distinct(tokens)).alias("t"))
    rows = rows.dropna(subset=["id", *by])
    classes = rows.select(*by, "t").distinct()
    # an id may stand for several sets, so a class has a number of its own
    path = shared_path(df.sparkSession, "classes")
    numbered_ = classes.withColumn("c", F.monotonically_increasing_id())
    numbered_.write.parquet(path)
    classes = df.sparkSession.read.schema(numbered_.schema).parquet(path).select("c", *by, "t")
    members = rows.join(classes.hint("merge"), [*by, "t"]).select("id", "c").distinct()
    pairs = _similar_sets(classes, percent, by)
    own, other = members.toDF("x", "a"), members.toDF("y", "b")
    same = own.join(other.hint("merge"), F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    near = pairs.join(own.hint("merge"), "a").join(other.hint("merge"), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def _similar_sets(classes: DataFrame, percent: int, by: Sequence[str]) -> DataFrame:
    """Pairs (a, b), a < b, of classes (c, by, t) with similar sets; t has no token twice."""
    each = classes.select("c", *by, F.explode("t").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # the order goes with each token as a struct, so that sorting a set is sorting an array
    ordered = each.join(counts, "token").groupBy("c", *by).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))
    n = F.size("s")
    ordered = ordered.select("c", *by, F.col("s.token").alias("s"), n.alias("size"), (n - F.ceil(n * percent / 100).cast("int") + 1).alias("prefix"))
    listed = ordered.select("c", *by, "size", F.posexplode(F.slice("s", F.lit(1), F.col("prefix"))).alias("at", "token"))
    a, b = (listed.select(F.col("c").alias(x), *by, F.col("size").alias(f"n{x}"), F.col("at").alias(f"p{x}"), "token") for x in "ab")
    need = (percent * (F.col("na") + F.col("nb")) / (100 + percent))
    ahead = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + F.least("pa", "pb")
    met = a.join(b, [*by, "token"]).filter("a < b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (ahead >= need - 1e-9)).select("a", "b").distinct()
    sets = ordered.select("c", "s", "size")
    full = met.join(sets.toDF("a", "sa", "na"), "a").join(sets.toDF("b", "sb", "nb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """`number` from 1 in an order that tells all rows apart, without a window over all rows: rows are dealt by ranges, as a sample of them cuts them, and written in order; before each
    part stand the rows of the parts before, of which there is one count each."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    path = shared_path(df.sparkSession, "numbered")
    dealt.write.parquet(path)
    own = df.sparkSession.read.schema(dealt.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = own.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = before.select("__part", "__first", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return own.join(before, "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).drop("__at", "__part", "__first", "__before")


def remap_duplicates(df: DataFrame, row: str, key: Sequence[str]) -> DataFrame:
    """The least row of a key keeps its id as `new_id`; all others get new ids after the largest, in order of their own."""
    ranked = df.select(row, F.row_number().over(W.partitionBy(*key).orderBy(row)).alias("rn"))
    top = F.broadcast(df.agg(F.coalesce(F.max(row), F.lit(0)).alias("__top")))
    losers = numbered(ranked.filter("rn > 1"), row).crossJoin(top).select(row, (F.col("number") + F.col("__top")).alias("new_id"))
    return ranked.filter("rn = 1").select(row, F.col(row).cast("long").alias("new_id")).unionByName(losers)


SPANS = "array<struct<start:int,end:int,label:string,span:string>>"


def _free(spans: Column, start: Column, end: Column) -> Column:
    return ~F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def span_labels(df: DataFrame, text: str, patterns: Sequence[tuple[str, str, int]]) -> DataFrame:
    """A row for each labelled span: start (from 0), end, label and text.

    Patterns (label, regex, group) go by priority; each labels the first of its matches whose group overlaps no span labelled before. A match lies where the
    pattern found it, anchors and look-around included; its group is looked for inside it.
    """
    out = df.withColumn("__spans", F.array().cast(SPANS))
    for label, regex, group in patterns:
        runs = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
        out = out.withColumns({"__runs": runs, "__own": F.regexp_extract_all(text, F.lit(regex), F.lit(group)), "__gaps": F.split(text, regex)})
        before = lambda i: F.aggregate(F.slice("__gaps", F.lit(1), i + 1), F.lit(0), lambda n, g: n + F.length(g)) + F.aggregate(F.slice("__runs", F.lit(1), i), F.lit(0), lambda n, r: n + F.length(r))

        def span(own: Column, i: Column) -> Column:
            start = (before(i) + F.instr(F.get("__runs", i), own) - 1).cast("int")
            return F.struct(start.alias("start"), (start + F.length(own)).alias("end"), F.lit(label).alias("label"), own.alias("span"))  # noqa: B023

        out = out.withColumn("__found", F.filter(F.transform("__own", span), lambda s: (F.length(s["span"]) > 0) & _free(F.col("__spans"), s["start"], s["end"])))
        out = out.withColumn("__spans", F.when(F.size("__found") > 0, F.array_append("__spans", F.get("__found", F.lit(0)))).otherwise(F.col("__spans")))
    return out.select(*df.columns, F.inline("__spans"))


def free_occurrences(text: Column, items: Column) -> Column:
    """Spans of labelled texts (an array of label, text) in a text: each item, in order, at the first place where it stands and overlaps none before; items that
    don't stand in it, or are empty, have none."""

    def place(spans: Column, item: Column) -> Column:
        n = F.length(item["text"])

        def tried(at: Column, _: Column) -> Column:
            # where an item overlaps a span, so does every place up to the span's end
            over = F.get(F.filter(spans, lambda s: (s["start"] < at - 1 + n) & (at - 1 < s["end"])), F.lit(0))
            return F.when((at == 0) | over.isNull(), at).otherwise(F.call_function("locate", item["text"], text, over["end"] + 1))

        first = F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.instr(text, item["text"]), tried)
        at = F.get(F.transform(F.array(first), lambda x: F.when((x > 0) & (n > 0), x)), F.lit(0))
        new = F.struct((at - 1).alias("start"), (at - 1 + n).alias("end"), item["label"].alias("label"), item["text"].alias("span"))
        return F.when(at.isNull(), spans).otherwise(F.array_append(spans, new))

    return F.aggregate(items, F.array().cast(SPANS), place)


def converted(addresses: DataFrame, mappings: DataFrame, id_: str, address: str, matches: DataFrame) -> DataFrame:
    """The table with `converted`, `n_applied` and `confidence`: every old name that the address holds, in any case, replaced by its new one, newest mapping first.

    mappings: mapping, old_name, new_name, since; matches: (id_, mapping), as a join on contained names gives them. Mappings that change nothing don't count.
    """
    m = mappings.filter("lower(old_name) <> lower(new_name)").select("mapping", F.struct(F.unix_timestamp("since").alias("since"), F.col("mapping").alias("mapping"), F.col("old_name").alias("old"), F.col("new_name").alias("new")).alias("m"))
    own = matches.join(m, "mapping").groupBy(id_).agg(F.sort_array(F.collect_list("m"), False).alias("__m"))
    quoted = lambda x: F.concat(F.lit("(?iu)\\Q"), x, F.lit("\\E"))
    literal = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    text = F.aggregate("__m", F.col(address), lambda a, x: F.regexp_replace(a, quoted(x["old"]), literal(x["new"])))
    out = addresses.join(own, id_, "left").withColumn("n_applied", F.when(F.col("__m").isNull(), 0).otherwise(F.size("__m")))
    return out.withColumn("converted", F.when(F.col("n_applied") > 0, text).otherwise(F.col(address))).withColumn("confidence", F.when(F.col("n_applied") > 0, 0.85).otherwise(0.3)).drop("__m")


def best_candidate(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, best, ratio): of a query's candidates (query_id, candidate) the one most like it by matcher_ratio, ties by text; the query itself and 0 where it has none.

    queries: query_id, text.
    """
    scored = with_ratio(queries.join(candidates, "query_id"), "text", "candidate").groupBy("query_id").agg(F.max(F.struct("ratio", "candidate")).alias("m"))
    return queries.join(scored, "query_id", "left").select("query_id", F.coalesce("m.candidate", "text").alias("best"), F.coalesce(F.round("m.ratio", 6), F.lit(0.0)).alias("ratio"))


def with_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """The table with `ratio`, the matcher_ratio of two of its columns, which is worked out once for equal pairs of texts."""
    return once_per_value(df, [a, b], lambda pairs: spread(pairs, a).withColumn("ratio", matcher_ratio(F.col(a), F.col(b))))


@F.pandas_udf(DoubleType())
def matcher_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matched characters over all, by difflib's longest matching blocks; of a null 0."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")
