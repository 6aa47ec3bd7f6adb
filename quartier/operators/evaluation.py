"""Quality of predictions against gold answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.functions import normalize as N
from quartier.functions import parse as P

FUZZY = 0.85
# Hourly cost of a model's machine, and its cost of a million addresses where the speed isn't known.
HOURLY_COST = {"phobert": 0.85, "siamese": 0.65, "llm": 5.50}
DEFAULT_COST = {"phobert": 42.0, "siamese": 28.0, "llm": 260.0}


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 where total is 0."""
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def harmonic(a: Column, b: Column) -> Column:
    return ratio(2 * a * b, a + b)


def component_counts(pred: Column, gold: Column, strict: bool = False) -> tuple[Column, Column, Column]:
    """True positives, false positives and false negatives of a component, null or empty for a missing one.

    A wrong value counts as a false negative alone; strict counts it as a false positive too.
    """
    p, g = (F.coalesce(x, F.lit("")) for x in (pred, gold))
    false_positive = ((g == "") | F.lit(strict)) & (p != "") & (p != g)
    return F.count_if((g != "") & (p == g)), F.count_if(false_positive), F.count_if((g != "") & (p != g))


def component_metrics(df: DataFrame, levels: dict[str, tuple[Column, Column]], strict: bool = False) -> DataFrame:
    """Counts, precision, recall and F1 of each level from its prediction and truth. One pass: rows become a row for each level, counted
    before they are shuffled."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("level"), p.alias("p"), g.alias("g")) for n, (p, g) in levels.items()])))
    return component_f1(long, ["level"], "p", "g", strict)


def component_f1(rows: DataFrame, group: list[str], pred: str, gold: str, strict: bool = False) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 by group; all rows are one where no group is named."""
    tp, fp, fn = component_counts(F.col(pred), F.col(gold), strict)
    n = rows.groupBy(*group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(harmonic(p, r), 4)})


def address_levels(rows: DataFrame, pred: str, gold: str, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each level of each pair of addresses: `level`, and `pred` and `gold` as they are compared."""
    p, g = P.components(F.col(pred)), P.components(F.col(gold))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), N.metric_text(p[k]).alias("pred"), N.metric_text(g[k]).alias("gold")) for k in P.LEVELS])
    return rows.select(*keep, F.explode(levels).alias("l")).select(*keep, "l.*")


def component_f1_by_stratum(rows: DataFrame, pred: str, gold: str, stratum: str, strict: bool = False) -> DataFrame:
    """component_f1 by stratum and level; blank strata are UNLABELED."""
    named = rows.withColumn("stratum", F.coalesce(F.nullif(F.trim(stratum), F.lit("")), F.lit("UNLABELED")))
    return component_f1(address_levels(named, pred, gold, ["stratum"]), ["stratum", "level"], "pred", "gold", strict)


def exact_match(rows: DataFrame, pred: str, refs: Sequence[str]) -> DataFrame:
    """Rows, and for each reference column the share in percent that the prediction equals (composed, white space collapsed)."""
    p = N.exact_text(F.col(pred))
    shares = [F.round(100 * ratio(F.count_if(p == N.exact_text(F.col(r))).cast("double"), F.count(F.lit(1))), 4).alias(f"em_{r}_pct") for r in refs]
    return rows.agg(F.count(F.lit(1)).alias("n_samples"), *shares)


def component_accuracy(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """By level, the share of gold components that the prediction has; only rows whose gold address has the component count."""
    n = address_levels(rows, pred, gold).groupBy("level").agg(F.count_if(F.col("gold") != "").alias("n_gold"), F.count_if((F.col("gold") != "") & (F.col("pred") == F.col("gold"))).alias("n_hit"))
    return n.withColumn("accuracy", F.round(ratio(F.col("n_hit"), F.greatest("n_gold", F.lit(1))), 4))


def proxy_scores(rows: DataFrame, exact: str, ratio_column: str, model: str, latency: str) -> DataFrame:
    """By model: exact and fuzzy rates, their harmonic mean, addresses a second, and the cost of a million addresses."""
    g = rows.groupBy(model).agg(F.avg(F.col(exact).cast("int")).alias("exact_rate"), F.avg((F.col(ratio_column) >= FUZZY).cast("int")).alias("fuzzy_rate"), F.avg(latency).alias("ms"))
    speed = ratio(F.lit(1000.0), F.coalesce("ms", F.lit(0.0)))
    hourly, default = (F.create_map(*[F.lit(v) for pair in d.items() for v in pair]) for d in (HOURLY_COST, DEFAULT_COST))
    cost = F.when(speed > 0, F.try_element_at(hourly, F.col(model)) / speed * 1e6 / 3600).otherwise(F.try_element_at(default, F.col(model)))
    return g.select(model, F.round("exact_rate", 4).alias("exact_rate"), F.round("fuzzy_rate", 4).alias("fuzzy_rate"), F.round(harmonic(F.col("exact_rate"), F.col("fuzzy_rate")), 4).alias("f1_proxy"), F.round(speed, 4).alias("throughput"), F.round(cost, 4).alias("cost_per_million"))


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Top-1, recall at k, mean reciprocal rank and NDCG at k from (query_id, rank, relevant), ranks from 1."""
    hit = F.when(F.col("relevant"), F.col("rank"))
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    one = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.min(hit).alias("first"), F.sum(gain).alias("dcg"), F.count_if("relevant").cast("int").alias("n"))
    ideal = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return one.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 4).alias("top1"),
        F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 4).alias("recall_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(ratio(F.col("dcg"), ideal)), 4).alias("ndcg_k"),
    )


def entities(tags: Column) -> Column:
    """Spans (start, end, label) of an array of B-, I- and O tags: a span starts at a B, or at an I that doesn't go on from its own label."""
    kind = "struct<spans:array<struct<start:int,end:int,label:string>>,open:boolean,start:int,label:string,before:string,i:int>"
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    plain = F.transform(tags, lambda t: F.struct(F.coalesce(t.startswith("B-"), F.lit(False)).alias("b"), F.coalesce(t == "O", F.lit(True)).alias("o"), F.when(t == "O", "").otherwise(F.coalesce(F.substring(t, 3, 1000), F.lit(""))).alias("own")))

    def closed(s: Column) -> Column:
        return F.array_append(s["spans"], F.struct(s["start"].alias("start"), s["i"].alias("end"), s["label"].alias("label")))

    def step(s: Column, t: Column) -> Column:
        # one pass: the span that is open, if any, ends where another starts or at a tag without a label
        starts = ~t["o"] & (t["b"] | (s["i"] == 0) | (t["own"] != s["before"]))
        ends = s["open"] & (starts | (t["own"] == ""))
        spans, start, label = F.when(ends, closed(s)).otherwise(s["spans"]), F.when(starts, s["i"]).otherwise(s["start"]), F.when(starts, t["own"]).otherwise(s["label"])
        return F.struct(spans.alias("spans"), (starts | (s["open"] & ~ends)).alias("open"), start.alias("start"), label.alias("label"), t["own"].alias("before"), (s["i"] + 1).alias("i")).cast(kind)

    first = F.struct(empty.alias("spans"), F.lit(False).alias("open"), F.lit(0).alias("start"), F.lit("").alias("label"), F.lit("").alias("before"), F.lit(0).alias("i")).cast(kind)
    return F.coalesce(F.aggregate(plain, first, step, lambda s: F.when(s["open"], closed(s)).otherwise(s["spans"])), empty)


def tagging_scores(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Token accuracy, and precision, recall and F1 of whole entities, over all rows of two tag arrays of one length."""
    same = F.size(F.filter(F.zip_with(gold, pred, lambda x, y: x == y), lambda z: z))
    e = rows.select(F.size(gold).alias("n"), same.alias("same"), entities(F.col(gold)).alias("g"), entities(F.col(pred)).alias("p"))
    s = e.agg(F.sum("n").alias("n_tokens"), F.sum("same").alias("same"), F.sum(F.size("g")).alias("gold"), F.sum(F.size("p")).alias("pred"), F.sum(F.size(F.array_intersect("g", "p"))).alias("hit"))
    p, r = ratio(F.col("hit"), F.col("pred")), ratio(F.col("hit"), F.col("gold"))
    return s.select("n_tokens", F.round(ratio(F.col("same"), F.col("n_tokens")), 6).alias("token_accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(harmonic(p, r), 6).alias("f1"))
