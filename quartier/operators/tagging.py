"""Token tags, spans and labelled components of addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartier.operators.labeller import let

# Labels in the order in which components are tagged, and names that other models give to labels.
PRIORITY = ("NUM", "STR", "NHB", "WDS", "DST", "PRO", "BLD", "POI", "ALY", "PCD")
LABEL_NAMES = {"STREET": "STR", "WARD": "WDS", "DISTRICT": "DST", "PROVINCE": "PRO"}
_WORDS = "array<struct<word:string,start:int,end:int>>"


def words(text: Column) -> Column:
    """Words between white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def weak_tags(text: Column, components: Column) -> Column:
    """Tags of a text's words from a map of label to component: each component, by PRIORITY, tags the first place where its words stand, in any case.

    Later components overwrite earlier ones where they overlap; a component that doesn't stand in the text tags nothing.
    """

    def tagged(x: Column) -> Column:
        items = F.filter(F.transform(F.array(*map(F.lit, PRIORITY)), lambda k: F.struct(k.alias("label"), F.transform(words(F.try_element_at(x["c"], k)), lambda w: F.lower(w)).alias("w"))), lambda c: F.size(c["w"]) > 0)

        def tag(acc: Column, c: Column) -> Column:
            n = F.size(c["w"])
            stands = F.transform(x["w"], lambda w, i: (w == F.get(c["w"], F.lit(0))) & (F.slice(x["w"], i + 1, n) == c["w"]))
            laid = lambda at: F.transform(acc, lambda t, i: F.when(i == at, F.concat(F.lit("B-"), c["label"])).when((i > at) & (i < at + n), F.concat(F.lit("I-"), c["label"])).otherwise(t))
            return let(F.array_position(stands, True).cast("int") - 1, lambda at: F.when(at < 0, acc).otherwise(laid(at)))

        return F.aggregate(items, F.transform(x["w"], lambda w: F.lit("O")), tag)

    # words and components are worked out once for all labels and places
    return let(F.struct(F.transform(words(text), lambda w: F.lower(w)).alias("w"), components.alias("c")), tagged)


def placed_words(text: Column) -> Column:
    """Words with where they start and end in the text."""
    gaps = F.split(F.coalesce(text, F.lit("")), r"\S+")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))

    def place(acc: Column, x: Column) -> Column:
        start = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["end"]).otherwise(0) + F.length(x["gap"])
        return F.array_append(acc, F.struct(x["word"].alias("word"), start.alias("start"), (start + F.length(x["word"])).alias("end")))

    return F.aggregate(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, w: F.struct(g.alias("gap"), w.alias("word"))), F.array().cast(_WORDS), place)


def span_tags(text: Column, spans: Column) -> Column:
    """Tags of a text's words from spans (start, end, label) of characters: a word that a span touches has its label, B- for the first such word; of several spans the first counts."""

    def tag(w: Column) -> Column:
        hit = F.get(F.filter(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])), F.lit(0))
        # the span's first word is the one that holds its start, or begins after it with only white space between
        before = F.substring(text, hit["start"] + 1, F.greatest(w["start"] - hit["start"], F.lit(0)))
        first = (hit["start"] >= w["start"]) | (F.trim(before) == "")
        return F.when(hit.isNull(), "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), hit["label"]))

    return F.transform(placed_words(text), tag)


def label_name(tag: Column) -> Column:
    """A tag's label without B- or I-, under the name that is used here; empty for none and for O."""
    bare = F.regexp_replace(F.trim(F.coalesce(tag, F.lit(""))), "^[BI]-", "")
    names = F.create_map(*[F.lit(v) for pair in LABEL_NAMES.items() for v in pair])
    return F.when(F.upper(bare) == "O", "").otherwise(F.coalesce(F.try_element_at(names, F.upper(bare)), bare))


def merged_entities(entities: Column) -> Column:
    """A map of label to text from entities (label, word) in order: words of one label are joined by blanks, word-piece marks removed."""
    e = F.transform(entities, lambda x: F.struct(label_name(x["label"]).alias("k"), F.trim(F.replace(F.coalesce(x["word"], F.lit("")), F.lit("@@ "), F.lit(""))).alias("v")))
    e = F.filter(e, lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(e, lambda x: x["k"])), lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(e, lambda x: x["k"] == k), lambda x: x["v"]), " ").alias("value"))))


def first_spans(tokens: Column, spans: Column) -> Column:
    """A map of label to text from spans (start, end, label) of tokens: the first span of each label."""

    def of(x: Column) -> Column:
        text = lambda s: F.array_join(F.slice(x["t"], s["start"] + 1, s["end"] - s["start"]), " ")
        labels = F.array_distinct(F.transform(x["s"], lambda s: s["label"]))
        return F.map_from_entries(F.transform(labels, lambda k: F.struct(k.alias("key"), let(F.get(F.filter(x["s"], lambda s: s["label"] == k), F.lit(0)), text).alias("value"))))

    return let(F.struct(tokens.alias("t"), spans.alias("s")), of)


def remapped_json(json: Column, mapping: Column) -> Column:
    """JSON text in which every whole number, at any depth, that a map (of texts) has is replaced; strings, keys and other numbers stay as they are."""
    tokens = F.regexp_extract_all(json, F.lit(r'(?s)"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|.'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(x.rlike(r"^-?\d+$"), F.coalesce(F.try_element_at(mapping, x), x)).otherwise(x)), "")


#: Label of what a loss leaves out.
IGNORED = -100


def token_labels(text: Column, spans: Column, tokens: Column, labels: Sequence[str], longest: int | None = None) -> Column:
    """Label numbers of a text's tokens: of another segmentation than that into words, given by offsets (start, end), such as a model's sub-tokens.

    Spans (start, end, label; in characters) label the words that they overlap, in the order of their starts, B- for the first and I- for the others; later spans overwrite. A
    word's label goes to the first token that begins in it; further ones, tokens without offsets or characters (special ones), and tokens between words are IGNORED. `labels` lists the tags by
    number; a span whose B- isn't among them labels nothing, and an I- that isn't counts as O. With `longest` the rest is cut off.
    """
    of = lambda tag: F.array_position(F.array(*map(F.lit, labels)), tag).cast("int") - 1
    words = F.get(F.transform(F.array(placed_words(text)), lambda w: w), F.lit(0))

    def tagged(held: Column) -> Column:
        def lay(tags: Column, s: Column) -> Column:
            meets = lambda w: (w["end"] > s["start"]) & (w["start"] < s["end"])
            laid = lambda first: F.transform(tags, lambda t, i: F.when(meets(F.get(held["w"], i)), F.when(i == first, F.concat(F.lit("B-"), s["label"])).otherwise(F.concat(F.lit("I-"), s["label"]))).otherwise(t))
            return F.when(of(F.concat(F.lit("B-"), s["label"])) >= 0, let(F.array_position(F.transform(held["w"], meets), True).cast("int") - 1, laid)).otherwise(tags)

        ordered = F.array_sort(F.filter(held["s"], lambda s: s["label"].isNotNull() & s["start"].isNotNull()), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0))
        return F.aggregate(ordered, F.transform(held["w"], lambda w: F.lit("O")), lay)

    def numbered(held: Column) -> Column:
        # each token with the number of its word, which is looked for once; a word's first token is the first that has its number
        def placed(t: Column) -> Column:
            return let(F.size(F.filter(held["w"], lambda w: w["start"] <= t["start"])) - 1, lambda at: let(F.get(held["w"], at), lambda w: F.when((t["end"] > t["start"]) & (t["start"] < w["end"]), at)))

        def label(at: Column, i: Column, all_: Column) -> Column:
            own = lambda tag: F.when(tag >= 0, tag).otherwise(of(F.lit("O")))
            return F.when(at.isNotNull() & (F.array_position(all_, at) == i + 1), let(of(F.get(held["tags"], at)), own)).otherwise(IGNORED)

        return let(F.transform(held["k"], placed), lambda p: F.transform(p, lambda at, i: label(at, i, p)))

    cut = tokens if longest is None else F.slice(tokens, F.lit(1), F.lit(longest))
    return let(F.struct(words.alias("w"), spans.alias("s"), cut.alias("k")), lambda x: let(F.struct(x["w"].alias("w"), x["k"].alias("k"), tagged(x).alias("tags")), numbered))
