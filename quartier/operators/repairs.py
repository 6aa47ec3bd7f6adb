"""Expected labels of addresses: repaired by what stands in the address, and held against actual ones.

Texts are compared as they are written but for case; letters and marks that are written apart have to be composed before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartier.functions.normalize import LABEL_PREFIXES, PROVINCE_NAMES, stripped
from quartier.operators.labeller import _U, UNIT_WORDS, let, matches, short_name, trimmed

ITEMS = "array<struct<label:string,text:string>>"
#: Words that say that an address names a unit of a level; "Thành phố" may be of either of two.
PRESENT = {"WDS": UNIT_WORDS["WDS"], "DST": UNIT_WORDS["DST"], "PRO": r"Tỉnh|TP\.?"}


def _plain(x: Column) -> Column:
    return F.lower(stripped(F.coalesce(x, F.lit(""))))


def _same(label: Column, a: Column, b: Column) -> Column:
    """Equal texts, or units that are equal without the words for their level."""
    out = _plain(a) == _plain(b)
    for name, prefixes in LABEL_PREFIXES.items():
        x, y = (_plain(F.regexp_replace(stripped(F.coalesce(v, F.lit(""))), rf"(?iu)^(?:{prefixes})\s+", "")) for v in (a, b))
        if name == "PRO":
            names = F.create_map(*[F.lit(v) for pair in PROVINCE_NAMES.items() for v in pair])
            x, y = (F.coalesce(F.try_element_at(names, v), v) for v in (x, y))
        out = out | ((label == name) & (x != "") & (x == y))
    return out


def _quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))


def unit_text(address: Column, label: str, name: Column) -> Column:
    """A unit's name as the address has it, with the word for its level where it stands there; null for an empty name.

    A ward or district that has such a word stays as it is. A province that is a part of its own between commas stays bare. Otherwise the last place counts where the name stands after a
    word for its level; else, for names without one and for codes of up to three letters or digits, the last unit of that level, whatever its name; else the name itself.
    """
    words = UNIT_WORDS[label]

    def last(found: Column) -> Column:
        return trimmed(F.element_at(F.transform(found, lambda m: m["span"]), -1))

    def resolved(x: Column) -> Column:
        t, base = x["t"], x["base"]
        bare = matches(address, F.concat(F.lit(rf"{_U}(?:^|(?<=,))\s*"), _quoted(base), F.lit(r"\s*(?=,|$)"))) if label == "PRO" else F.array().cast("array<struct<start:int,span:string>>")
        named = matches(address, F.concat(F.lit(rf"{_U}\b(?:{words})\s+"), _quoted(base), F.lit(r"(?!\w)")))
        any_unit = matches(address, rf"{_U}\b(?:{words})\s+[^,\n]+")
        free = ~t.rlike(rf"{_U}^(?:{words})\s+") | F.lower(t).rlike("^[0-9a-z]{1,3}$")

        def chosen(f: Column) -> Column:
            return F.when(F.size(f["bare"]) > 0, last(f["bare"])).when(F.size(f["named"]) > 0, last(f["named"])).when((F.size(f["any"]) > 0) & free, last(f["any"])).otherwise(t)

        out = let(F.struct(bare.alias("bare"), named.alias("named"), any_unit.alias("any")), chosen)
        stays = F.lit(False) if label == "PRO" else t.rlike(rf"{_U}^(?:{words})\s+")
        return F.when(t == "", F.lit(None).cast("string")).when(stays, t).when(base == "", F.lit(None).cast("string")).otherwise(out)

    own = F.trim(F.coalesce(name, F.lit("")))
    base = F.trim(F.regexp_replace(own, rf"{_U}^(?:{words})\s+", ""))
    return let(F.struct(own.alias("t"), (short_name(base) if label == "PRO" else base).alias("base")), resolved)


def repaired_labels(address: Column, items: Column, ward: Column, district: Column, province: Column) -> Column:
    """Expected labels (label, text) with units as they stand in the address: known units replace those of their level, others are completed; blank ones and repeats in any case go."""
    text = F.coalesce(address, F.lit(""))
    names = {"WDS": ward, "DST": district, "PRO": province}
    known = {k: F.trim(F.coalesce(v, F.lit(""))) for k, v in names.items()}
    out = F.coalesce(items, F.array().cast(ITEMS))
    level = lambda x: F.upper(F.trim(F.coalesce(x["label"], F.lit(""))))
    item = lambda label, x: F.struct(label.alias("label"), x.alias("text"))
    for k, name in known.items():
        kept = _without(out, level, k)
        added = F.array(item(F.lit(k), F.coalesce(unit_text(text, k, name), name)))
        out = F.when(name != "", F.concat(kept, added)).otherwise(F.transform(out, _completed(text, level, item, k)))
    plain = F.filter(F.transform(out, lambda x: item(level(x), F.trim(F.coalesce(x["text"], F.lit(""))))), lambda x: (x["label"] != "") & (x["text"] != ""))
    same = lambda a, b: (a["label"] == b["label"]) & (F.lower(a["text"]) == F.lower(b["text"]))
    return let(plain, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, F.lit(1), i), lambda o: same(o, x))))


def _without(items: Column, level, k: str) -> Column:
    return F.filter(items, lambda x: level(x) != k)


def _completed(text: Column, level, item, k: str):
    def one(x: Column) -> Column:
        found = let(unit_text(text, k, x["text"]), lambda t: F.when(t.isNotNull() & (_plain(t) != _plain(x["text"])), t).otherwise(x["text"]))
        return item(x["label"], F.when(level(x) == k, found).otherwise(x["text"]))

    return one


def checked_labels(address: Column, expected: Column, actual: Column) -> Column:
    """passed, and why not: `missing`, expected labels that no actual one has; `unexpected`, actual ones beside them; `errors`, levels that the address names and no expected label has, and
    units that the address begins with and that lack the word for their level. Texts are equal in any case, units also without such words.
    """
    text, none = F.coalesce(address, F.lit("")), F.array().cast(ITEMS)
    e, a = (F.transform(F.coalesce(x, none), lambda i: F.struct(F.upper(F.trim(F.coalesce(i["label"], F.lit("")))).alias("label"), F.trim(F.coalesce(i["text"], F.lit(""))).alias("text"))) for x in (expected, actual))

    def judged(x: Column) -> Column:
        equal = lambda p, q: (p["label"] == q["label"]) & _same(p["label"], p["text"], q["text"])
        missing = F.filter(x["e"], lambda p: ~F.exists(x["a"], lambda q: equal(p, q)))
        unexpected = F.filter(x["a"], lambda q: ~F.exists(x["e"], lambda p: equal(p, q)))
        lacking = [F.when(text.rlike(rf"{_U}\b(?:{words})\s+") & ~F.exists(x["e"], _is(k)), F.lit(f"missing:{k}")) for k, words in PRESENT.items()]
        bare = [F.transform(F.filter(x["e"], _bare(text, k)), lambda p: F.concat(F.lit("untyped:"), p["label"], F.lit(":"), p["text"])) for k in UNIT_WORDS]
        errors = F.concat(F.filter(F.array(*lacking), lambda m: m.isNotNull()), *bare)
        return let(F.struct(missing.alias("missing"), unexpected.alias("unexpected"), errors.alias("errors")), lambda r: F.struct((F.size(r["missing"]) + F.size(r["unexpected"]) + F.size(r["errors"]) == 0).alias("passed"), r["missing"].alias("missing"), r["unexpected"].alias("unexpected"), r["errors"].alias("errors")))

    return let(F.struct(e.alias("e"), a.alias("a")), judged)


def _is(k: str):
    return lambda p: p["label"] == k


def _bare(text: Column, k: str):
    def test(p: Column) -> Column:
        begins = F.rlike(text, F.concat(F.lit(rf"{_U}^(?:{UNIT_WORDS[k]})\s+"), _quoted(p["text"]), F.lit(r"(?!\w)")))
        return (p["label"] == k) & (p["text"] != "") & ~p["text"].rlike(rf"{_U}^(?:{UNIT_WORDS[k]})\s+") & begins

    return test
