"""Labelled spans of addresses whose ward, district and province are known by name.

Every rule gives candidates, as a column of the table: arrays of spans in the order in which they are tried. One fold takes them in, one after the other, and
decides by the first span already taken that a candidate overlaps. So the different addresses of a table are labelled row by row; only street names
that are looked up in a gazetteer are joined.

Rules: a, the known names, preferably after a word for their level, then right-most; b, known names that don't stand in the text (`implied`, placed behind its
end); c, an address without commas: a big city at its end, what stands before it; d, parts that begin with a word for a level; e, of an address without any of
these its last three plain parts; f, one ward name under two words for wards; g, streets between a house number and the ward;
h, house number and street in the first three parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.operators.relational import once_per_value, spread

# Words before the names of units by level, all of them, and where a street name ends.
UNIT_WORDS = {"WDS": r"Phường|Xã|Thị trấn|P\.|X\.", "DST": r"Quận|Huyện|Thị xã|Thành phố|Q\.|H\.", "PRO": r"Tỉnh|Thành phố|TP\.?"}
ANY_UNIT = r"Thành phố|Tỉnh|Quận|Huyện|Thị xã|Phường|Xã|Thị trấn|TP\.?|Q\.?|H\.?|P\.?|X\.?"
STREET_END = r"Phường|Xã|Thị trấn|Quận|Huyện|Thị xã|Thành phố|Tỉnh(?!\s+lộ)|TP|P\.|Q\.|H\.|X\."
# Cities at the end of an address, and their short forms, some only after "tp".
CITIES = r"hồ\s*ch[íi]\s*minh|s[àa]i\s*g[òo]n|h[àa]\s*n[ộo]i|đ[àa]\s*n[ẵa]ng|hải\s*phòng|cần\s*thơ"
CITY_SHORT, CITY_AFTER_TP = r"hcm|sg|hn", r"hcm|hn\b|đn\b|sg\b"
# House numbers, plus codes, what is no street, and what is left out before one.
NUMBER = r"(?:Số\s+)?\d+[A-Za-z]?(?:[/\-]\d+[A-Za-z]?)*(?:\s+[a-z]\d{1,4}[a-z]?)?|(?:\b|^)(?:Lô|Km)\s+[\w\-]+"
FIRST_NUMBER = r"^((?:Số\s+)?(?:K\d+|\d+[A-Za-z]?)(?:[\\/\-]\d+[A-Za-z]?)*(?:\s+[a-z]\d{1,4}[a-z]?)?)\s+(.+)$"
PLUS_CODE = r"[23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3}"
NO_STREET = r"nhà|trường\s+(?:tiểu\s*học|trung\s*học|thcs|thpt|mầm\s*non|đại\s*học|cao\s*đẳng)|bệnh\s*viện|trạm\s*y\s*tế|phòng\s*khám|nhà\s*thuốc|chợ|khu\s*dân\s*cư|kdc|khu\s*công\s*nghiệp|kcn|tổ|khu\s*phố|kp|tdp|thôn|ấp|xóm|làng|khóm|khu\s*\d+"
NEIGHBOURHOOD = r"Tổ|Khu\s*phố|KP|TDP|Thôn|Ấp|Bản|Xóm|Làng|Khóm|Khu\s*\d+"
BEFORE_STREET = r"Tòa nhà|Chung cư|Khu|Khu dân cư|Block|Tầng|Phòng|Lầu"
ALLEY = r"Hẻm|Ngõ|Kiệt|Ngách"
STREETS = ((r"(?:^|[\s,])(?:QL\s*\d+[A-Za-z]?|Đ\s*T\s*\d+[A-Za-z]?|DT\s*\d+[A-Za-z]?)\b", 0.88), (r"(?:Đường|Đ\.|QL|Quốc\s*lộ|ĐT|DT|TL|Tỉnh\s*lộ|Đại\s*lộ|Hương\s*lộ|HL)\s+[^,.\n]+", 0.85))
# Of two labels on one span the one that stays.
PRIORITY = {"POI": 60, "PCD": 58, "BLD": 55, "NHB": 45, "ALY": 42, "STR": 35, "NUM": 25}

#: Case and letters as in all of Unicode.
_U = "(?iU)"
CANDIDATES = "array<struct<stage:string,label:string,start:int,end:int,span:string,score:double,rule:string>>"
SPANS = "array<struct<start:int,end:int,span:string,labels:array<string>,score:double,stage:string>>"
#: When a candidate counts: always; where its label is missing; and then only after an earlier stage's ward, or a district; or where no earlier stage found a unit.
ALWAYS, MISSING, AFTER_WARD, AFTER_DISTRICT, BARE = "always", "missing", "after ward", "after district", "bare"


def _none(kind: str = CANDIDATES) -> Column:
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which the value is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(x: Column, chars: str = " ,") -> Column:
    return F.regexp_replace(x, f"^[{chars}]+|[{chars}]+$", "")


def matches(text: Column, pattern: Column | str) -> Column:
    """Where a pattern's matches stand and what they are: an array of (start, span), from left to right."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    runs, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern)
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p))
    return let(F.struct(runs.alias("runs"), gaps.alias("gaps")), lambda m: F.transform(m["runs"], lambda r, i: F.struct((length(m["gaps"], i + 1) + length(m["runs"], i)).alias("start"), r.alias("span"))))


def whole_words(term: Column) -> Column:
    """A pattern for a text that stands as whole words."""
    return F.concat(F.lit(_U + r"(?<!\w)\Q"), term, F.lit(r"\E(?!\w)"))


def short_name(name: Column) -> Column:
    """A unit's name without the word for its level; one letter is such a word only with a full stop or a blank behind it."""
    return F.trim(F.regexp_replace(F.trim(name), rf"{_U}^(?:(?:{ANY_UNIT})(?:\s+|(?<=\.)))", ""))


def _candidate(stage: str, label: str | Column, start: Column, span: Column, score: float | Column, rule: str) -> Column:
    label, score = (F.lit(x) if isinstance(x, (str, float)) else x for x in (label, score))
    return F.struct(F.lit(stage).alias("stage"), label.alias("label"), start.cast("int").alias("start"), (start + F.length(span)).cast("int").alias("end"), span.alias("span"), score.cast("double").alias("score"), F.lit(rule).alias("rule"))


def _found(text: Column, part: Column) -> Column:
    """Where a part stands first in a text, in any case, from 0; -1 for nowhere."""
    return F.instr(F.lower(text), F.lower(part)) - 1


def parts(text: Column) -> Column:
    """An address's parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def _occurrences(text: Column, label: str, name: Column) -> Column:
    """Candidates for the places where a unit's name stands, the best first."""
    left = lambda start, n: F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))
    words = UNIT_WORDS[label] + ("|City" if label == "PRO" else "")

    def occurrence(h: Column) -> Column:
        # a word for the level that alone stands before the name belongs to it
        alone = left(h["start"], 24).rlike(rf"{_U}^(?:{UNIT_WORDS[label]})\s+$")
        start = F.when(alone, F.greatest(h["start"] - 24, F.lit(0))).otherwise(h["start"])
        hinted = left(h["start"], 24).rlike(rf"{_U}\b(?:{words})\s*$")
        return let(start, lambda at: F.struct(hinted.alias("hinted"), at.alias("start"), F.substring(text, at + 1, h["start"] - at + F.length(h["span"])).alias("span")))

    def ranked(hits: Column) -> Column:
        own = F.filter(hits, lambda h: ~left(h["start"], 8).rlike(rf"{_U}Đ\.\s*$")) if label == "WDS" else hits
        placed = F.reverse(F.array_sort(F.transform(own, occurrence)))
        return F.transform(placed, lambda h: _candidate("a", label, h["start"], h["span"], 1.0, MISSING))

    def found(term: Column) -> Column:
        return F.when(term != "", matches(text, whole_words(term))).otherwise(_none("array<struct<start:int,span:string>>"))

    own = F.coalesce(F.trim(name), F.lit(""))
    return let(own, lambda n: let(found(n), lambda hits: ranked(F.when(F.size(hits) > 0, hits).otherwise(let(short_name(n), found)))))


def known_names(text: Column, names: dict[str, Column]) -> Column:
    """Rules a and b."""

    def implied(label: str, name: Column) -> Column:
        shown = F.coalesce(F.nullif(short_name(name), F.lit("")), name)
        there = lambda n, x: F.rlike(text, whole_words(n)) | F.rlike(text, whole_words(x))
        return let(shown, lambda x: F.when((name != "") & ~there(name, x), F.array(_candidate("b", label, F.length(F.rtrim(text)), x, 0.99, MISSING))).otherwise(_none()))

    own = {label: F.coalesce(F.trim(name), F.lit("")) for label, name in names.items()}
    return F.concat(*(_occurrences(text, label, name) for label, name in own.items()), *(implied(label, name) for label, name in own.items()))


def single_part(text: Column) -> Column:
    """Rule c."""
    tail = rf"{_U}(?:(?:tp\.?\s+|thành\s*phố\s+)?(?:{CITIES})|tp\.?\s*(?:{CITY_AFTER_TP})|\b(?:{CITY_SHORT})\b)\s*$"

    def unit(before: Column, label: str, rule: str) -> Column:
        span = F.regexp_extract(before, rf"{_U}(?:{UNIT_WORDS[label]})\s+.+$", 0)
        return let(span, lambda x: F.when(x != "", F.array(_candidate("c", label, F.length(before) - F.length(x), x, {"WDS": 0.93, "DST": 0.92}[label], rule))).otherwise(_none()))

    def units(before: Column) -> Column:
        return let(unit(before, "WDS", MISSING), lambda w: F.when(F.size(w) > 0, F.concat(w, unit(before, "DST", AFTER_WARD))).otherwise(unit(before, "DST", MISSING)))

    def all_of(x: Column) -> Column:
        n = F.length(x["t"]) - F.length(x["city"])
        city = F.when(x["city"] != "", F.array(_candidate("c", "PRO", n, x["city"], 0.94, MISSING))).otherwise(_none())
        return F.concat(city, let(F.rtrim(F.substring(x["t"], F.lit(1), n)), units))

    t = F.rtrim(text)
    return F.when(F.size(parts(text)) == 1, let(F.struct(t.alias("t"), F.regexp_extract(t, tail, 0).alias("city")), all_of)).otherwise(_none())


def prefixed_parts(text: Column) -> Column:
    """Rule d: the first such part for ward and district; for the province from the right, after a district also a plain part without digits."""

    def named(part: Column, label: str) -> Column:
        """Where in its part such a name stands, and the name; null for none."""
        own, pattern = trimmed(part), rf"{_U}^\s*({UNIT_WORDS[label]})\s+(.+)$"
        return let(own, lambda p: F.when(p.rlike(pattern), F.concat(F.trim(F.regexp_extract(p, pattern, 1)), F.lit(" "), trimmed(F.regexp_extract(p, pattern, 2)))))

    def candidate(part: Column, name: Column, label: str) -> Column:
        start = _found(text, part) + F.greatest(_found(part, name), F.lit(0))
        return let(start, lambda at: _candidate("d", label, at, F.substring(text, at + 1, F.length(name)), 0.96, MISSING))

    def first(all_parts: Column, label: str) -> Column:
        some = F.filter(F.transform(all_parts, lambda p: F.struct(p.alias("p"), named(p, label).alias("n"))), lambda x: x["n"].isNotNull())
        return F.transform(F.slice(some, F.lit(1), F.lit(1)), lambda x: candidate(x["p"], x["n"], label))

    def province(p: Column) -> Column:
        plain = let(_found(text, p), lambda at: _candidate("d", "PRO", at, F.substring(text, at + 1, F.length(p)), 0.9, AFTER_DISTRICT))
        return let(named(p, "PRO"), lambda n: F.when(n.isNotNull(), candidate(p, n, "PRO")).when(~p.rlike(r"(?U)\d"), plain))

    def all_of(some: Column) -> Column:
        return F.concat(first(some, "WDS"), first(some, "DST"), F.filter(F.transform(F.reverse(some), province), lambda c: c.isNotNull()))

    return let(parts(text), all_of)


def bare_parts(text: Column) -> Column:
    """Rule e: the last three parts that are neither a country nor a plus code and hold no digits, but for a postal code at the end."""

    def plain(own: Column) -> Column:
        cut = trimmed(F.regexp_replace(own, r"(?U)\s+\d{5,7}\s*$", ""))
        other = own.rlike(rf"{_U}^vi[eệ]t\s*nam$") | F.replace(F.upper(own), F.lit(" "), F.lit("")).rlike(f"^{PLUS_CODE}$")
        return let(cut, lambda x: F.when(other, F.lit("")).when((x != "") & ~x.rlike(r"(?U)\d"), x).when(own.rlike(r"(?U)\d"), "").otherwise(own))

    def one(x: Column, label: str, score: float) -> Column:
        return let(_found(text, x), lambda at: _candidate("e", label, at, F.substring(text, at + 1, F.length(x)), score, BARE))

    def last(some: Column) -> Column:
        of = lambda i, label, score: one(F.get(some, F.size(some) - i), label, score)
        return F.when(F.size(some) >= 3, F.array(of(3, "WDS", 0.88), of(2, "DST", 0.88), of(1, "PRO", 0.9))).otherwise(_none())

    return let(F.filter(F.transform(F.transform(parts(text), lambda p: trimmed(p)), plain), lambda p: p != ""), last)


def twice_named(text: Column) -> Column:
    """Rule f: wards that have one name under different words for wards, in parts of their own."""
    words = UNIT_WORDS["WDS"]
    pattern = rf"{_U}(?:^|(?<=,))\s*(?:{words})\s+[^,\n]+?(?=\s*,|\s*$)"

    def split_up(m: Column) -> Column:
        lead = F.length(m["span"]) - F.length(F.ltrim(m["span"]))
        return let(trimmed(F.ltrim(m["span"])), lambda x: F.struct((m["start"] + lead).alias("start"), x.alias("span"), F.lower(F.regexp_extract(x, rf"{_U}^(?:{words})", 0)).alias("word"), F.lower(F.trim(F.regexp_replace(x, rf"{_U}^(?:{words})\s+", ""))).alias("name")))

    def agreeing(units: Column) -> Column:
        some = F.filter(units, lambda u: (u["name"] != "") & ~u["span"].rlike(rf"{_U}vi[eệ]t\s*nam\s*$") & F.exists(units, lambda o: (o["name"] == u["name"]) & (o["word"] != u["word"])))
        return F.transform(some, lambda u: _candidate("f", "WDS", u["start"], u["span"], 0.97, ALWAYS))

    return let(F.transform(matches(text, pattern), split_up), agreeing)


def _without_echo(x: Column) -> Column:
    """Words that begin with a run that repeats at once, without the repeat; and a name that a number separates from itself, once."""

    def unrepeated(x: Column) -> Column:
        return F.when(F.size(F.split(F.trim(x), r"\s+")) >= 4, F.regexp_replace(x, r"^(\S+(?:\s+\S+)*)\s+\1(?=\s|$)", "$1")).otherwise(x)

    def without_code(x: Column) -> Column:
        return let(F.regexp_extract(x, r"(?i)^[a-z]\d{1,5}\s+(.{2,})$", 1), lambda own: F.when(own.rlike(r"[À-ỸA-ZĐ]"), trimmed(own)).otherwise(x))

    def once(x: Column) -> Column:
        return let(F.regexp_replace(x, r"(?is)^(.+?)\s+\d+[A-Za-z]?\s+\1\s*$", "$1"), lambda y: F.when((F.size(F.split(y, " ")) >= 2) & (F.length(y) >= 6), y).otherwise(x))

    return let(let(let(let(x, once), unrepeated), unrepeated), without_code)


def _street(stage: str, text: Column, start: Column, span: Column, score: float | Column, ward: Column) -> Column:
    """A street's candidate, cut where a unit's word begins; null where the span is no street. A way to somewhere is that place."""

    def named(x: Column) -> Column:
        name, at = x["name"], x["at"]
        numbered = F.rlike(text, F.concat(F.lit(_U + r"\b(?!số\b)\p{L}+(?:\s+\p{L}+)?\s+\d+[A-Za-z]?\s*[,.\-]?\s*\Q"), x["ward"], F.lit(r"\E(?!\w)")))
        own_ward = (x["ward"] != "") & (F.lower(name) == F.lower(x["ward"])) & numbered
        way = let(F.length(F.regexp_extract(name, rf"{_U}^(đường\s+vào\s+)(.{{2,}})$", 1)), lambda n: F.when(n > 0, _candidate(stage, "POI", at + n, F.substring(name, n + 1, F.length(name)), score, ALWAYS)).otherwise(_candidate(stage, "STR", at, name, score, ALWAYS)))
        return F.when((start >= 0) & (name != "") & ~name.rlike(rf"{_U}^(?:{NO_STREET})(?!\w)") & ~own_ward, way)

    def cut(lead: Column) -> Column:
        name = F.rtrim(trimmed(F.regexp_replace(F.substring(span, lead + 1, F.length(span)), rf"{_U}\s*,?\s*(?<!\w)(?:{STREET_END})(?!\w).*$", "")))
        return let(F.struct(name.alias("name"), (start + lead).alias("at"), short_name(F.coalesce(ward, F.lit(""))).alias("ward")), named)

    return let(F.length(F.regexp_extract(span, rf"{_U}^\s*(?:số\s+)?", 0)), cut)


def street_gaps(text: Column, spans: Column) -> Column:
    """Between each house number and the next ward: (start, gap), longer numbers first. Numbers in plus codes don't count."""
    wards = F.transform(F.filter(spans, lambda s: F.array_contains(s["labels"], "WDS")), lambda s: s["start"])
    codes = matches(text, rf"{_U}(?:\b|^){PLUS_CODE}(?:\b|$)")

    def between(x: Column) -> Column:
        whole = F.substring(text, x["end"] + 1, x["to"] - x["end"])
        located = let(_without_echo(trimmed(whole)), lambda own: F.struct(x["order"].alias("order"), x["at"].alias("at"), (x["end"] + F.instr(F.lower(whole), F.lower(own)) - 1).alias("start"), own.alias("gap")))
        return F.when(x["to"].isNotNull() & ~x["inside"], located)

    def of_all(known: Column) -> Column:
        def gap(m: Column) -> Column:
            end = m["start"] + F.length(m["span"])
            inside = F.exists(known["codes"], lambda c: (c["start"] <= m["start"]) & (end <= c["start"] + F.length(c["span"])))
            to = F.array_min(F.filter(known["wards"], lambda w: w >= end))
            return let(F.struct((-F.length(m["span"])).alias("order"), m["start"].alias("at"), end.alias("end"), to.alias("to"), inside.alias("inside")), between)

        return F.transform(matches(text, _U + NUMBER), gap)

    found = let(F.struct(wards.alias("wards"), codes.alias("codes")), of_all)
    kept = F.filter(found, lambda g: g.isNotNull() & (g["gap"] != "") & (F.size(F.split(g["gap"], r"\s+")) <= 6) & ~g["gap"].rlike(rf"{_U}^(?:{ALLEY})\s"))
    return F.array_sort(kept)


def gap_streets(text: Column, gaps: Column, known: Column, ward: Column) -> Column:
    """Rule g: gaps that are known streets (lower-case names), or that begin with a capital and go on without a comma or full stop."""
    listed = lambda g: F.array_contains(known, F.lower(g["gap"]))
    some = F.filter(gaps, lambda g: listed(g) | g["gap"].rlike(r"^[A-ZĐ][^,.\n]+$"))
    return F.filter(F.transform(some, lambda g: _street("g", text, g["start"], g["gap"], F.when(listed(g), 0.92).otherwise(0.8), ward)), lambda c: c.isNotNull())


def first_parts(text: Column, names: dict[str, Column]) -> Column:
    """Rule h."""
    rest = F.regexp_replace(text, rf"{_U},?\s*việt\s*nam.*$", "")
    for name in names.values():
        # an empty name would be everywhere
        term = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("\x00"))
        rest = F.regexp_replace(rest, F.concat(F.lit(rf"{_U}(?:(?:{ANY_UNIT})\s*)?\s*\Q"), term, F.lit(r"\E")), F.lit(""))
    rest = trimmed(F.regexp_replace(F.regexp_replace(rest, r"(?U)\s*,\s*", ","), r"(?U)\s+", " "))

    def at(x: Column, label: str, score: float) -> Column:
        return let(_found(text, x), lambda i: _candidate("h", label, i, F.substring(text, i + 1, F.length(x)), score, ALWAYS))

    def street(x: Column, score: float) -> Column:
        return let(F.struct(x.alias("x"), _found(text, x).alias("at")), lambda s: _street("h", text, s["at"], F.substring(text, s["at"] + 1, F.length(s["x"])), score, names["WDS"]))

    def plain(p: Column) -> Column:
        # of the patterns for streets, the first that is found
        each = [_matched(p, pattern, score) for pattern, score in STREETS]
        return F.array(F.coalesce(*each))

    def _matched(p: Column, pattern: str, score: float) -> Column:
        return let(F.trim(F.regexp_extract(p, _U + pattern, 0)), lambda x: F.when(x != "", street(x, score)))

    def one(p: Column) -> Column:
        return let(F.struct(p.alias("p"), F.trim(F.regexp_extract(p, _U + FIRST_NUMBER, 1)).alias("number"), F.regexp_extract(p, _U + FIRST_NUMBER, 2).alias("after")), judged)

    def judged(x: Column) -> Column:
        house = at(x["number"], "NUM", 0.98)
        is_lot, is_neighbourhood = x["after"].rlike(rf"{_U}^lô\s+\d+[A-Za-z]?$"), x["after"].rlike(rf"{_U}^(?:{NEIGHBOURHOOD})\b")
        named = let(_without_echo(F.regexp_replace(x["after"], rf"{_U}^(?:{BEFORE_STREET})\b[,\s]*", "")), lambda name: street(name, 0.95))
        numbered = F.when(is_lot, F.array(house, at(x["after"], "NHB", 0.91))).when(is_neighbourhood, F.array(house)).otherwise(F.array(named, house))
        has = x["number"] != ""
        return F.struct((has & ~is_neighbourhood).alias("last"), F.when(has, numbered).otherwise(plain(x["p"])).alias("c"))

    def upto_last(found: Column) -> Column:
        stop = F.array_position(F.transform(found, lambda x: x["last"]), True).cast("int")
        own = F.when(stop > 0, F.slice(found, F.lit(1), F.greatest(stop, F.lit(1)))).otherwise(found)
        return F.filter(F.flatten(F.transform(own, lambda x: x["c"])), lambda c: c.isNotNull() & (c["start"] >= 0) & (c["span"] != ""))

    return let(F.transform(F.slice(parts(rest), F.lit(1), F.lit(3)), one), upto_last)


def _macro(label: Column) -> Column:
    return label.isin(*UNIT_WORDS)


def _priority(label: Column) -> Column:
    out = F.lit(10)
    for name, n in PRIORITY.items():
        out = F.when(label == name, n).otherwise(out)
    return out


def _verdict(c: Column, hit: Column) -> Column:
    """What becomes of a candidate, by the first span taken that overlaps it (null for none): add, also (one more label), relabel, replace, or drop."""
    own, label = F.get(hit["labels"], F.lit(0)), c["label"]
    both = own.isin("DST", "PRO") & label.isin("DST", "PRO")
    better = _priority(label) - _priority(own)
    same = F.when(F.array_contains(hit["labels"], label), "drop").when(both, "add").when(_macro(own) & ~_macro(label), "drop").when(better > 0, "relabel").when(better < 0, "drop").otherwise("also")
    longer = (c["end"] - c["start"]) > (hit["end"] - hit["start"])
    crossing = F.when(both, "add").when(_macro(own) != _macro(label), "drop").when(longer, "replace").otherwise("drop")
    return F.when(hit.isNull(), "add").when((hit["start"] == c["start"]) & (hit["end"] == c["end"]), same).otherwise(crossing)


def resolved(candidates: Column, taken: Column | None = None) -> Column:
    """Spans that are left of candidates, which are taken in one after the other, after `taken`.

    A unit and another label never overlap: the one that came first stays. District and province may. On one span the label of higher PRIORITY stays; else
    the strictly longer span replaces the first that it overlaps.
    """

    def wanted(spans: Column, c: Column) -> Column:
        has = lambda label: F.exists(spans, lambda s: F.array_contains(s["labels"], label))
        bare = ~F.exists(spans, lambda s: _macro(F.get(s["labels"], F.lit(0))) & (s["stage"] < c["stage"]))
        missing = ~has(c["label"])
        ward = F.exists(spans, lambda s: F.array_contains(s["labels"], "WDS") & (s["stage"] < c["stage"]))
        return F.when(c["rule"] == MISSING, missing).when(c["rule"] == AFTER_WARD, missing & ward).when(c["rule"] == AFTER_DISTRICT, missing & has(F.lit("DST"))).when(c["rule"] == BARE, missing & bare).otherwise(True)

    def step(spans: Column, c: Column) -> Column:
        overlaps = lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])
        at = F.array_position(F.transform(spans, overlaps), True).cast("int") - 1
        new = F.struct(c["start"].alias("start"), c["end"].alias("end"), c["span"].alias("span"), F.array(c["label"]).alias("labels"), c["score"].alias("score"), c["stage"].alias("stage"))

        def changed(x: Column) -> Column:
            def other(s: Column) -> Column:
                score = F.greatest(s["score"], c["score"])
                labels = F.when(x["v"] == "also", F.array_append(s["labels"], c["label"])).otherwise(F.array(c["label"]))
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("span"), labels.alias("labels"), score.alias("score"), s["stage"].alias("stage"))

            there = F.transform(spans, lambda s, i: F.when(i == x["at"], other(s)).otherwise(s))
            rest = F.filter(spans, lambda s, i: i != x["at"])
            return F.when(x["v"] == "add", F.array_append(spans, new)).when(x["v"].isin("also", "relabel"), there).when(x["v"] == "replace", F.array_append(rest, new)).otherwise(spans)

        seen = F.struct(at.alias("at"), _verdict(c, F.get(spans, at)).alias("v"))
        return F.when((c["end"] > c["start"]) & (c["start"] >= 0) & wanted(spans, c), let(seen, changed)).otherwise(spans)

    return F.aggregate(candidates, _none(SPANS) if taken is None else taken, lambda spans, c: step(spans, c).cast(SPANS))


def labelled(df: DataFrame, id_: str, text: str, ward: str, district: str, province: str, streets: DataFrame | None = None) -> DataFrame:
    """(id_, start, end, span, label, labels, score, stage, implied): a row for each span of a text (from 0; `end` behind it) and its labels, of which `label` is the first.

    `streets` (name) is a gazetteer; the gaps of rule g meet it by an equality join. Equal texts with equal names are labelled once. Null and empty texts have no spans; null names aren't looked for. Ids are distinct.
    """
    own = df.filter(F.trim(text) != "").select(id_, F.col(text).alias("__t"), F.col(ward).alias("__w"), F.col(district).alias("__d"), F.col(province).alias("__p"))
    found = once_per_value(own, ["__t", "__w", "__d", "__p"], lambda distinct: _span_arrays(spread(distinct, "__t"), streets))
    return found.select(id_, F.explode("__spans").alias("s")).select(id_, "s.start", "s.end", "s.span", F.get("s.labels", F.lit(0)).alias("label"), "s.labels", "s.score", "s.stage", (F.col("s.stage") == "b").alias("implied"))


def _span_arrays(own: DataFrame, streets: DataFrame | None) -> DataFrame:
    """A table of texts (__t) and names (__w, __d, __p) with their spans (__spans)."""
    names = {"WDS": F.col("__w"), "DST": F.col("__d"), "PRO": F.col("__p")}
    t = F.col("__t")
    units = resolved(F.concat(known_names(t, names), single_part(t), prefixed_parts(t), bare_parts(t), twice_named(t)))
    own = own.withColumn("__units", units)
    own = own.withColumn("__gaps", street_gaps(t, F.col("__units")))
    if streets is not None:
        listed = streets.select(F.lower("name").alias("__s")).filter("__s IS NOT NULL").distinct()
        hits = own.select("__t", F.explode(F.transform("__gaps", lambda g: F.lower(g["gap"]))).alias("__s")).distinct().join(listed.hint("merge"), "__s", "left_semi")
        # gaps depend on the names too, but a street is known or not whatever the gap it was asked for
        known_of = hits.groupBy("__t").agg(F.collect_set("__s").alias("__known"))
        own = own.join(known_of.hint("merge"), "__t", "left")
    known = F.coalesce(F.col("__known"), _none("array<string>")) if streets is not None else _none("array<string>")
    spans = resolved(F.concat(gap_streets(t, F.col("__gaps"), known, F.col("__w")), first_parts(t, names)), F.col("__units"))
    return own.withColumn("__spans", spans).select("__t", "__w", "__d", "__p", "__spans")


def segments(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id_, i, start, segment): the parts of a text between commas, numbered from 1, and where each begins (from 0)."""
    cut = F.split(text, ",")
    before = F.aggregate(F.slice("__cut", F.lit(1), F.col("__i")), F.lit(0), lambda n, p: n + F.length(p) + 1)
    each = df.select(id_, cut.alias("__cut")).select(id_, "__cut", F.posexplode("__cut").alias("__i", "__p"))
    out = each.select(id_, F.col("__i").alias("at"), (before + F.length("__p") - F.length(F.ltrim("__p"))).alias("start"), F.trim("__p").alias("segment")).filter("segment <> ''")
    return out.withColumnRenamed("at", "i").withColumn("i", F.col("i") + 1)


def gazetteer_hits(parts_: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Segments with the units (unit, level, name) whose name they are, with or without the word for a level, in any case: (.., unit, level, exact).

    A gazetteer's names are listed as they are and without such words, so both sides meet by one equality join. It is a sorted one: the segments are split from few columns, are
    taken for a small table by Spark's estimate, and would go through the driver as a broadcast. Each distinct segment meets the gazetteer once.
    """
    keys = lambda c: F.array_distinct(F.array(F.lower(F.trim(c)), F.lower(short_name(c))))
    g = gazetteer.select("unit", "level", F.col("name").alias("__name"), F.explode(keys(F.col("name"))).alias("__k")).filter("__k <> ''")
    each = parts_.select("segment").distinct()
    s = each.withColumn("__k", F.explode(keys(F.col("segment")))).filter("__k <> ''")
    met = s.join(g.hint("merge"), "__k").withColumn("exact", F.lower(F.trim("segment")) == F.lower(F.trim("__name")))
    hits = met.groupBy("segment", "unit", "level").agg(F.max("exact").alias("exact"))
    return parts_.distinct().join(hits.hint("merge"), "segment").select(*parts_.columns, "unit", "level", "exact")
