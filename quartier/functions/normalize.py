"""String normalizers of Vietnamese addresses as column expressions. Several exist side by side, as each has its own use and order of steps.

A null stays null unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Vietnamese letters with marks, by base letter.
VIETNAMESE = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ",
    "e": "èéẹẻẽêềếệểễ",
    "i": "ìíịỉĩ",
    "o": "òóọỏõôồốộổỗơờớợởỡ",
    "u": "ùúụủũưừứựửữ",
    "y": "ỳýỵỷỹ",
    "d": "đ",
}
# Prefixes of unit names, without marks, in the order in which they are removed.
KEY_PREFIXES = ("thanh pho", "tp", "tinh", "quan", "huyen", "thi xa", "tx", "phuong", "xa", "thi tran", "tt")
MAPPING_PREFIXES = ("thanh pho", "tinh", "quan", "huyen", "thi xa", "phuong", "xa", "thi tran")
ROMAN = {"viii": "8", "vii": "7", "iii": "3", "ii": "2", "vi": "6", "iv": "4", "ix": "9", "v": "5", "i": "1", "x": "10"}
# Abbreviations, spelt out in this order.
ABBREVIATIONS = {"TP.": "Thành phố ", "TP ": "Thành phố ", "Q.": "Quận ", "H.": "Huyện ", "P.": "Phường ", "X.": "Xã ", "TT.": "Thị trấn "}
CENTRAL_CITY = "Thành phố Trung ương"
# Prefixes of which a name loses the first that it starts with, by level.
NAME_PREFIXES = {
    "ward": ("Phường ", "Xã ", "Thị trấn "),
    "district": ("Quận ", "Huyện ", "Thành phố ", "Thị xã "),
    "province": ("Thành phố ", "Tỉnh "),
    "any": ("Tỉnh ", "Thành phố ", "Thành Phố ", "TP. ", "TP ", "Quận ", "Huyện ", "Thị xã ", "Phường ", "Xã ", "Thị trấn "),
}
# Prefixes that label texts are compared without, and names of provinces that stand for others.
LABEL_PREFIXES = {"WDS": r"Phường|Xã|Thị trấn|P\.|X\.", "DST": r"Quận|Huyện|Thị xã|Thành phố|Q\.|H\.", "PRO": "Tỉnh|Thành phố|TP"}
PROVINCE_NAMES = {"thành phố trung ương hồ chí minh": "hồ chí minh", "uảng nam": "quảng nam", "quang nam province": "quảng nam", "quang nam": "quảng nam"}


def _letters() -> tuple[str, str]:
    """All Latin letters that decompose into an ASCII letter and marks, and what each becomes."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
    pairs = [(c, b) for c, b in pairs if b.isascii() and b.isalpha()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _letters()


def table(groups: dict[str, str]) -> tuple[str, str]:
    return "".join(groups.values()), "".join(b * len(c) for b, c in groups.items())


FOLDED_FROM, FOLDED_TO = table(VIETNAMESE)
#: y with a mark is i, y without one stays.
KEY_FROM, KEY_TO = FOLDED_FROM, FOLDED_TO.replace("y", "i")


def stripped(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def lowered(x: Column) -> Column:
    """Lower case with white space collapsed."""
    return collapsed(F.lower(x))


def comparable(x: Column) -> Column:
    """Lower case, white space collapsed, no commas or spaces at the end; null as empty."""
    return F.regexp_replace(lowered(F.coalesce(x, F.lit(""))), "[, ]+$", "")


def unmarked(x: Column) -> Column:
    """Letters without marks, composed or not; letters with a stroke stay."""
    return F.regexp_replace(F.translate(x, MARKED, PLAIN), r"\p{Mn}", "")


def metric_text(x: Column) -> Column:
    """Lower case without marks and punctuation, white space collapsed; đ stays; null as empty."""
    return collapsed(F.regexp_replace(unmarked(F.lower(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}_\s]", " "))


def folded(x: Column) -> Column:
    """Lower case with Vietnamese letters unmarked, đ as d and ý as y; all else stays."""
    return F.translate(F.lower(x), FOLDED_FROM, FOLDED_TO)


def _unprefixed(x: Column, prefixes: Sequence[str]) -> Column:
    for p in prefixes:
        x = F.regexp_replace(x, rf"^{p}[.\s]+", "")
    return x


def search_key(x: Column, prefixes: Sequence[str] = KEY_PREFIXES) -> Column:
    """Letters and digits alone: lower case, unmarked with ý as i, unit prefixes removed once each in order; null as empty."""
    plain = F.translate(stripped(F.lower(F.coalesce(x, F.lit("")))), KEY_FROM, KEY_TO)
    return F.regexp_replace(_unprefixed(plain, prefixes), "[^a-z0-9]", "")


def mapping_key(x: Column, prefixes: Sequence[str] = MAPPING_PREFIXES) -> Column:
    """As search_key, but y is i from the start and words that are Roman numerals up to ten become digits; null as empty."""
    words = F.split(collapsed(F.translate(F.lower(F.coalesce(x, F.lit(""))), "y", "i")), " ")
    numerals = F.create_map(*[F.lit(v) for pair in ROMAN.items() for v in pair])
    read = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(numerals, w), w)), " ")
    return F.regexp_replace(_unprefixed(F.translate(read, KEY_FROM, KEY_TO), prefixes), "[^a-z0-9]", "")


def unit_name(name: Column, type_name: Column) -> Column:
    """A unit's name without its type wherever that stands; central cities also lose a leading "Thành phố "; null as empty."""
    kind, raw = stripped(F.coalesce(type_name, F.lit(""))), stripped(F.coalesce(name, F.lit("")))
    bare = F.when(kind == "", raw).otherwise(stripped(F.replace(raw, F.concat(kind, F.lit(" ")), F.lit(""))))
    return F.when((kind == CENTRAL_CITY) & bare.startswith("Thành phố "), stripped(F.substring(bare, len("Thành phố ") + 1, F.length(bare)))).otherwise(bare)


def table_name(name: Column, type_name: Column) -> Column:
    """As unit_name in tables: only blanks are trimmed, and a null name stays null."""
    bare = F.trim(F.replace(name, F.concat(F.coalesce(type_name, F.lit("")), F.lit(" ")), F.lit("")))
    return F.when(type_name == CENTRAL_CITY, F.regexp_replace(bare, r"^Thành phố\s+", "")).otherwise(bare)


def spelt_out(x: Column, abbreviations: dict[str, str] = ABBREVIATIONS) -> Column:
    """Abbreviations replaced wherever they stand, one after the other; null as empty."""
    x = F.coalesce(x, F.lit(""))
    for short, full in abbreviations.items():
        x = F.replace(x, F.lit(short), F.lit(full))
    return stripped(x)


@F.pandas_udf(StringType())
def _composed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def composed(x: Column) -> Column:
    """Canonical composition (NFC), for which Spark has no function."""
    return _composed(x)


def exact_text(x: Column) -> Column:
    """What exact matches compare: composed, white space collapsed; case and marks stay; null as empty."""
    return collapsed(composed(F.coalesce(x, F.lit(""))))


def label_text(x: Column) -> Column:
    """What labels are compared by: composed, stripped, lower case; null as empty."""
    return F.lower(composed(stripped(F.coalesce(x, F.lit("")))))


def without_prefix(x: Column, level: str = "any") -> Column:
    """A name without the first prefix of its level that it starts with."""
    out = x
    for p in reversed(NAME_PREFIXES[level]):
        out = F.when(x.startswith(p), F.substring(x, len(p) + 1, F.length(x))).otherwise(out)
    return stripped(out) if level == "any" else out


def same_unit(label: Column, expected: Column, actual: Column) -> Column:
    """Whether two label texts name the same ward, district or province: equal, or equal without their prefixes; other labels never do."""
    exact = label_text(expected) == label_text(actual)
    out = F.lit(False)
    for name, prefixes in LABEL_PREFIXES.items():
        a, b = (label_text(F.regexp_replace(stripped(F.coalesce(x, F.lit(""))), rf"(?iu)^(?:{prefixes})\s+", "")) for x in (expected, actual))
        if name == "PRO":
            names = F.create_map(*[F.lit(v) for pair in PROVINCE_NAMES.items() for v in pair])
            a, b = (F.coalesce(F.try_element_at(names, x), x) for x in (a, b))
        out = F.when(F.upper(label) == name, exact | ((a != "") & (b != "") & (a == b))).otherwise(out)
    return out


def zero_filled(x: Column, width: int) -> Column:
    """Zeros before a code up to a width; longer codes stay whole."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def number(x: Column) -> Column:
    """A number with commas and spaces removed; 0 where there is none."""
    return F.coalesce(F.regexp_replace(x, "[, ]", "").try_cast("double"), F.lit(0.0))


def joined(*parts: Column) -> Column:
    """The parts that aren't empty or null, with commas between."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def with_street_prefix(street: Column, prefixes: dict[str, str]) -> Column:
    """Abbreviated prefixes spelt out one after the other, in any case."""
    for short, full in prefixes.items():
        street = F.regexp_replace(street, rf"(?iu)^{re.escape(short)}", full)
    return street


def decoded(x: Column, bytes_to: dict[int, str]) -> Column:
    """A text that was read as Latin-1, with the bytes of another font's table as the letters they stand for; characters beyond Latin-1 as ?."""
    kept = F.regexp_replace(x, r"[^\x00-\xFF]", "?")
    return F.translate(kept, "".join(map(chr, bytes_to)), "".join(bytes_to.values()))


def healed(x: Column, replacements: dict[str, str]) -> Column:
    """Literal replacements in order."""
    for old, new in replacements.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x
