"""Parts of addresses, unit names and notes: column expressions, and steps over a table where one part is looked for in what another left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.functions.normalize import stripped

# Patterns of the parts of an address.
WARD = r"(?iu)(?:ph[uư][oờ]ng|xa|th[iị] tr[aấ]n)\s+([^,]+)"
DISTRICT = r"(?iu)(?:qu[aậ]n|huy[eệ]n|th[àa]nh ph[oố]|tp\.?)\s*([^,]+)"
PROVINCE = r"(?iu)(?:t[iỉ]nh|th[àa]nh ph[oố])\s+([^,]+)$"
LEADING_NUMBER = r"^\s*\d+[A-Za-z]?[./-]?\s*"
LEVELS = ("street", "ward", "district", "province")
_BOUND = r"(?iu)(?:^|(?<=[\s,.;()/-]))"
# What a label's value stands after, in the order in which the labels are taken out.
LABELS = {
    "POI": _BOUND + r"(?:trường|truong|bệnh viện|benh vien|bv\.?|công viên|cong vien|chợ|cho|siêu thị|sieu thi|trung tâm|trung tam|sân bay|san bay|công ty|cong ty|cty\.?)\s+([^,]+?)(?=,|$)",
    "BLD": _BOUND + r"(?:tòa nhà|toa nha|tòa|toa|building|block|chung cư|chung cu|cc\.?)\s+([^,]+?)(?=,|$)",
    "NHB": _BOUND + r"(?:khu phố|khu pho|kp\.?|tổ|to|ấp|ap|thôn|thon|xóm|xom)\s+([^,]+?)(?=,|$)",
    "FLR": _BOUND + r"(?:tầng|tang|lầu|lau|floor|fl\.?)\s*([0-9]{1,2}[A-Za-z]?)",
    "RM": _BOUND + r"(?:phòng|phong|p\.|room|rm\.?|căn|can)\s*([0-9]+[A-Za-z]?(?:[-.][0-9A-Za-z]+)?)",
}
# What a unit name starts with, and the type that it then has; the first that fits counts.
TYPE_PREFIXES = (
    ("Thành phố", "Thành phố"), ("Thành Phố", "Thành phố"), ("Tỉnh", "Tỉnh"), ("Quận", "Quận"), ("Huyện", "Huyện"), ("Thị xã", "Thị xã"), ("Thị Xã", "Thị xã"),
    ("phường", "Phường"), ("Phường", "Phường"), ("Xã", "Xã"), ("xã", "Xã"), ("Thị trấn", "Thị trấn"), ("Thị Trấn", "Thị trấn"), ("Đặc khu", "Đặc khu"),
    ("Thành ph?", "Thành phố"), ("Thành ph", "Thành phố"), ("Thành Ph?", "Thành phố"), ("Thành Ph", "Thành phố"), ("T?nh", "Tỉnh"), ("Qu?n", "Quận"), ("Huy?n", "Huyện"),
    ("Th? xã", "Thị xã"), ("Th? Xã", "Thị Xã"), ("ph??ng", "phường"), ("Ph??ng", "Phường"), ("x?", "Xã"), ("X?", "Xã"), ("Th? tr?n", "Thị trấn"), ("Th? Tr?n", "Thị trấn"), ("??c khu", "Đặc khu"),
)
# Words of notes on what became of a unit, as written and as a lossy export has them.
NOTE_WORDS = {
    "special": ("đặc khu", "đ?c khu", "sắp xếp", "s?p x?p"),
    "whole": ("toàn bộ", "toàn b?"),
    "merged": ("nhập", "nh?p"),
    "part": ("một phần", "m?t ph?n"),
    "area": ("diện tích", "di?n tích", "di?n tch"),
    "people": ("dân số", "dân s?"),
    "renamed": ("đổi tên", "?i tên"),
    "retyped": ("đổi loại hình", "?i lo?i hình", "đổi loại"),
    "kept": ("giữ nguyên", "gi?", "còn lại"),
}


def street_line(address: Column) -> Column:
    """The part before the first comma without its leading house number; null as empty."""
    return stripped(F.regexp_replace(stripped(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1))), LEADING_NUMBER, ""))


def components(address: Column) -> dict[str, Column]:
    """Street, ward, district and province of an address, each empty where nothing fits."""
    a = F.coalesce(address, F.lit(""))
    found = {"ward": WARD, "district": DISTRICT, "province": PROVINCE}
    return {"street": street_line(address)} | {k: stripped(F.regexp_extract(a, p, 1)) for k, p in found.items()}


def unit_code(x: Column) -> Column:
    """The number in brackets, without its leading zeros; null where there is none."""
    return F.nullif(F.regexp_extract(x, r"\(0*(\d+)\)", 1), F.lit("")).cast("int")


def bare_name(x: Column) -> Column:
    """A name without a code in brackets at its end."""
    return stripped(F.regexp_replace(x, r"\s*\(\d+\)\s*$", ""))


def unit_type(x: Column) -> Column:
    """The type that a name starts with; empty where none fits."""
    name, out = stripped(F.coalesce(x, F.lit(""))), F.lit("")
    for prefix, kind in reversed(TYPE_PREFIXES):
        out = F.when(name.startswith(prefix), kind).otherwise(out)
    return out


def note_relation(note: Column) -> Column:
    """What a note says became of a unit."""
    n = stripped(F.lower(note))
    has = {k: _any(n, words) for k, words in NOTE_WORDS.items()}
    part = F.when(has["area"] & has["people"], "MERGED_PARTIAL").when(has["area"], "MERGED_AREA").when(has["people"], "MERGED_POPULATION").otherwise("MERGED_PART")
    return (
        F.when(note.isNull() | (note == ""), "RETAINED")
        .when(has["special"], "SPECIAL_ZONE")
        .when(has["whole"] & has["merged"], "MERGED_FULL")
        .when(has["part"], part)
        .when(has["renamed"] & has["retyped"], "RENAMED_TYPE_CHANGED")
        .when(has["renamed"], "RENAMED")
        .when(has["retyped"], "TYPE_CHANGED")
        .when(has["kept"], "RETAINED")
        .when(has["merged"], "MERGED_FULL")
        .otherwise("OTHER")
    )


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(x, F.lit(w))
    return out


def decision(x: Column) -> tuple[Column, Column]:
    """Number and date of a decision: the number with its slash, else the first 100 characters; null where there is no text or no valid date."""
    number = F.nullif(F.regexp_extract(x, r"(\d+/[^\-\s,;]+)", 1), F.lit(""))
    date = F.regexp_extract(x, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    text = F.nullif(x, F.lit(""))
    return F.coalesce(number, F.substring(text, 1, 100)), F.when(text.isNotNull(), F.try_to_timestamp(date, F.lit("d/M/y")).cast("date"))


def with_labels(df: DataFrame, address: str) -> DataFrame:
    """The table with a column for each of LABELS, taken out of the address one after the other, and NUM and STR from what is left; null where nothing fits."""
    df = df.withColumn("__rest", stripped(F.coalesce(F.col(address), F.lit(""))))
    for label, pattern in LABELS.items():
        rest = F.col("__rest")
        value = F.regexp_replace(F.regexp_extract(rest, pattern, 1), r"^[ \-/.,]+|[ \-/.,]+$", "")
        at, whole = F.regexp_instr(rest, F.lit(pattern)), F.length(F.regexp_extract(rest, pattern, 0))
        cut = F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + whole, F.length(rest)))
        df = df.withColumn(label, F.nullif(value, F.lit(""))).withColumn("__rest", F.when(F.col(label).isNotNull(), F.regexp_replace(cut, "^[ ,]+|[ ,]+$", "")).otherwise(rest))
    rest = F.regexp_replace(F.regexp_replace("__rest", r"\s{2,}", " "), r"\s*,\s*,+", ", ")
    df = df.withColumn("__rest", rest).withColumn("NUM", F.nullif(F.regexp_extract("__rest", r"^\s*([0-9]+[A-Za-z]?(?:/[0-9]+[A-Za-z]?)*)", 1), F.lit("")))
    head, number = stripped(F.split_part("__rest", F.lit(","), F.lit(1))), F.col("NUM")
    street = F.when(F.coalesce(head.startswith(number), F.lit(False)), F.regexp_replace(F.substring(head, F.length(number) + 1, F.length(head)), r"^[ \-/]+|[ \-/]+$", "")).otherwise(head)
    return df.withColumn("STR", F.nullif(street, F.lit(""))).drop("__rest")


def number_and_street(x: Column) -> tuple[Column, Column]:
    """A leading house number and what follows it; the whole text as the street where it starts with none."""
    pattern = r"(?iU)^(Số\s)?([\w/.\-]+)"
    number = F.nullif(F.regexp_extract(x, pattern, 2), F.lit(""))
    rest = F.regexp_replace(stripped(F.substring(x, F.length(F.regexp_extract(x, pattern, 0)) + 1, F.length(x))), "^,+|,+$", "")
    return number, F.when(number.isNull(), x).otherwise(F.nullif(rest, F.lit("")))


def peeled(df: DataFrame, address: str, province: str, district: str, ward: str) -> DataFrame:
    """The table with `street` and `postal_code` of an address from whose end country, postal code, province, district and ward are taken.

    A unit is taken if its part has a word for its level or holds, or is held by, the unit's known name; also, without that, as long as
    enough parts are left. Units whose name isn't known are not taken. An address of one part is its own street.
    """

    def at(n: str) -> Column:
        return F.coalesce(F.get("__parts", F.col(n) - 1), F.lit(""))

    def holds(x: Column, *words: str) -> Column:
        return _any(F.lower(x), words)

    df = df.withColumn("__parts", F.transform(F.split(F.regexp_replace(address, r",\s+", ","), ","), lambda p: F.trim(p))).withColumn("__n", F.size("__parts"))
    df = df.withColumn("__n", F.col("__n") - holds(at("__n"), "việt nam", "vietnam", "vn").cast("int"))
    df = df.withColumn("postal_code", F.when(F.size("__parts") >= 2, F.nullif(F.regexp_extract(at("__n"), r"(\d{5,6})$", 1), F.lit(""))))
    # the postal code may share a part with the province, which is then looked at without it
    alone, n = at("__n").rlike(r"^\d{5,6}$"), F.col("__n")
    df = df.withColumn("__parts", F.transform("__parts", lambda p, i: F.when(i == n - 1, F.trim(F.regexp_replace(p, r"\s+\d{5,6}$", ""))).otherwise(p))).withColumn("__n", n - alone.cast("int"))
    levels = ((province, ("tỉnh", "thành phố", "tp"), 1, 3), (district, ("quận", "huyện", "thị xã"), 1, 2), (ward, ("phường", "xã", "thị trấn"), 2, 2))
    for name, words, least, left in levels:
        own, known = at("__n"), F.lower(name)
        sure = (F.col("__n") >= least) & (holds(own, *words) | F.contains(known, F.lower(own)) | F.contains(F.lower(own), known))
        df = df.withColumn("__n", F.col("__n") - (F.col(name).isNotNull() & F.coalesce(sure | (F.col("__n") >= left), F.lit(False))).cast("int"))
    street = F.when(F.col("__n") >= 1, F.array_join(F.slice("__parts", F.lit(1), F.greatest("__n", F.lit(1))), ", ")).otherwise(F.get("__parts", F.lit(0)))
    return df.withColumn("street", F.when(F.size("__parts") >= 2, street).otherwise(F.trim(address))).drop("__parts", "__n")
