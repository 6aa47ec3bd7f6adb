"""Secret scans: a random forest removes false positives among candidate strings. DataFrame functions and Spark ML only.

A candidate is a run of at least LONG characters that keys, tokens and hashes are made of, wherever it stands, also behind `=`; a signed token of several parts; what stands for a
password in a url's user-info; or a value without white space or quotes that is assigned: of NAMED_SHORT characters or more after a word like `password` (or `Bearer` behind it), of
SHORT or more in quotes after any `=` or `:`. Values in quotes go on to the quote, others end at `,`, `;`, `<` and `>` as well. So passwords and
short keys are candidates as well, and it is the forest that turns prose, paths, digests and placeholders away.

Features: length, shares of character classes and of distinct characters; how likely the candidate's character transitions are among the
corpus's words; how much of it words of the corpus's dictionary cover; whether it stands in a path or url; and what the words before
it say. Dictionary and transitions come from a `Language`, learned from word counts over all texts, of which the DICTIONARY most frequent words
are kept. The weights of neighbouring words are log odds learned from the labelled findings, of the NEIGHBOURS words that are most frequent there.

The forest is trained on labelled findings: rows of `before`, `candidate`, `after` and `label`. Production trains on
`synthetic_findings`, a bounded set of TRAIN_ROWS rows made of seeded digests, as no table labels secrets; a test measures precision and recall on
findings that another generator made.

Null and empty texts have no candidates. Texts are scanned whole, and each occurrence is a finding of its own, counted from
0 in the order of the text, so ties and repeated rows keep theirs. Extra columns are not returned. An empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.llm.store import quoted, written

LONG = 20
SHORT = 6
NAMED_SHORT = 4
CONTEXT = 40
DICTIONARY = 5000
NEIGHBOURS = 256
TRAIN_ROWS = 12_000
SEED = 7
_CHARS = "A-Za-z0-9+/_-"
#: A run with its padding, wherever it stands; a name that something is assigned to is none.
_RUN = f"(?<![{_CHARS}])[{_CHARS}]{{{LONG},}}+(?!=[\\w\"'])={{0,2}}"
#: A signed token of two or three parts.
_PARTS = rf"(?<![{_CHARS}])eyJ[{_CHARS}]{{6,}}\.[{_CHARS}]{{6,}}(?:\.[{_CHARS}]*)?"
#: Words that a credential is assigned to, and words between them and it (fixed values).
_NAMES = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth)[\w-]{0,24}"
_SCHEME = r"(?i:bearer|basic)"
_NAMED = rf"{_NAMES}[\"']?\s*(?:[=:]>?|\bis\b)\s*[\"']?(?:{_SCHEME}\s+)?"
_QUOTED = r"\s*[=:]\s*[\"']"
#: A user's name in a url, before the password.
_USER = r"://[^\s:/?#@\"'<>]*:"
#: Values go on to white space or a quote; outside of quotes also to what ends a value in a list or markup.
_IN_QUOTES, _PLAIN, _IN_URL = r"[^\s\"']", r"[^\s\"'<>,;]", r"[^\s@\"'<>]"
_NAMED_VALUE = rf"(?:(?<=[\"']){_IN_QUOTES}{{{NAMED_SHORT},}}|{_PLAIN}{{{NAMED_SHORT},}})"
_HEADS = rf"{_NAMED}(?={_NAMED_VALUE}$)|{_QUOTED}(?={_IN_QUOTES}{{{SHORT},}}$)|{_USER}(?={_IN_URL}{{{NAMED_SHORT},}}$)"
_FOUND = rf"{_NAMED}{_NAMED_VALUE}|(?<=[\w\"']){_QUOTED}{_IN_QUOTES}{{{SHORT},}}|{_USER}{_IN_URL}{{{NAMED_SHORT},}}(?=@)|{_PARTS}|{_RUN}"
FEATURES = ("length", "digits", "upper", "symbols", "distinct", "turns", "transitions", "covered", "hexadecimal", "path", "neighbours", "named", "assigned", "quoted", "user")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0"
_SIDE = len(_ALPHABET) + 1
_LETTERS = "A-Za-zß-öø-ÿÀ-ÖØ-Þ"


@dataclass(frozen=True)
class Language:
    """Frequent words, and the log probability of each character after each other one, row by row of _ALPHABET with all other characters first."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


def _codes(text: Column) -> Column:
    """Place of each character in _ALPHABET from 1, digits all as 0, others 0."""
    plain = F.regexp_replace(F.lower(text), "[0-9]", "0")
    return F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(_ALPHABET), c))


def learn_language(docs: DataFrame, size: int = DICTIONARY) -> Language:
    """Words are counted over all texts; `size` of them, and a table of _SIDE squared transitions of theirs, come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zß-öø-ÿ]{3,24}"), F.lit(0))).alias("w"))
    top = written(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size), "dictionary")
    codes = top.select("n", _codes(F.col("w")).alias("c"))
    pairs = codes.select("n", F.explode(F.zip_with(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", F.lit(2), F.size("c")), lambda x, y: x * _SIDE + y)).alias("pair")).groupBy("pair").agg(F.sum(F.log2(F.col("n") + 1)).alias("n"))
    found = {int(r.pair): float(r.n) for r in pairs.collect()}
    table = []
    for x in range(_SIDE):
        row = [found.get(x * _SIDE + y, 0.0) + 0.5 for y in range(_SIDE)]
        table += [round(math.log(v / sum(row)), 4) for v in row]
    return Language(tuple(sorted(r.w for r in top.select("w").collect())), tuple(table))


def _share(candidate: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(candidate, f"[^{kept}]", "")) / F.length(candidate)


def _before_words(before: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(before), F.lit("[a-z]{2,}"), F.lit(0)))


def learn_neighbours(findings: DataFrame, most: int = NEIGHBOURS) -> dict[str, float]:
    """For the words that most often stand before labelled findings, the log odds that a secret follows."""
    odds = F.log((F.sum("label") + 1) / (F.count(F.lit(1)) - F.sum("label") + 1))
    words = findings.select("label", F.explode(_before_words(F.coalesce(F.col("before"), F.lit("")))).alias("w"))
    return {r.w: float(r.odds) for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.round(odds, 4).alias("odds")).orderBy(F.desc("n"), "w").limit(most).collect()}


def with_features(findings: DataFrame, language: Language, neighbours: dict[str, float]) -> DataFrame:
    """Each finding as a struct `finding` with the vector of its `features`, null contexts as empty."""
    c, before, after = F.col("candidate"), F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit(""))
    turns = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", "!")
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", "!")), F.lit(f"[{_LETTERS}]{{3,}}"), F.lit(0))
    known = F.expr(f"filter(parts, x -> x IN ({', '.join(repr(w) for w in language.words or ('',))}))")
    covered = F.aggregate(known, F.lit(0), lambda n, p: n + F.length(p))
    table = F.expr("array(" + ", ".join(f"{v}D" for v in language.transitions) + ")")
    codes = _codes(c)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(1))), F.slice(codes, F.lit(2), F.size(codes)), lambda x, y: F.coalesce(F.element_at(table, (x * _SIDE + y + 1).cast("int")), F.lit(0.0)))
    weights = F.expr("map(" + ", ".join(f"'{w}', {v}D" for w, v in sorted(neighbours.items())) + ")") if neighbours else F.expr("map('', 0D)")
    found = {
        "length": F.length(c).cast("double"),
        "digits": _share(c, "0-9"),
        "upper": _share(c, "A-Z"),
        "symbols": 1 - _share(c, f"0-9{_LETTERS}"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64)),
        "turns": (F.length(turns) - F.length(c)) / F.length(c),
        "transitions": F.aggregate(steps, F.lit(0.0), lambda n, x: n + x) / F.greatest(F.size(steps), F.lit(1)),
        "covered": covered / F.length(c),
        "hexadecimal": _share(c, "0-9a-fA-F"),
        "path": (before.rlike(r"[/\\.]\s*$|://\S*$") | c.rlike(r"^[^/]*/[^/]+|\.[a-z]{2,4}$")).cast("double"),
        "neighbours": F.aggregate(_before_words(before), F.lit(0.0), lambda n, w: n + F.coalesce(F.try_element_at(weights, w), F.lit(0.0))),
        "named": before.rlike(rf"{_NAMES}\W*(?:is\W*)?(?:{_SCHEME}\W*)?$").cast("double"),
        "assigned": before.rlike(r"[=:]>?\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "user": (before.rlike(rf"{_USER}$") & after.startswith("@")).cast("double"),
    }
    held = findings.select(F.struct(*quoted(findings.columns)).alias("finding"), *(F.col(n) for n in ("candidate", "before", "after")), parts.alias("parts"))
    return held.select("finding", array_to_vector(F.array(*(found[f] for f in FEATURES))).alias("features"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at, before, candidate and after of every candidate of every text."""
    # a text without a candidate is passed over before the costlier search with its context
    some = docs.select("doc_id", "text").filter(F.col("text").rlike(_FOUND))
    two = some.select("doc_id", F.split("text", _FOUND).alias("gaps"), F.regexp_extract_all("text", F.lit(_FOUND), F.lit(0)).alias("runs"))

    def finding(run: Column, i: Column) -> Column:
        head = F.regexp_extract(run, f"^(?:{_HEADS})", 0)
        before = F.concat(F.get("gaps", i), head)
        return F.struct(i.cast("long").alias("at"), F.right(before, F.lit(CONTEXT)).alias("before"), F.substring(run, F.length(head) + 1, F.length(run)).alias("candidate"), F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"))

    return two.select("doc_id", F.explode(F.transform("runs", finding)).alias("f")).select("doc_id", "f.*")


def synthetic_findings(spark: SparkSession, words: tuple[str, ...], rows: int = TRAIN_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled findings of ten kinds of secrets and ten kinds of strings that look like some; `words` are what prose, paths and names are made of."""
    d1, d2 = F.sha1(F.concat(F.lit(f"{seed}-a-"), "id")), F.sha2(F.concat(F.lit(f"{seed}-b-"), "id"), 256)
    pick = lambda by, n: F.pmod(F.xxhash64(F.lit(f"{seed}-{by}"), "id"), F.lit(n)).cast("int")
    one = lambda by, *of: F.element_at(F.array(*map(F.lit, of)), pick(by, len(of)) + 1)
    known = F.col("known")

    def word(by: object) -> Column:
        return F.element_at(known, F.pmod(F.xxhash64(F.lit(f"{seed}-{by}-w"), "id"), F.size(known)).cast("int") + 1)

    base64 = F.base64(F.unhex(d2))
    long64 = F.concat(F.regexp_replace(base64, "=+$", ""), F.base64(F.unhex(d1)))
    part = lambda s, n: F.substring(s, F.lit(1), n)
    symbol = one("sy", "!", "#", "$", "&", "*", "@", "%", "?", ".", "-", "_")
    key = F.concat(one("kn", "api_key", "token", "TOKEN", "secret", "auth", "password", "PASSWORD", "access_key", "private_key", "passwd", "client_secret", "db_pass"), one("ks", " = ", "=", ": ", " : ", " is ", '": '), one("kq", "", '"', "'", '"'))
    lead = one("ld", "", "the ", "and ", "set ", "de la ", "with the ", "config: ", "\n", "export ")
    other = F.concat(one("on", "commit", "sha1", "md5", "sha256", "checksum", "etag", "revision", "digest", "build", "hash", "merge", "fingerprint"), one("os", " ", ": ", "=", " = ", '="', ":"))
    name = F.concat(one("nn", "class", "id", "name", "href", "title", "source", "lang", "version", "label", "key", "type", "color"), one("ns", '="', " = '", ': "', "='"))
    leet = F.translate(F.initcap(F.concat(word(1), part(word(2), pick("ll", 4)))), "aeio", "4310")
    joined = lambda sep, n: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(known, F.pmod(F.xxhash64(F.lit(seed), "id", i), F.size(known)).cast("int") + 1)), sep)
    camel = F.regexp_replace(F.initcap(joined(" ", pick("cn", 4) + 2)), " ", "")
    uuid = F.concat_ws("-", part(d1, F.lit(8)), F.substring(d1, 9, 4), F.substring(d1, 13, 4), F.substring(d1, 17, 4), F.substring(d1, 21, 12))
    dash = one("dd", "-", ".", "", ":")
    held = F.concat(one("ph", "your_api_key_here", "changeme", "xxxxxxxxxxxxxxxx", "example_password", "********", "<your-token>", "${TOKEN}", "required", "undefined", "process.env.KEY", "settings.SECRET", "insert-key-here", "placeholder", "None", "disabled"), one("p2", "", "", "s", "."))
    kinds = [
        (key, F.when(pick("h", 3) == 0, part(d2, F.lit(32))).when(pick("h", 3) == 1, F.when(pick("hu", 5) == 0, F.upper(d1)).otherwise(d1)).otherwise(d2), 1),
        (key, part(long64, pick("bl", 40) + 18), 1),
        (F.when(pick("pk", 3) == 0, lead).otherwise(key), F.concat(one("pf", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_"), part(F.translate(long64, "+/", "Zq"), pick("pl", 16) + 16)), 1),
        (key, F.concat(part(leet, F.lit(11)), symbol, pick("pd", 9999).cast("string"), F.when(pick("px", 3) == 0, "!").otherwise("")), 1),
        (key, F.concat(part(F.translate(long64, "+/", "$!"), pick("rl", 9) + 4), symbol, F.substring(long64, 20, 4)), 1),
        (key, F.concat(F.lit("eyJ"), part(long64, F.lit(30)), F.lit("."), F.regexp_replace(base64, "[+/=]", "x"), F.lit("."), part(d2, F.lit(20))), 1),
        (F.concat(one("ev", "export ", "", "ENV ", "-e ", "url?", "?x=1&"), one("en", "GITHUB", "CI_KEY", "sig", "DEPLOY", "STRIPE", "client", "SIGNATURE", "SLACK", "key"), F.lit("=")), F.when(pick("eh", 3) == 0, part(d2, pick("el", 44) + 20)).otherwise(F.concat(one("pf", "", "", "ghp_", "sk_live_", "xoxb-"), part(F.translate(long64, "+/", "Zq"), pick("pl", 24) + 20))), 1),
        (F.concat(one("us", "postgres://", "mysql://", "https://", "redis://", "amqp://", "ftp://"), word(4), F.lit(":")), F.when(pick("uh", 2) == 0, F.concat(part(leet, pick("ul", 8) + 4), pick("ud", 99).cast("string"))).otherwise(part(F.translate(long64, "+/", "$!"), pick("rl", 20) + 5)), 1),
        (key, F.concat(part(leet, pick("sl", 3) + 2), one("sp", ",", ";", "<", "1", "7"), part(d1, pick("sm", 3) + 2)), 1),
        (F.concat(F.lit("Authorization: "), one("sc", "Bearer ", "Basic ")), F.when(pick("jw", 2) == 0, F.concat(F.lit("eyJ"), part(long64, F.lit(30)), F.lit("."), F.regexp_replace(base64, "[+/=]", "x"), F.lit("."), part(d2, F.lit(20)))).otherwise(long64), 1),
        (other, F.when(pick("h", 3) == 0, part(d2, F.lit(32))).when(pick("h", 3) == 1, d1).otherwise(d2), 0),
        (lead, joined("-", pick("jn", 6) + 3), 0),
        (F.concat(lead, one("pt", "/", "file /", "https://host/", "./", "path: '")), F.concat(joined("/", pick("pn", 4) + 3), one("pe", "", ".html", ".py", "/index", ".jpg")), 0),
        (one("rb", "\n", " ", "# ", "", '= "'), F.repeat(one("rc", "-", "=", "_", "x", "ab", "0", "/"), pick("rn", 40) + 20), 0),
        (key, held, 0),
        (F.concat(one("un", "id", "uuid", "request", "trace", "session"), one("us", ": ", "=", '="', " ")), uuid, 0),
        (F.when(pick("ca", 2) == 0, name).otherwise(lead), F.when(pick("cs", 3) == 0, F.lower(F.regexp_replace(camel, "(?<=[a-z])(?=[A-Z])", "_"))).otherwise(camel), 0),
        (F.concat(one("dn", "date", "phone", "isbn", "id", "size", "time", "version"), one("ds", ": '", '="', " = '")), F.concat(pick("d1", 9999).cast("string"), dash, (pick("d2", 90) + 10).cast("string"), dash, (pick("d3", 90) + 10).cast("string"), dash, (pick("d4", 9000) + 1000).cast("string")), 0),
        (F.concat(one("bn", "data:image/png;base64,", "base64,", "integrity=\"sha256-", "data:font/woff;base64,")), F.concat(long64, base64), 0),
        (F.concat(key, F.lit("")), F.concat(word(3), one("we", "", ".", "ed", "ing")), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))

    made = F.lit(None)
    for k, (before, candidate, label) in enumerate(kinds):
        made = F.when(kind == k, F.struct(before.alias("before"), candidate.alias("candidate"), F.lit(label).alias("label"))).otherwise(made)
    # each kind's parts stand once in the plan, which what surrounds a finding then refers to
    lead_in = F.when(pick("lp", 2) == 0, "").otherwise(F.concat(word(7), F.lit(" "), word(8), F.lit(" ")))
    # the words are a row of a table, as a literal they would stand in the plan once for each use
    listed = spark.range(1).agg(F.first(F.split(F.lit(" ".join(words or ("some", "words"))), " ")).alias("known"))
    rows_ = spark.range(rows).crossJoin(F.broadcast(listed)).select(made.alias("made"), lead_in.alias("lead_in"), one("af", "", " ", "\n", " and ", ")").alias("tail"))
    quote = F.right("made.before", F.lit(1))
    after = F.when(quote.isin('"', "'"), quote).when(F.col("made.before").rlike(rf"{_USER}$"), "@host").otherwise(F.col("tail"))
    found = rows_.select(F.right(F.concat("lead_in", "made.before"), F.lit(CONTEXT)).alias("before"), "made.candidate", after.alias("after"), F.col("made.label").cast("double").alias("label"))
    return found.filter(F.length("candidate") >= SHORT)


@dataclass(frozen=True)
class Scanner:
    forest: RandomForestClassificationModel
    language: Language
    neighbours: dict[str, float]


def train(findings: DataFrame, language: Language, trees: int = 40, depth: int = 9) -> Scanner:
    """A forest of labelled findings, whose number the caller bounds."""
    neighbours = learn_neighbours(findings)
    rows = with_features(findings, language, neighbours).select("features", F.col("finding.label").alias("label"))
    return Scanner(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(rows), language, neighbours)


def classify(findings: DataFrame, scanner: Scanner) -> DataFrame:
    """The findings with `score`, the forest's share of votes for a secret, and `is_secret`."""
    scored = scanner.forest.transform(with_features(findings, scanner.language, scanner.neighbours))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("finding.*", score.alias("score"), (score > 0.5).alias("is_secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    language = learn_language(docs)
    return classify(candidates(docs), train(synthetic_findings(spark, language.words), language))
