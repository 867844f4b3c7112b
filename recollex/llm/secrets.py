"""Secret scans: patterns propose candidates and a random forest removes false ones, natively.

Candidates are private key blocks, values assigned to words such as ``token`` or
``password``, and runs of 16 or more characters of the kinds that keys are made
of, with a digit or with three changes from small to capital letters. A text is cut at its candidates, so each comes with its neighbourhood, and
all work on a document happens in its own row: nothing is exploded or shuffled.

Features: length; shares of digits, of hexadecimal digits and of distinct
characters; changes between kinds of characters, and common letter pairs among
the transitions; share covered by dictionary words; path separators and file
endings; known key prefixes; quotes, assignments, and words before the candidate
that speak for or against a secret. The forest is fitted by Spark's own learner
on labelled findings (text with one candidate, label); it is then written out as
conditional expressions. Where no labelled findings are given, ``findings`` makes
some from a rule.

Defined results. Null and empty texts have no findings. A candidate counts with a
vote of at least half of the trees. Findings are ordered by their place; repeated
rows have equal findings. Offsets and lengths count characters. An empty table
gives none. Texts of any length are scanned whole, in time that grows with their
length. Other columns stay as they are; the output column replaces one of its
name, and names that begin with ``__secret_`` are for the scan's own use.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = 15
DEPTH = 6
FINDINGS = 3000
SEED = 7
MASK = "[SECRET]"
LEFT, RIGHT = 48, 24

# Words of the patterns and features.
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "api[_-]?key", "access[_-]?key", "auth[_-]?key", "credential"]
FOR = ["password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "login"]
AGAINST = ["commit", "sha", "checksum", "hash", "md5", "digest", "uuid", "guid", "version", "revision", "build", "isbn", "order", "invoice", "example", "sample", "page", "file", "path", "url", "http", "www", "mail"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "ya29", "eyJ", "SG\\.", "npm_", "pypi-", "-----BEGIN"]
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur"]
DICTIONARY = ["your", "here", "change", "example", "sample", "placeholder", "password", "secret", "token", "test", "user", "name", "file", "path", "data", "value", "string", "default", "config", "request", "response", "index", "page", "home", "local", "server", "client", "http", "https", "html", "json", "xxxx", "from", "with", "that", "this", "tion", "ment", "ness", "able", "ing", "the", "and", "for", "get", "set", "new", "old", "key", "api", "app", "web", "com", "org", "net", "www", "lich", "keit", "heit", "ung", "eux", "eau", "elle", "que", "ción", "mente"]

_LEAD = "(?:" + "|".join(KEYWORDS) + r")[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
_RUN = r"(?<![A-Za-z0-9+/_~.=-])(?=[A-Za-z0-9+/_~.=-]{16})(?:(?=[A-Za-z+/_~.=-]*[0-9])|(?=(?:[A-Za-z+/_~.=-]*?[a-z][A-Z]){3}))[A-Za-z0-9+/_~.=-]{16,}"
_FIRST = "(?=[" + "".join(sorted({c for w in KEYWORDS for c in (w[0], w[0].upper())})) + "])"
CANDIDATE = f"{_FIRST}(?i:{_LEAD})[^\\s\"'<>]{{6,}}|{_BLOCK}|{_RUN}"


def _count(v: Column, pattern: str) -> Column:
    return F.regexp_count(v, F.lit(pattern)).cast("double")


def features(v: Column, left: Column, right: Column) -> list[Column]:
    """Numbers that describe a candidate and its neighbourhood."""
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    covered = n - F.length(F.regexp_replace(v, "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return [
        n,
        _count(v, "[0-9]") / n,
        _count(v, "[0-9a-fA-F]") / n,
        F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        (_count(v, "[0-9](?=[^0-9])") + _count(v, "[a-z](?=[^a-z])") + _count(v, "[A-Z](?=[^A-Z])") + _count(v, "[^0-9A-Za-z](?=[0-9A-Za-z])")) / n,
        _count(v, "(?i)(?=" + "|".join(PAIRS) + ")") / n,
        covered / n,
        _count(v, r"[/\\.]"),
        F.coalesce(v.rlike(r"(?i)\.[a-z]{2,4}$") | F.rlike(F.substring(left, -8, 8), F.lit(r"(?:/|\\|@|://)$")) | F.rlike(right, F.lit(r"^[@/\\]")), F.lit(False)).cast("double"),
        v.rlike("^(?:" + "|".join(PREFIXES) + ")").cast("double"),
        F.rlike(left, F.lit(r"[:=]\s*[\"']?$")).cast("double"),
        F.rlike(left, F.lit(r"[\"'`]$")).cast("double"),
        _count(left, "(?i)(?:" + "|".join(FOR) + ")"),
        _count(left, r"(?i)\b(?:" + "|".join(AGAINST) + ")"),
        _count(v, "[0-9]").cast("double"),
        _count(v, r"(?i)x{4,}|\*{3,}|\.{3,}|\$\{|\{\{|%\w+%|={4,}|-{8,}"),
    ]


def with_candidates(docs: DataFrame, *, text: str = "text", out: str = "candidates") -> DataFrame:
    """Add ``out``: array of (value, left, right, before, features); before: characters of the match that aren't the value."""
    pattern = F.lit(CANDIDATE)
    found = docs.withColumn("__secret_m", F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>")))
    found = found.withColumn("__secret_s", F.when(F.size("__secret_m") > 0, F.split(text, CANDIDATE, -1)))

    def describe(m: Column, i: Column) -> Column:
        value = F.regexp_replace(m, f"^(?i:{_LEAD})", "")
        before = F.length(m) - F.length(value)
        return F.struct(
            value.alias("value"),
            F.concat(F.substring(F.element_at("__secret_s", i + 1), -LEFT, LEFT), F.substring(m, F.lit(1), before)).alias("left"),
            F.substring(F.element_at("__secret_s", i + 2), 1, RIGHT).alias("right"),
            before.alias("before"),
        )

    found = found.withColumn("__secret_d", F.transform("__secret_m", describe))
    return found.withColumn(
        out, F.transform("__secret_d", lambda d: F.struct(d["value"].alias("value"), d["left"].alias("left"), d["before"].alias("before"), F.array(*features(d["value"], d["left"], d["right"])).alias("features")))
    ).drop("__secret_d")


# --- forest -----------------------------------------------------------------


def findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(text, label): labelled findings made from a rule; about half are secrets."""
    r = "(i * 2654435761 % 4294967296)"
    words = "array('alpha','stone','river','theron','ontion','idea','under','lichten','eauville','market','signal','ceder','morgen','ciones','vector','thread')"
    word = lambda k: f"{words}[cast(pmod(xxhash64(i, {k}), 16) as int)]"
    hexa = {32: "md5(cast(i as string))", 40: "sha1(cast(i as string))", 64: "sha2(cast(i as string), 256)"}
    base = "regexp_replace(base64(unhex(sha2(cast(i as string), 256))), '=', '')"
    lead = "array('token = \"','secret: ','api_key=','password = \"','TOKEN = \"','access_key: \"','\"secret\": \"','passwd=','Authorization: Bearer ','private key ')[cast(pmod(xxhash64(i, 1), 10) as int)]"
    plain = "array('commit ','sha256: ','checksum ','md5 = ','digest ','revision ','build ','uuid ')[cast(pmod(xxhash64(i, 2), 8) as int)]"
    letters = f"substring(regexp_replace({base}, '[^A-Za-z]', ''), 1, cast(16 + pmod(i, 20) as int))"
    block = f"concat('-----BEGIN RSA PRIVATE KEY-----\\n', {base}, '\\n', substring({base}, 5, 30), '=\\n-----END RSA PRIVATE KEY-----')"
    strong = f"array({hexa[40]}, {hexa[40]}, {hexa[32]}, {hexa[64]}, upper({hexa[40]}), {base}, substring({base}, 1, 24), concat('AKIA', upper(substring({hexa[40]}, 1, 16))), concat('ghp_', substring({base}, 1, 36)), concat({word(3)}, substring({base}, 1, 6), '!', pmod(i, 97)), {letters}, {block})[cast(pmod(xxhash64(i, 4), 12) as int)]"
    weak = f"array({hexa[40]}, {hexa[32]}, {hexa[64]}, {hexa[40]})[cast(pmod(xxhash64(i, 5), 4) as int)]"
    prose = f"concat({word(6)}, {word(7)}, {word(8)})"
    false = f"""array(
        concat({plain}, {weak}), concat('/usr/local/', {word(6)}, '/', {word(7)}, '-', {word(8)}, '.txt'),
        concat('https://', {word(6)}, '.example.com/', {word(7)}, '/', pmod(i, 9973)), {prose}, upper({prose}), concat({prose}, '.'),
        concat(pmod(xxhash64(i, 9), 10000) + 10000, pmod(xxhash64(i, 10), 10000) + 10000, pmod(xxhash64(i, 11), 10000000) + 10000000),
        concat({word(6)}, '.', pmod(i, 100), '@mail', pmod(i, 10), '.example.com'), concat({lead}, 'your_', {word(7)}, '_here'),
        concat({lead}, 'xxxxxxxxxxxxxxxx'), concat({lead}, '${{', upper({word(6)}), '_KEY}}'), concat({word(6)}, '_', {word(7)}, '_', {word(8)}, '_value'),
        concat(date_add(date'2020-01-01', cast(pmod(i, 2000) as int)), 'T', lpad(pmod(i, 24), 2, '0'), ':00:00.000'), '====================', '--------------------', concat({word(6)}, '-', {word(7)}, '/', {word(8)}),
        concat({word(6)}, initcap({word(7)}), initcap({word(8)}), initcap({word(9)})), concat(initcap({word(6)}), initcap({word(7)}), initcap({word(8)}), initcap({word(9)}), 'Factory')
    )[cast(pmod(xxhash64(i, 12), 18) as int)]"""
    context = f"concat({word(13)}, ' ', {word(14)}, case when pmod(i, 3) = 0 then '. ' else ' ' end)"
    rows = spark.range(n).selectExpr("id as i").selectExpr(
        "i", f"{r} % 2 as label", f"{context} as before", f"case when {strong} like '-----%' then {strong} else concat({lead}, {strong}) end as good", f"{false} as bad"
    )
    return rows.selectExpr("concat(before, case when label = 1 then good else bad end, case when pmod(i, 2) = 0 and rlike(case when label = 1 then good else bad end, '\"') then '\" ' else ' ' end, before) as text", "cast(label as double) as label")


def fit(labelled: DataFrame, *, text: str = "text", label: str = "label", trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Trees fitted on labelled findings, as nested tuples (feature, threshold, below, above) with votes 0 and 1 as leaves.

    Of a text with several candidates the last one is labelled.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = with_candidates(labelled.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label")).dropna()).filter(F.size("candidates") > 0)
    rows = rows.select(array_to_vector(F.try_element_at("candidates", F.lit(-1))["features"]).alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    return [_parse(tree.toDebugString) for tree in model.trees]


def _parse(printed: str) -> tuple | float:
    """A tree from its printed form."""
    lines = [x.strip() for x in printed.splitlines()[1:]]
    at = 0

    def node() -> tuple | float:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        below = node()
        at += 1  # the line with Else
        return int(feature), float(threshold), below, node()

    return node()


def vote(trees: list, f: Column) -> Column:
    """Share of the trees that call a candidate with features ``f`` a secret."""

    def branch(tree: tuple | float) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, below, above = tree
        return F.when(F.get(f, F.lit(feature)) <= threshold, branch(below)).otherwise(branch(above))

    total = branch(trees[0])
    for tree in trees[1:]:
        total = total + branch(tree)
    return total / len(trees)


# --- scans ------------------------------------------------------------------


def _kind(value: Column) -> Column:
    return (
        F.when(value.startswith("-----BEGIN"), "private_key").when(value.rlike("^A[KS]IA[0-9A-Z]{12,}"), "cloud_key").when(value.rlike("^gh[pousr]_"), "hosting_token")
        .when(value.rlike(r"^eyJ[\w-]+\."), "web_token").when(value.rlike("^[0-9a-fA-F]+$"), "hexadecimal").otherwise("other")
    )


def _scored(docs: DataFrame, trees: list, text: str) -> DataFrame:
    """Add ``__secret_c``: array of (value, before, score). The score is in the array that later steps run over, not in another
    column: Spark may move the expression of such a column into their lambdas and then evaluate all of it for each element."""
    found = with_candidates(docs, text=text, out="__secret_f")
    return found.withColumn("__secret_c", F.transform("__secret_f", lambda c: F.struct(c["value"].alias("value"), c["before"].alias("before"), vote(trees, c["features"]).alias("score"))))


def scan(docs: DataFrame, trees: list, *, text: str = "text", out: str = "findings") -> DataFrame:
    """Add ``out``: array of (start, length, kind, score, sha256), start from 0."""
    columns = [c for c in docs.columns if c != out]
    scored = _scored(docs, trees, text)
    # Where each candidate's match begins: a running sum over pieces and matches, one step a candidate.
    begin = F.struct(F.length(F.element_at("__secret_s", 1)).alias("at"), F.array().cast("array<int>").alias("all"))
    steps = F.arrays_zip(F.transform("__secret_m", F.length).alias("m"), F.transform(F.slice("__secret_s", F.lit(2), F.size("__secret_m")), F.length).alias("s"))
    run = F.aggregate(steps, begin, lambda a, x: F.struct((a["at"] + x["m"] + x["s"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    scored = scored.withColumn("__secret_b", F.when(F.size("__secret_m") > 0, run))

    def describe(c: Column, at: Column) -> Column:
        return F.when(c["score"] >= 0.5, F.struct((at + c["before"]).alias("start"), F.length(c["value"]).alias("length"), _kind(c["value"]).alias("kind"), F.round(c["score"], 6).alias("score"), F.sha2(c["value"], 256).alias("sha256")))

    found = F.when(F.size("__secret_m") > 0, F.filter(F.zip_with("__secret_c", "__secret_b", describe), lambda x: x.isNotNull()))
    empty = F.array().cast("array<struct<start:int,length:int,kind:string,score:double,sha256:string>>")
    return scored.withColumn("__secret_o", F.coalesce(found, empty)).select(*columns, F.col("__secret_o").alias(out))


def redact(docs: DataFrame, trees: list, *, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with each finding replaced by ``mask``; other texts are unchanged."""
    columns = docs.columns
    scored = _scored(docs, trees, text)
    hidden = F.transform(
        F.arrays_zip(F.col("__secret_m").alias("m"), F.slice("__secret_s", F.lit(1), F.size("__secret_m")).alias("s"), F.col("__secret_c").alias("c")),
        lambda x: F.concat(x["s"], F.when(x["c"]["score"] >= 0.5, F.concat(F.substring(x["m"], F.lit(1), x["c"]["before"]), F.lit(mask))).otherwise(x["m"])),
    )
    new = F.when(F.exists("__secret_c", lambda c: c["score"] >= 0.5), F.concat(F.array_join(hidden, ""), F.element_at("__secret_s", -1))).otherwise(F.col(text))
    return scored.withColumn(text, new).select(*columns)
