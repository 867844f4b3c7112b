"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule has a host and a path; it fits its host and all subdomains if the url's
path starts with the rule's. Written as a key of reversed host labels and path
(``net.example.`` + ``/en/``), a rule covers the interval of the keys that it
prefixes, and two rules are either nested or apart. A url has one key for each of
its host's parent domains that has rules. Rule borders and url keys are sorted
together; the sweep over them knows at each url key the innermost rule that is
open, since at every border it notes the rule left on top of the stack: at the
start of a rule the rule itself, at its end the rule around it. That rule comes
from a sweep over the borders alone, in which the stack's height is a running sum.

The sweep runs apart for each domain with rules, and a domain that holds many of
the urls is swept in parallel slices, each with a copy of the domain's borders.
Slices are dealt by share of all keys, so their number is bounded by ``SLICES``
plus the number of domains.

Defined results. Null urls, and those without ``://``, have an empty host and
path and fit no rule. A host ends at the first ``/``, ``?``, ``#``; only A-Z are
lower-cased; ports and users stay part of it. Of the rules that fit, the one with
the longest host and path together wins, then the longer host. Of equal rules
with different verdicts, block wins. Repeated rows each keep their result; an
empty table gives none; without rules every url gets the default verdict. Other
columns of the urls stay, but those of the names host, path, rule and verdict are
replaced. Urls and rules of any length, with any number of labels, are judged whole, in
time and memory in proportion to their length; a url that many rows share is
judged once, and its verdict is broadcast to them (``skew.join_facts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.llm.skew import join_facts
from recollex.storage import few, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: Slices that a domain holding all keys would be swept in.
SLICES = 2048
#: Most domains with rules that are broadcast; more are copied to ``SALT`` tasks each, among which a domain's urls are dealt.
BROADCAST_DOMAINS = 100_000
SALT = 64
#: Sorts after every key that a rule prefixes.
END = "\U0010ffff"


def _key(path: Column) -> Column:
    """A path as a sort key: the mark of the end, should a path hold it, is spelled out; prefixes stay prefixes."""
    below = "\U0010fffe"
    return F.replace(F.replace(path, F.lit(below), F.lit(below + "0")), F.lit(END), F.lit(below + "1"))


def with_host_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add the columns host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)), "#", 1))
    plain = F.substring_index(rest, "?", 1)
    host = F.substring_index(plain, "/", 1)
    return urls.withColumn("host", F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))).withColumn(
        "path", F.coalesce(F.substring(plain, F.length(host) + 1, F.length(plain)), F.lit(""))
    )


def reversed_host(host: Column) -> Column:
    """``a.example.net`` as ``net.example.a.``; parents are prefixes of their subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _borders(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval: domain, key, turn, top.

    ``top`` is the rule on top of the stack right after the border. Starts push
    and ends pop, so the height of the stack is a running sum; what an end lays
    bare is the last rule that was pushed at the height that is left.
    """
    kind = rules.schema["top"].dataType
    borders = rules.select(
        "domain",
        F.explode(
            F.array(
                F.struct(_key(F.col("path")).alias("key"), F.lit(1).alias("turn"), F.col("top").alias("pushed")),
                F.struct(F.concat(_key(F.col("path")), F.lit(END)).alias("key"), F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("pushed")),
            )
        ).alias("b"),
    ).select("domain", "b.key", "b.turn", "b.pushed")
    along = Window.partitionBy("domain").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("domain", "height").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = borders.withColumn("height", F.sum(2 * F.col("turn") - 1).over(along))
    return swept.select("domain", "key", "turn", F.last("pushed", ignorenulls=True).over(level).alias("top"))


def _meet(keys: DataFrame, facts: DataFrame, broadcast: bool) -> DataFrame:
    """Join of url keys (host, path, domain) with facts of the domains that have rules."""
    if broadcast:
        return keys.join(F.broadcast(facts), "domain")
    dealt = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return keys.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int")).join(dealt, ["domain", "_salt"]).drop("_salt")


def match(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to ``urls``."""
    urls = with_host_path(urls, url)
    rules = (
        rules.filter(F.col("host").isNotNull())
        .select(reversed_host(F.translate("host", UPPER, LOWER)).alias("domain"), F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("domain", "host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("domain", "path", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), F.col("verdict")).alias("top"))
    )
    # Each host and path once, with the urls that have them; urls without a host meet no rule and are never shuffled.
    pairs = materialize(urls.filter("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("__rule_n")), "urls")
    total = pairs.agg(F.coalesce(F.sum("__rule_n"), F.lit(0))).first()[0]
    # A key for each parent domain with as many labels as some rule's has; others meet no rule.
    counts = [r["n"] for r in rules.select(F.size(F.split("domain", r"\.", -1)) - 1).toDF("n").distinct().orderBy("n").collect()]  # different numbers of labels
    wanted = F.filter(F.array(*[F.lit(n) for n in counts]).cast("array<int>"), lambda n: n <= F.size("labels"))
    keys = pairs.withColumn("labels", F.reverse(F.split("host", r"\.", -1))).select(
        "host", "path", F.explode(F.transform(wanted, lambda n: F.concat(F.array_join(F.slice("labels", F.lit(1), n), "."), F.lit(".")))).alias("domain")
    )
    domains = rules.select("domain").distinct()
    broadcast = few(domains, BROADCAST_DOMAINS)
    keys = _meet(keys, domains, broadcast)
    counts = keys.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.sum("n").alias("total"))
    slices = counts.crossJoin(F.broadcast(most)).select("domain", F.ceil(F.col("n") * SLICES / F.col("total")).cast("int").alias("slices"))  # one row
    slices = materialize(slices, "url-slices")
    keys = _meet(keys, slices, broadcast).select("domain", F.pmod(F.xxhash64("host", "path"), "slices").cast("int").alias("slice"), _key(F.col("path")).alias("key"), F.lit(2).alias("turn"), F.lit(None).cast(rules.schema["top"].dataType).alias("top"), "host", "path")
    borders = _borders(rules).join(slices, "domain").select("domain", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "key", "turn", "top", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    # An end border tells that the stack may be empty, which null can't.
    mark = F.struct(F.lit(True).alias("set"), F.col("top"))
    sweep = Window.partitionBy("domain", "slice").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = (
        borders.unionByName(keys)
        .withColumn("open", F.last(F.when(F.col("turn") < 2, mark), ignorenulls=True).over(sweep))
        .filter("turn = 2")
        .select("host", "path", F.col("open.top").alias("found"))
        .filter("found is not null")
    )
    best = pairs.join(swept.groupBy("host", "path").agg(F.max("found").alias("__rule_found")), ["host", "path"], "left")
    columns = [c for c in urls.columns if c not in ("rule", "verdict")]
    told = join_facts(urls.filter("host <> ''").select(*columns), best, ["host", "path"], total=total, n="__rule_n")
    rest = urls.filter("host = ''").select(*columns, F.lit(None).cast(rules.schema["top"].dataType).alias("__rule_found"))
    return told.unionByName(rest).select(*columns, F.col("__rule_found.rule").alias("rule"), F.coalesce("__rule_found.verdict", F.lit(default)).alias("verdict"))
