"""URL allow and block rules by a sort-merge range join.

A host is written backwards, label by label (``m.example.org`` is
``org.example.m.``), and a rule's prefix then is an interval of keys. A url has
one point for each parent domain of its host, down to as many labels as a rule's host has: that domain's key and the path. All
intervals nest or are disjoint, so that one sweep over the sorted keys finds what fits,
with a stack of the rules that are open: a rule's first key pushes it, its last one pops it, and the top at a
point is the longest rule of that domain that fits. The longest over a url's domains wins.

Points and bounds are dealt together by ranges of keys, which are written down; equal
keys are dealt by a hash, so that no host or path, however common, is swept by one task.
A range begins with the stack that the ranges before it leave: the rules whose key is a prefix of the
range's first key, found by an equi-join on those prefixes. A rule is copied only to ranges that begin inside of it.
The stack is held by levels: the depth is the running sum of pushes and pops, and the top at depth d the last
rule that was pushed to d.

Only distinct hosts and paths are swept. Pages get their verdict by a join in which common ones are cut into pieces.

Null urls and such without ``://`` have empty host and path and no rule fits them;
where none fits the verdict is ``allow``. Repeated rules count once; of two rules
with one host and path ``block`` wins. Of fitting rules of equal length the one with the longer
host wins. Rules that are null or have no host fit nothing. Repeated rows are each judged; urls are taken whole,
however long. An empty table gives no rows. Extra columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialise, read, shuffle_partitions, spread_join

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DEFAULT = "allow"
#: Between the host and the path of a key.
BETWEEN = "\x01"
#: The byte, which no UTF-8 has, that sorts after every continuation of a prefix.
AFTER = "FF"
#: Kinds of events, in the order in which they come at one key.
POP, PUSH, POINT = 0, 1, 2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _backwards(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _key(domain: Column, path: Column) -> Column:
    return F.encode(F.concat(domain, F.lit(BETWEEN), path), "utf-8")


def keyed_rules(spark: SparkSession, rules) -> DataFrame:
    """``key binary, labels, top struct<n,host_n,rule,verdict>`` of each rule; ``labels`` are those of its host."""
    given = rules if isinstance(rules, DataFrame) else spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])))
    cut = F.locate("/", F.col("rule"))
    parts = given.where(F.col("rule").isNotNull()).select(
        "rule", "verdict", F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")).alias("host"),
        F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(F.lit("")).alias("path"),
    )
    one = parts.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    top = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"), "rule", "verdict")
    return one.select(_key(_backwards(F.split("host", r"\.")), F.col("path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), top.alias("top"))


def sweep(points: DataFrame, rules: DataFrame, parts: int) -> DataFrame:
    """``points`` (``key binary`` and others) with ``top``: the longest of the keyed ``rules`` that is a prefix of the key; null if none is."""
    others = [c for c in points.columns if c != "key"]
    pushes = rules.select("key", F.lit(PUSH).alias("kind"), "top")
    pops = rules.select(F.concat("key", F.unhex(F.lit(AFTER))).alias("key"), F.lit(POP).alias("kind"))
    events = points.withColumns({"kind": F.lit(POINT), "tie": F.xxhash64(*others)}).unionByName(pushes.unionByName(pops, allowMissingColumns=True), allowMissingColumns=True)
    dealt = materialise(events.repartitionByRange(parts, "key", "kind", "tie").withColumn("part", F.spark_partition_id()))
    # a range's first stack; a push that begins the range pushes itself
    starts = dealt.groupBy("part").agg(F.min(F.struct("key", "kind")).alias("first"))
    up_to = F.octet_length("first.key") - F.when(F.col("first.kind") == POINT, 0).otherwise(1)
    # only prefixes as long as some rule's key: there are no more such lengths than the longest rule has bytes
    lengths = F.array(*[F.lit(r[0]) for r in rules.select(F.octet_length("key")).distinct().collect()]).cast("array<int>")
    prefixes = starts.select("part", "first", F.explode(F.filter(lengths, lambda n: n <= up_to)).alias("n")).select("part", F.substring(F.col("first.key"), F.lit(1), F.col("n")).alias("key"))
    open_ = prefixes.join(pushes, "key").select("key", "kind", "top", "part")
    order = ["key", "kind", "tie"]
    depth = F.sum(F.when(F.col("kind") == PUSH, 1).when(F.col("kind") == POP, -1).otherwise(0)).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    level = Window.partitionBy("part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.unionByName(open_, allowMissingColumns=True).withColumn("depth", depth).withColumn("now", F.last("top", ignorenulls=True).over(level))
    return swept.where(F.col("kind") == POINT).select("key", *others, F.when(F.col("depth") > 0, F.col("now")).alias("top"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = materialise(rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("often")))
    rules = materialise(keyed_rules(spark, rules))
    # of a host's domains, those with more labels than any rule's host have no rule
    deepest = rules.agg(F.max("labels")).first()[0] or 1
    labels = F.split(F.substring_index("host", ".", -deepest), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: _backwards(F.slice(labels, i, F.size(labels))))
    points = seen.withColumn("domain", F.explode(domains)).select(_key(F.col("domain"), F.col("path")).alias("key"), "host", "path", "often")
    swept = sweep(points, rules, shuffle_partitions(spark))
    best = materialise(swept.groupBy("host", "path").agg(F.max("often").alias("often"), F.max("top").alias("best")))
    total = best.agg(F.sum("often")).first()[0] or 0
    judged = spread_join(rows.where("host <> ''"), best, ["host", "path"], "often", total, ["page_id"])
    found = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
    none = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    return found.unionByName(none)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
with rules(verdict, rule, host, path) as (values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
    ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
urls as (select distinct url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
judged as (select url, any_value(u.host) as host, any_value(u.path) as path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
    from urls u left join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by url)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from pages p left join judged j on p.url is not distinct from j.url
"""
