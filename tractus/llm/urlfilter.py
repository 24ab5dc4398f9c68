"""URL filters: a sort-merge range join of canonical keys with nested prefix rules.

A rule (host, path) covers the interval of keys that begin with its own key, the host's labels in reverse order, each
closed by a dot, and the path; the dot keeps `com` from covering `community`. Intervals of prefixes are nested or apart. A url has one key for each suffix of its host that is as long as
some rule's host. Keys and rules are sorted together; a sweep keeps the stack of active nested rules. The stack in
force at a key is that of the rule that began last: every active rule has begun before it and still covers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

DEFAULT = "allow"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(verdict, host, path)")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; without '://' or for null both are empty. Existing columns of these names are replaced."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    before = lambda t, stops: F.regexp_extract(t, f"(?s)^([^{stops}]*)", 1)
    host = before(rest, "/?#")
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": lower, "path": before(tail, "?#")})


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\.", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), ""), path)


def _stacks(rules: DataFrame) -> DataFrame:
    """key, stack: each rule with all rules whose intervals hold its own, outermost first. Of equal rules (same host
    and path) the one whose verdict sorts first counts."""
    keyed = (
        rules.select("host", "path", "verdict")
        .filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(_key(_labels(F.col("host")), F.col("path")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    )
    prefixes = keyed.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("p"))
    outer = keyed.select(F.col("key").alias("p"), F.struct(F.length("key").alias("k"), F.col("key").alias("key"), F.col("r").alias("r")).alias("entry"))
    return prefixes.join(outer, "p").groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule (host and path, or null) and verdict to rows with host and path.

    A rule fits its host and all subdomains where the path begins with the rule's path. The longest rule (host and
    path together) wins; of equally long ones that with the longer host, then that which sorts last. Each distinct
    (host, path) is swept once and joined back, so repeated urls, however many, cost one key. The sweep is dealt out
    by salts, rules being repeated for each: no group grows with a popular host. Without rules all are DEFAULT.
    """
    spark = urls.sparkSession
    salts = 2 * partitions(spark)
    keys = urls.select("host", "path").distinct()
    stacks = _stacks(rules)
    deepest = rules.agg(F.coalesce(F.max(F.size(_labels(F.col("host")))), F.lit(0)).alias("deepest"))
    depth = deepest.first()[0]
    if depth == 0:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(DEFAULT)})
    labels = _labels(F.col("host"))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")))
    points = keys.select("host", "path", F.explode(suffixes).alias("key"), F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    active = F.filter(F.coalesce(F.col("stack"), F.array().cast(stacks.schema["stack"].dataType)), lambda e: F.col("key").startswith(e["key"]))
    best = swept.select("host", "path", F.explode(F.transform(active, lambda e: e["r"])).alias("r")).groupBy("host", "path").agg(F.max("r").alias("r"))
    found = best.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    left = urls.drop("rule", "verdict")
    return left.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))


def op2(pages: DataFrame) -> DataFrame:
    judged = match(with_host_path(pages.select("page_id", "url")), rule_table(pages.sparkSession))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, row_number() OVER () AS i, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, i, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
p AS (SELECT page_id, i, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
m AS (SELECT i, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (i)
"""
