"""URL allow and block rules as a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix. Written as a reversed host and then the path, a rule is a prefix of the keys of
all urls under it, thus an interval of the sorted keys, and two rules' intervals are nested or disjoint. A sweep over
sorted keys therefore needs a stack of active rules: a rule is pushed where its interval starts, and popped where it
ends, when the rule around it is on top again. `boundaries` is that stack's history: for each place where the top
changes, the new top. Urls and boundaries are then sorted together by ranges, and each url takes the last top before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import shuffle_width, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are compared as bytes. This one is in no text and behind all that are, so prefix + LAST ends the prefix's interval.
LAST = b"\xff"
#: Between reversed host and path; below all that hosts hold.
SEP = "\u0001"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def boundaries(rules: DataFrame) -> DataFrame:
    """(at, depth, top): in key order, from key `at` on, the innermost active rule is `top` (null: none).

    Rules that are equal count once, block before allow. Depth is the number of the host's labels: a url is swept once
    for each depth that rules have, with that many of its host's last labels.
    """
    r = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("labels", F.split("host", r"\."))
    r = r.select(F.concat(_reversed(F.col("labels")), F.lit(SEP), "path").alias("key"), F.size("labels").alias("depth"), F.struct((F.length("host") + F.length("path")).alias("weight"), F.concat("host", "path").alias("rule"), "verdict").alias("top"))
    # The rule below each on the stack: of the rules whose key is a proper prefix, the longest.
    inside = r.select("key", "depth", F.explode(F.expr("transform(sequence(1, length(key)), n -> substring(key, 1, n - 1))")).alias("prefix"))
    outer = inside.join(r.select(F.col("key").alias("prefix"), F.col("top").alias("below")), "prefix").groupBy("key").agg(F.max_by("below", F.length("prefix")).alias("below"))
    r = r.join(outer, "key", "left")
    key = F.col("key").cast("binary")
    pushed = r.select(key.alias("at"), "depth", "top")
    popped = r.select(F.concat(key, F.lit(bytearray(LAST))).alias("at"), "depth", F.col("below").alias("top"))
    return pushed.unionByName(popped)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict for column url.

    The longest fitting rule wins; without one, rule is null and the verdict is `default`. Rows with a null or malformed
    url have an empty host and path, which no rule fits. Repeated rows and null page ids stay as they are; columns of
    pages that clash with the result's are not read. An empty table gives an empty result.

    Urls and boundaries are sorted together by ranges of the key, and the row's number parts equal keys, so neither a hot
    host nor a hot url meets in one sweep. A sweep begins with the top that the sweeps before it have left: of each range
    only the last boundary is needed for that.
    """
    spark = pages.sparkSession
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    edges = boundaries(rules)
    depths = sorted(r["depth"] for r in edges.select("depth").distinct().collect())  # label counts: a few numbers
    probes = page.select("*", F.split("host", r"\.").alias("labels"), F.explode(F.array(*map(F.lit, [0, *depths]))).alias("depth")).where("depth = 0 or depth <= size(labels)")
    probes = probes.select("row", "page_id", "host", "path", "depth", F.concat(_reversed(F.expr("slice(labels, greatest(size(labels) - depth, 0) + 1, depth)")), F.lit(SEP), "path").cast("binary").alias("at"), F.lit(1).alias("is_url"), F.lit(None).cast("struct<weight:int,rule:string,verdict:string>").alias("top"))
    both = probes.unionByName(edges.select("at", "depth", "top", F.lit(0).alias("is_url"), F.lit(-1).cast("bigint").alias("row")), allowMissingColumns=True)
    # Written down, as a range's number must stay what it is.
    swept = stash(both.repartitionByRange(4 * shuffle_width(spark), "depth", "at", "is_url", "row").withColumn("sweep", F.spark_partition_id()), "sweeps")

    # A pop to no rule must hide what lies before it, so the top is wrapped: a null inside counts, an absent one doesn't.
    top = F.when(F.col("is_url") == 0, F.struct(F.col("top").alias("rule")))
    left = swept.groupBy("depth", "sweep").agg(F.max_by(top, F.when(F.col("is_url") == 0, F.col("at"))).alias("left"))
    before = Window.partitionBy("depth").orderBy("sweep").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("depth", "sweep", F.last("left", ignorenulls=True).over(before).alias("carried"))  # a row for each range
    order = Window.partitionBy("depth", "sweep").orderBy("at", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    hits = swept.withColumn("active", F.last(top, ignorenulls=True).over(order)).where("is_url = 1").join(F.broadcast(carried), ["depth", "sweep"])
    best = hits.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.coalesce("active", "carried")["rule"]).alias("top"))
    return best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
n AS (SELECT row_number() OVER () AS row, * FROM p),
m AS (SELECT n.*, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY row ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
      FROM n LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
