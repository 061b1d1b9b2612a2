"""URL filters by hashed expressions.

A url's host is split into its suffixes at dots and its path into its prefixes at slashes; each (suffix, prefix) pair
is hashed, pairs are matched with the rules by an equi-join on the first PREFIX_BYTES of SHA-256, and a match counts only
if all 32 bytes agree. Of a url's matching rules the longest (host and path together, then host) decides. Expressions
deeper than the deepest rule can't match, so they aren't made: the work for a url is bounded by the rules, not by its
length, and no match is lost.

Null urls and those without "://" have an empty host and path and match no rule. A url that no rule fits gets `default`.
Repeated rows each get their row; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PREFIX_BYTES = 4
#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows. A path must start and end with a slash, a host have no empty label; two rules for one place are an error."""
    for verdict, host, path in rules:
        if not host or "" in host.split(".") or not (path.startswith("/") and path.endswith("/")) or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
    if len({x[1:] for x in rules}) < len(rules):
        raise ValueError("two rules for the same host and path")
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")


def split_url(url: str) -> tuple[str, str]:
    """SQL for host and path of the column `url`."""
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{lower}')"
    return f"coalesce({host}, '')", f"coalesce(regexp_extract(regexp_replace({rest}, '^[^/?#]*', ''), '^[^?#]*', 0), '')"


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """urls has key, url; returns key, host, path, rule, verdict for each of its rows."""
    digest = lambda h, p: F.unhex(F.sha2(F.concat(h, F.lit("\n"), p), 256))
    rules = materialise(rules.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("digest", 1, PREFIX_BYTES)), "url-rules")
    labels, slashes = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    host, path = split_url("url")
    # A row's expressions leave the task that numbers it together, so the number need only tell rows apart.
    u = urls.select(F.monotonically_increasing_id().alias("_row"), "key", F.expr(host).alias("host"), F.expr(path).alias("path"))
    # The last k labels of the host, and the path up to its k-th slash.
    u = u.withColumns({"_l": F.split("host", r"\."), "_s": F.split("path", "/", (slashes or 0) + 1)})
    suffixes = f"transform(sequence(1, least(size(_l), {labels or 1})), k -> array_join(slice(_l, -k, k), '.'))"
    prefixes = f"CASE WHEN size(_s) > 1 THEN transform(sequence(1, least(size(_s) - 1, {slashes or 1})), k -> concat(array_join(slice(_s, 1, k), '/'), '/')) ELSE array() END"
    pairs = u.withColumns({"_h": F.expr(suffixes), "_p": F.expr(prefixes).cast("array<string>")}).select(
        "_row", "key", "host", "path", F.explode_outer("_h").alias("_eh"), "_p"
    ).select("_row", "key", "host", "path", "_eh", F.explode_outer("_p").alias("_ep")).withColumn("_digest", digest(F.col("_eh"), F.col("_ep")))
    met = pairs.withColumn("_short", F.substring("_digest", 1, PREFIX_BYTES)).join(rules, F.col("_short") == F.col("short"), "left")
    fits = F.when(F.col("digest") == F.col("_digest"), F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), "rule_host", "rule_path", "verdict"))
    # The rules are broadcast while Spark finds them small; hosts and paths are shuffled once, by row.
    best = met.groupBy("_row", "key", "host", "path").agg(F.max(fits).alias("b"))
    return best.select("key", "host", "path", F.expr("concat(b.rule_host, b.rule_path)").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    return filter_urls(pages, rules_frame(spark)).withColumnRenamed("key", "page_id")


ORACLE = """
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT p.*, (SELECT max_by(struct_pack(rule := h || q, verdict := r.verdict), length(h || q)) FROM r
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS b FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM m"""
