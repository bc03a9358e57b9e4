"""URL filters by hashed host-suffix / path-prefix expressions (DataFrame only).

Each distinct (host, path) is expanded into expressions, a host suffix at a
label boundary with a path prefix cut after a slash, as many labels and
slashes as some rule has (deeper expressions can fit no rule, so the limit
loses nothing).  A rule becomes the expression of its host and the part of its
path up to the last slash.  Both sides are digested with SHA-256, joined on
the first 32 bits, and kept where the full digest agrees and the url's path
starts with the rule's whole path.  The longest rule wins (host, then path);
at equal rules ``block`` beats ``allow``.  A url no rule fits is allowed.

Scale: pages are first reduced to distinct (host, path), so a host or url with
a third of all rows is expanded once; verdicts come back by an equi-join whose
page side Spark may split.  Only Spark's own size check broadcasts rules.

Defined results: a null url or one without ``://`` has empty host and path and
fits no rule; repeated pages keep their rows; an empty table or no rules give
no rows or the default verdict; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
#: Fixed values of the contract: (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, head: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), head), 256)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given in code as a frame ``action, host, path``."""
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("action", "host", "path")])
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("action", "host", "path"), r)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def expand_rules(rules: DataFrame) -> DataFrame:
    head = F.regexp_extract("path", r"^(?s:.*/)?", 0)
    full = digest(F.col("host"), head)
    return rules.select(
        "action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), full.alias("rule_digest"),
        F.substring(full, 1, PREFIX_HEX).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url_col: str = "url",
          keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns of every page with ``host, path, rule, verdict``."""
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                        F.max(F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("slashes")).first()
    labels, slashes = deepest["labels"] or 0, deepest["slashes"] or 0
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"))
    expressions = (
        parsed.where(F.col("host") != "").select("host", "path").distinct()
        .withColumn("suffix", F.explode(F.transform(
            F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(max(labels, 1)))),
            lambda k: F.array_join(F.slice(F.split("host", r"\."), -k, k), "."))))
        .withColumn("head", F.explode(F.transform(
            F.sequence(F.lit(0), F.least(F.size(F.split("path", "/")) - 1, F.lit(slashes))),
            lambda k: F.when(k == 0, F.lit("")).otherwise(
                F.concat(F.array_join(F.slice(F.split("path", "/"), 1, k), "/"), F.lit("/"))))))
        .withColumn("digest", digest(F.col("suffix"), F.col("head")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)))
    fits = (
        expressions.join(expand_rules(rules), "prefix")
        .where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))))
    best = (
        fits.groupBy("host", "path").agg(F.max(F.struct(
            F.length("rule_host").alias("a"), F.length("rule_path").alias("b"),
            (F.col("action") == "block").alias("c"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("verdict"))).alias("best"))
        .select(F.col("host").alias("best_host"), F.col("path").alias("best_path"), "best.rule", "best.verdict"))
    # joined on a struct, which the aggregate's partitioning does not serve: both sides get a shuffle
    # directly below the join, so Spark can split a url with a third of the pages
    return (
        parsed.join(best, F.struct(F.col("host").alias("h"), F.col("path").alias("p"))
                    == F.struct(F.col("best_host").alias("h"), F.col("best_path").alias("p")), "left")
        .select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    from tally.llm.shared import documents

    return judge(documents(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
v AS (SELECT d.host, d.path, max_by(rh || rp, length(rh) * 1000 + length(rp)) AS rule,
             max_by(action, length(rh) * 1000 + length(rp)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) d, r
      WHERE (d.host = rh OR ends_with(d.host, '.' || rh)) AND starts_with(d.path, rp) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, v.rule, coalesce(v.verdict, 'allow') AS verdict
FROM p LEFT JOIN v ON p.host = v.host AND p.path = v.path
"""
