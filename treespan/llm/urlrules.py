"""URL filters as a sort-merge range join.

A host's canonical key is its reversed text and a full stop: ``www.example.net`` is
``ten.elpmaxe.www.``. A rule's host and all its subdomains are then one interval of keys, from
``ten.elpmaxe.`` up to ``ten.elpmaxe/``, and such intervals nest or are disjoint. The sorted ends
of the intervals are swept together with the sorted distinct hosts; each end carries the stack of
rules that are open from there on (host, path, verdict), so a host's stack is that of the last
end at or before its key. Of the stack, the longest rule whose path begins the url's path wins.

Only distinct hosts are swept, counted before the shuffle: a host of any share of the urls is one
row there. A sweep is cut into ranges of keys; what is open at the start of a range comes from a
table with one row a range. All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path and the default
verdict; an empty host fits no rule; rules without host or with null verdict are ignored, a null
path is empty; of equally long fitting rules the one with the longer host wins, and of two
verdicts for one rule ``block``; repeated urls are judged each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, written

RULE = "rule_host string, rule_path string, verdict string"


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """A table of literal rules (host, path, verdict)."""
    rows = [F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("rule_host", "rule_path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def lowered(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lowered(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def ends(rules: DataFrame) -> DataFrame:
    """The ends of the rules' intervals: ``key`` and ``stack``, the rules open from there on."""
    rules = rules.select(lowered(F.col("rule_host")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict")
    rules = rules.where("rule_host <> '' AND verdict IS NOT NULL").groupBy("rule_host", "rule_path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    own = rules.groupBy("rule_host").agg(F.collect_list(F.struct("rule_host", "rule_path", "verdict")).alias("own"))
    labels = F.split("rule_host", r"\.")
    above = own.select("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at"))
    chain = above.join(own.select(F.col("rule_host").alias("at"), "own"), "at").groupBy("rule_host").agg(F.flatten(F.collect_list("own")).alias("stack"))
    begin = F.struct(key(F.col("rule_host")).alias("key"), F.col("stack"))
    end = F.struct(F.concat(F.reverse("rule_host"), F.lit("/")).alias("key"), F.filter("stack", lambda r: r["rule_host"] != F.col("rule_host")).alias("stack"))
    return chain.select(F.explode(F.array(begin, end)).alias("end")).select("end.*")


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (host) with ``stack``, the rules whose host fits; null if there is none."""
    events = ends(rules).select("key", F.lit(None).cast("string").alias("host"), F.struct("key", "stack").alias("end"))
    events = events.unionByName(hosts.select(key(F.col("host")).alias("key"), "host"), allowMissingColumns=True)
    # A table: the ranges are drawn once, so all three uses below, and tasks that are run again, cut alike.
    cut = written(events.repartitionByRange("key").withColumn("cut", F.spark_partition_id()), "cuts")
    last = cut.where("end IS NOT NULL").groupBy("cut").agg(F.max("end").alias("end"))
    carried = (
        cut.select("cut").distinct().join(last, "cut", "left")
        .select("cut", F.max("end").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    found = cut.withColumn("end", F.max("end").over(Window.partitionBy("cut").orderBy("key"))).where("host IS NOT NULL")
    return found.join(carried, "cut").select("host", F.coalesce("end", "carried")["stack"].alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (host and path of the rule that wins, or null), ``verdict``."""
    host, path = parts(col(url_col).cast("string"))
    pages = urls.select(col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    stacks = sweep(pages.groupBy("host").agg(F.count("*").alias("urls")), rules).withColumnRenamed("host", "_host")
    fits = F.filter(F.col("stack"), lambda r: F.startswith(F.col("path"), r["rule_path"]))
    rank = lambda r: F.struct((F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("n"), F.length(r["rule_host"]).alias("h"), r["rule_host"].alias("rule_host"), r["rule_path"].alias("rule_path"), r["verdict"].alias("verdict"))
    best = F.array_max(F.transform(fits, rank))
    out = pages.join(stacks, F.col("host") == F.col("_host"), "left").withColumn("best", best)
    return out.select(F.col("_id").alias(id_col), "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The same in DuckDB's SQL, with RULES.
SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM (SELECT page_id, coalesce(r, '') AS r FROM rest)),
hit AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
        FROM (SELECT DISTINCT host, path FROM cut), rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN hit USING (host, path)
"""
