"""Allow and block rules on URLs, by expanding URLs and joining on short hash prefixes.

A URL becomes expressions: a suffix of its host at a label border with a prefix of its path at a
slash. A rule is filed under its host and the directory of its path. Both sides are joined on the
first digits of a digest; equal full digests and the rest of the rule's path confirm a match.
Built-in functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that are joined on.
PREFIX_DIGITS = 8
#: Copies of the rules over which a hot expression is spread, where the join is shuffled.
SALTS = 16


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("/"), folder), 256)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL and for one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _filed(rules: DataFrame) -> DataFrame:
    host = _ascii_lower(F.col("host"))
    path = F.coalesce(F.col("path"), F.lit(""))
    folder = F.regexp_extract("_rule_path", r"^(?s:.*)/", 0)
    return (
        rules.filter("host IS NOT NULL AND action IS NOT NULL")
        .select(host.alias("_rule_host"), path.alias("_rule_path"), F.col("action").alias("_action"))
        .withColumn("_labels", _count(F.col("_rule_host"), ".") + 1)
        .withColumn("_slashes", _count(F.col("_rule_path"), "/"))
        .withColumn("_rule_digest", _digest(F.col("_rule_host"), folder))
        .withColumn("_key", F.substring("_rule_digest", 1, PREFIX_DIGITS))
    )


def filter_urls(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str,
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``id_col, host, path, rule, verdict``: one row for each row of ``urls``.

    ``rules`` has ``host, path, action``. A rule fits its host and all subdomains if the URL's
    path starts with the rule's; the longest rule (then the longest host, then the last action by
    name) wins. Without one, ``rule`` is null and ``verdict`` is ``default``. Rules without host
    or action are ignored, a null path of a rule is empty, no rules at all are allowed. Null ids
    and URLs are values like others, repeated rows are repeated, other columns are not read.
    """
    filed = _filed(rules)
    # URLs are expanded no further than rules reach.
    deepest = filed.agg(F.max("_labels").alias("labels"), F.max("_slashes").alias("slashes")).first()
    host, path = host_and_path(F.col("_url"))
    rows = (
        urls.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
        .groupBy("_id", "_url")
        .agg(F.count("*").alias("_copies"))
        .withColumns({"_host": host, "_path": path})
    )
    suffixes = F.transform(
        F.sequence(
            F.lit(1), F.least(_count(F.col("_host"), ".") + 1, F.lit(deepest["labels"] or 1))
        ),
        lambda k: F.call_function("substring_index", F.col("_host"), F.lit("."), -k),
    )
    cuts = F.sequence(
        F.lit(0), F.least(_count(F.col("_path"), "/"), F.lit(deepest["slashes"] or 0))
    )
    folders = F.transform(
        cuts,
        lambda k: F.when(k == 0, F.lit("")).otherwise(
            F.concat(F.call_function("substring_index", F.col("_path"), F.lit("/"), k), F.lit("/"))
        ),
    )
    digests = F.flatten(
        F.transform(suffixes, lambda h: F.transform(folders, lambda f: _digest(h, f)))
    )
    expressions = (
        rows.withColumn("_digest", F.explode(digests))
        .withColumn("_key", F.substring("_digest", 1, PREFIX_DIGITS))
        .withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(SALTS)))
    )
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")
    salted = filed.withColumn("_salt", F.explode(salts))
    rule = F.concat("_rule_host", "_rule_path")
    fits = (F.col("_digest") == F.col("_rule_digest")) & F.col("_path").startswith(
        F.col("_rule_path")
    )
    best = (
        expressions.join(salted, ["_key", "_salt"], "left")
        .groupBy("_id", "_url", "_copies", "_host", "_path")
        .agg(
            F.max(
                F.when(
                    fits,
                    F.struct(
                        F.length(rule).alias("n"),
                        F.length("_rule_host").alias("h"),
                        F.col("_action").alias("action"),
                        rule.alias("rule"),
                    ),
                )
            ).alias("_best")
        )
    )
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
