"""URL rules by host suffixes and path prefixes, in DataFrame operations only.

A URL is expanded into expressions, every suffix of its host by every prefix of
its path that ends in a slash, and where rules lie in that folder by the
prefixes of their lengths. Expressions and rules meet by the first 32 bits of a
digest; the full digest confirms a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Rules up to this size are broadcast, each counted with ROW_BYTES for keys and digests.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(df: DataFrame, path: str) -> DataFrame:
    """short: the first 32 bits of the digest of host and path, which joins; digest: all of it, which confirms."""
    digest = F.sha2(F.concat("suffix", F.lit("\n"), path), 256)
    return df.withColumn("digest", digest).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def _rules(rules: DataFrame) -> DataFrame:
    """Each different rule once, a block before others, with its folder, the part of its path up to the last slash."""
    known = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("suffix"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"),
    ).filter("suffix != '' and rule_verdict is not null")
    first = F.min(F.struct((F.col("rule_verdict") != "block").alias("other"), F.col("rule_verdict").alias("verdict")))["verdict"]
    return known.groupBy("suffix", "rule_path").agg(first.alias("rule_verdict")).withColumn("folder", F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0))


def _met(asked: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Rows of both that agree in host and path: equal short digests join, whole digests confirm."""
    other = known.withColumnRenamed("digest", "_digest").drop("suffix", path)
    return _keyed(asked, path).join(other, "short").filter(F.col("digest") == F.col("_digest")).drop("short", "digest", "_digest")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and
    all below it if the URL's path starts with the rule's. The longest rule
    wins; of equally long ones block, then the smaller. Rules without host or
    verdict are ignored. Without a fitting rule the verdict is ``otherwise``
    and rule null. Null URLs and URLs without :// have empty host and path.

    Every distinct URL is judged once. Expansions stop at the deepest host and
    folder that a rule has (two numbers), beyond which nothing can match, and go
    on inside a folder only by the lengths of the rules there: the key holds a
    whole rule, however many share a folder. Rules of up to BROADCAST_BYTES, as
    measured, are broadcast; larger lists are joined by shuffle.
    """
    known = cut_lineage(_rules(rules))
    labels, folders, size = known.agg(
        F.max(F.size(F.split("suffix", r"\."))), F.max(F.length("folder") - F.length(F.replace("folder", F.lit("/"), F.lit("")))),
        F.sum(F.octet_length("suffix") + 2 * F.octet_length("rule_path") + ROW_BYTES),
    ).first()
    near = F.broadcast if (size or 0) <= BROADCAST_BYTES else cut_lineage  # a written side of its own lets Spark split a hot key of the other
    distinct = pages.select(F.col(url).alias("_url")).distinct().withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    label = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(label), F.lit(labels or 1))), lambda k: F.array_join(F.slice(label, -k, k), "."))
    parts = F.regexp_extract_all("path", F.lit("(?s)[^/]*/"), F.lit(0))
    depth = F.least(F.size(parts), F.lit(folders or 0))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, 1, k), ""))
    asked = distinct.select("_url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("_url", "path", "suffix", F.explode("prefixes").alias("folder"))
    lengths = known.groupBy("suffix", "folder").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    deeper = _met(asked, near(_keyed(lengths, "folder")), "folder")
    whole = deeper.select("_url", "suffix", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("rule_path"))
    rule = _keyed(known.select("suffix", "rule_path", "rule_verdict", F.concat("suffix", "rule_path").alias("rule")), "rule_path")
    fits = _met(whole, near(rule), "rule_path")
    rank = F.struct(F.length("rule").alias("n"), (F.col("rule_verdict") == "block").alias("block"))
    # the smaller rule wins a tie: the largest rank first, then the least name of those with it
    best = fits.groupBy("_url", rank.alias("rank")).agg(F.min(F.struct("rule", "rule_verdict")).alias("r")).groupBy("_url").agg(F.max_by("r", "rank").alias("r"))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    return own.join(best, "_url", "left").select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        F.col("r.rule").alias("rule"), F.coalesce(F.col("r.rule_verdict"), F.lit(otherwise)).alias("verdict"),
    )
