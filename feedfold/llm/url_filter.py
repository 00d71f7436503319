"""URL verdicts from host and path rules, found through short hash prefixes.

Every url is expanded into (host suffix, path prefix) expressions. Their hash prefixes are equi-joined with those of
the rules; a hit counts only if the full digests agree; of the confirmed rules the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import fold_ascii, spread_join
from feedfold.session import written

PREFIX_HEX = 8
# Rules are broadcast up to this many bytes of expressions; larger lists are joined by shuffling distinct expressions.
BROADCAST_BYTES = 4 << 20
NO_RULE = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    has_scheme = F.instr(url, "://") > 0
    rest = F.when(has_scheme, F.substring_index(F.expr("substr(_url, instr(_url, '://') + 3)"), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return (F.coalesce(fold_ascii(host), F.lit("")),
            F.coalesce(F.substr(rest, F.char_length(host) + 1), F.lit("")))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): the digest, its prefix and the verdict. Of contradicting rules block wins; rules with a null are void."""
    rules = rules.select("host", "path", "verdict").dropna()
    return (rules.groupBy(fold_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("rule_verdict"))
            .select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "rule_verdict",
                    F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("rule_digest"))
            .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX)))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the url's path
    starts with the rule's path. The longest rule wins, of equally long ones that with the longer host. Urls that no
    rule fits get a null rule and ``allow``; null urls have an empty host and path. Ids may be null or repeat, and a
    repeated row is judged each time. An empty table gives an empty result; other columns are not read.
    """
    rules = written(prepare_rules(rules), "url-rules")
    size, lengths = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 160),
                              F.sort_array(F.collect_set(F.char_length("rule_path")))).first()
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    # rule paths are prefixes of any length, so a path is cut at the lengths that rules have (no more than a url has characters)
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("path")) if lengths \
        else F.array().cast("array<int>")
    prefixes = F.transform(cuts, lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = F.array_distinct(F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(
        prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"))))))
    order = F.struct(F.char_length(F.concat("rule_host", "rule_path")), F.char_length("rule_host"),
                     F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    # the verdict depends on host and path alone, so each distinct pair is expanded once
    places = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    spelled = (places.select("host", "path", "n", F.explode(expressions).alias("e"))
               .withColumn("digest", F.sha2(F.concat("e.h", F.lit("\n"), "e.p"), 256))
               .select("host", "path", "n", "digest", F.substring("digest", 1, PREFIX_HEX).alias("prefix")))
    if (size or 0) <= broadcast_bytes:
        hits = spelled.join(F.broadcast(rules), "prefix").filter("digest = rule_digest")
    else:
        spelled = written(spelled, "url-expressions")
        counts = spelled.groupBy("prefix", "digest").agg(F.count(F.lit(1)).alias("spellings"))
        known = counts.join(rules, "prefix").filter("digest = rule_digest").drop("prefix")
        hits = spread_join(spelled, known, ["digest"], "spellings")
    judged = written(hits.groupBy("host", "path", "n").agg(F.max(order).alias("best"))
                     .select("host", "path", "n", "best.rule", "best.verdict"), "url-verdicts")
    found = spread_join(urls, judged, ["host", "path"], "n", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(NO_RULE)).alias("verdict"))
