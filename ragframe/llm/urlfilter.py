"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is (host, path, verdict) and fits a URL whose host is the rule's or a subdomain
of it and whose path starts with the rule's. A URL's possible keys are its host's
suffixes at label borders times its path's prefixes of the lengths that rules have.

The filter has blocks of 512 bits; a rule sets seven bits of one block, so one lookup
by block number decides a key. Keys that pass are joined with the rules exactly, which
removes false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, shared_table

#: Bits a rule; blocks hold 512 bits.
BITS_PER_RULE = 16
PROBES = 7
#: Rows of the filter (64 bytes each) or of the rules that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
#: Most distinct path lengths, and most labels of a host, that rules may have.
MAX_SHAPES = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: then up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("rule_host", "rule_path"), F.lit(blocks))


def _bit(i: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("bits"), "rule_host", "rule_path"), 9 * i).bitwiseAND(F.lit(511)).cast("int")


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, words): 512 bits as eight longs for each block that a rule sets."""
    bits = rules.select(_block(blocks).alias("block"), F.explode(F.array(*[_bit(i) for i in range(PROBES)])).alias("bit"))
    word = [F.bit_or(F.when(F.shiftright("bit", 6) == w, F.expr("shiftleft(1L, bit & 63)")).otherwise(F.lit(0).cast("long"))) for w in range(8)]
    return bits.groupBy("block").agg(F.array(*word).alias("words"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (host and path of the
    longest rule that fits, else null) and verdict (the rule's, else ``default``).

    Of rules of one length the longer host wins, then the later host and path, then
    the later verdict by name (block before allow). Null urls and urls without ``://``
    have an empty host and path, which no rule fits. Rules with a null or empty host
    or a null verdict are left out; a null path is empty. Repeated pages are returned
    as often as given; empty tables give no rows, or the default for all."""
    host, path = host_and_path(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = shared_table(
        rules.select(F.col("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .where("rule_host <> '' AND verdict IS NOT NULL").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")), "rules")
    n = listed.count()
    depth = F.size(F.split("rule_host", r"\."))
    shapes = listed.select(F.lit("path").alias("of"), F.length("rule_path").alias("n")).unionByName(
        listed.select(F.lit("host").alias("of"), depth.alias("n"))).distinct().limit(2 * MAX_SHAPES).collect()
    lengths, depths = (sorted(s.n for s in shapes if s.of == of) for of in ("path", "host"))
    if max(len(lengths), len(depths)) >= MAX_SHAPES:
        raise ValueError("rules have too many path lengths or host depths")
    if not n:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    blocks = max(1, -(-n * BITS_PER_RULE // 512))
    labels = F.split("host", r"\.")
    hosts = F.filter(F.transform(F.array(*[F.lit(d) for d in depths]), lambda d: F.when(
        d <= F.size(labels), F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))), lambda x: x.isNotNull())
    paths = F.filter(F.transform(F.array(*[F.lit(x) for x in lengths]), lambda k: F.when(
        k <= F.length("path"), F.substring("path", F.lit(1), k))), lambda x: x.isNotNull())
    keys = (urls.select("host", "path").where("host <> ''").distinct()
            .withColumn("rule_host", F.explode(hosts)).withColumn("rule_path", F.explode(paths)).withColumn("block", _block(blocks)))
    filter_rows = broadcast_up_to(shared_table(bloom(listed, blocks), "bloom"), MAX_BROADCAST_ROWS)
    passed = keys.join(filter_rows, "block")
    for i in range(PROBES):
        word = F.element_at("words", F.shiftright(_bit(i), 6) + 1)
        passed = passed.where(F.getbit(word, _bit(i).bitwiseAND(F.lit(63))) == 1)
    hits = passed.drop("words", "block").join(broadcast_up_to(listed, MAX_BROADCAST_ROWS), ["rule_host", "rule_path"])
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), "rule_host", "rule_path", "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = shared_table(best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict"), "verdicts")
    return urls.join(broadcast_up_to(best, MAX_BROADCAST_ROWS), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
