"""URL filters: a sort-merge range join of urls with nested rules.

A host is keyed by its labels in reverse, each closed by a dot (``www.example.org`` is
``org.example.www.``), so a host and its subdomains are the keys that start with one
prefix: an interval. Url keys are dealt out by ranges, rules go to the ranges that their
interval meets, and every range is swept once in key order with a stack of the rules that
are active. Intervals of hosts nest, so the stack is a chain from outer to inner host; the
rules of one host are looked up by path prefix.
"""

from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import stored

#: After every key that starts with the same prefix: no UTF-8 text reaches it.
LAST = "\U0010ffff"
RULES = "host string, path string, verdict string"


def reversed_host(host):
    """Labels in reverse, each closed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _boundaries(keyed: DataFrame, ranges: int, sampled: int) -> list[tuple]:
    """Cut points of about equal ranges, from at most some thousands of rows.

    They decide only which task judges a url, never the verdict.
    """
    rows = keyed.count()
    every = max(1, rows // sampled)
    spots = keyed.filter(F.pmod(F.col("spot"), F.lit(every)) == 0).select("key", "spot")
    found = sorted((r["key"], r["spot"]) for r in spots.limit(4 * sampled).collect())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None,
           id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Id, host, path, rule (host + path, or null) and verdict per row of ``pages``.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts
    with the rule's; the longest (host plus path) that fits wins, at equal length the one of
    the longer host, and of two equal rules the smaller verdict. No rule: ``default``. A null url has an empty host and path. Null hosts
    or paths of rules count as empty, a rule with an empty host fits every url. Rows repeat
    as they are; other columns are left out.
    """
    spark = pages.sparkSession
    parts = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"))
    parts = parts.select("id", F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1).alias("after"))
    parts = parts.select("id", "after", F.regexp_extract("after", r"^[^/?#]*", 0).alias("raw"))
    lower = F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = parts.select(
        "id", lower.alias("host"),
        F.regexp_extract(F.expr("substring(after, char_length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))
    keyed = stored(parts.withColumn("key", reversed_host(F.col("host"))).withColumn(
        "spot", F.xxhash64("id", "host", "path")), "urls")

    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _boundaries(keyed, ranges, sampled=20 * ranges)
    ends = spark.sparkContext.broadcast(cuts)  # one cut per range

    def url_range(keys: pd.Series, spots: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(ends.value, pair) for pair in zip(keys, spots)], dtype="int32")

    def rule_ranges(keys: pd.Series) -> pd.Series:
        lowest = -(1 << 63)
        return pd.Series([list(range(bisect_right(ends.value, (k, lowest)),
                                     bisect_right(ends.value, (k + LAST, lowest)) + 1)) for k in keys])

    in_range = F.pandas_udf(url_range, "int")
    over_ranges = F.pandas_udf(rule_ranges, "array<int>")
    # ids travel as text: pandas would turn whole numbers beside nulls into fractions
    urls = keyed.select(in_range("key", "spot").alias("range"), "key", F.lit(1).alias("kind"),
                        F.col("id").cast("string").alias("id"), "host", "path", F.lit(None).cast("string").alias("verdict"))
    host = F.coalesce(F.col("host"), F.lit(""))
    opened = rules.select(host.alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict")
    opened = opened.withColumn("key", reversed_host(F.col("host"))).select(
        F.explode(over_ranges("key")).alias("range"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("id"), "host", "path", "verdict")

    events = (opened.unionByName(urls).repartition(ranges, "range")
              .sortWithinPartitions("range", "key", "kind", "path"))
    swept = events.mapInPandas(lambda frames: _sweep(frames, default),
                               "id string, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").cast(keyed.schema["id"].dataType).alias(id_column), "host", "path", "rule", "verdict")


def _sweep(frames: Iterable[pd.DataFrame], default: str):
    """Judge urls in key order; the stack holds (host key, rules by path, path lengths)."""
    stack: list[tuple[str, dict, list]] = []
    at = None
    for frame in frames:
        kept, rule_of, verdict_of = [], [], []
        for row, (part, key, kind, host, path, verdict) in enumerate(zip(
                frame["range"], frame["key"], frame["kind"], frame["host"], frame["path"],
                frame["verdict"])):
            if part != at:
                stack, at = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, by_path, lengths = stack[-1]
                if path not in by_path or (verdict or "") < (by_path[path][1] or ""):
                    by_path[path] = (host, verdict)
                lengths[:] = sorted({*lengths, len(path)}, reverse=True)
                continue
            best = None
            for _, by_path, lengths in stack:
                size = next((n for n in lengths if path[:n] in by_path), None)
                if size is not None:
                    rule_host, found = by_path[path[:size]]
                    if best is None or len(rule_host) + size >= best[0]:
                        best = (len(rule_host) + size, rule_host + path[:size], found)
            kept.append(row)
            rule_of.append(best[1] if best else None)
            verdict_of.append(best[2] if best else default)
        yield pd.DataFrame({**{c: frame[c].to_numpy(dtype=object)[kept] for c in ("id", "host", "path")},
                            "rule": rule_of, "verdict": verdict_of}, dtype=object)
