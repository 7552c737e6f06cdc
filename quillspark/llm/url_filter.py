"""URL filters as a sort-merge range join.

A host's labels in reverse order, each followed by a dot, make a key in which a host and all its
subdomains are one interval: the keys that begin with the host's own.  Urls and rules are brought into
one order of keys and dealt by sampled splitters into ranges; a sorted sweep over a range keeps a stack
of the rule hosts whose interval is open, which nest.  Rules that are open at a range's start are
copied into it; these are the rules whose key is a prefix of the splitter, so they are few.  The order
has the path and a salt from the id behind the host, so that one host or one url that holds a third of
all rows is dealt over many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, shuffle_partitions, table

#: The rules of the registered query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: Keys that are drawn to place the splitters, and ranges for each shuffle partition.
SAMPLED_KEYS = 20_000
RANGES_PER_PARTITION = 4
SEP = "\x01"  # sorts before every character of a host


def host_and_path(url):
    """Columns host and path of a url column; both empty for a null or for text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host):
    """``www.example.org`` -> ``org.example.www.``; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _longest(node: dict, path: str):
    """Of the rules of one host the longest whose path begins *path*: (length, rule, verdict)."""
    best = None
    for size in node["sizes"]:  # longest first
        found = node["paths"].get(path[:size]) if size <= len(path) else None
        if found:
            best = found
            break
    return best


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    stack: list[dict] = []  # open rule hosts, the outermost first
    range_, key_now = None, None
    for batch in batches:
        out = []
        for r, key, kind, page_id, host, path, rule, verdict in zip(*(batch[c].tolist() for c in ("range", "key", "kind", "page_id", "host", "path", "rule", "verdict"))):
            if r != range_:
                range_, stack, key_now = r, [], None
            if key != key_now:
                while stack and not key.startswith(stack[-1]["key"]):
                    stack.pop()
                key_now = key
            if kind == 0:
                if not stack or stack[-1]["key"] != key:
                    stack.append({"key": key, "paths": {}, "sizes": []})
                node = stack[-1]
                old = node["paths"].get(path)
                if old is None or (verdict, rule) < (old[2], old[1]):
                    node["paths"][path] = (len(rule), rule, verdict)
                    node["sizes"] = sorted({*node["sizes"], len(path)}, reverse=True)
                continue
            best = None
            for node in stack if host else ():
                found = _longest(node, path)
                if found and (best is None or found[0] >= best[0]):  # of equal lengths the longer host
                    best = found
            out.append((page_id, host, path, best[1] if best else None, best[2] if best else default))
        frame = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
        frame["page_id"] = frame["page_id"].astype("Int64")
        yield frame


def _range_of(splitters: Sequence[str]):
    marks = np.array(splitters, object)

    @F.pandas_udf("int")
    def place(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, order.to_numpy(object), side="right").astype(np.int32))

    return place


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, sampled_keys: int = SAMPLED_KEYS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for each row of *pages* (``page_id``, ``url``).

    *rules* has ``verdict``, ``host``, ``path``.  A rule fits its host and all subdomains where the
    url's path begins with the rule's; the longest rule string wins, of equally long ones that of the
    longer host, and of rules that are the same string the first verdict in alphabetical order.  A
    null url, or one without ``://``, has empty host and path and gets *default*, as does a url that
    no rule fits.  Rules with nulls or an empty host never fit.  Very long urls are compared whole.
    Repeated rows give equal results; other columns are ignored; an empty table gives none, and without
    rules every url gets *default*.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    urls = urls.withColumn("order", F.concat_ws(SEP, "key", "path", F.hex(F.xxhash64("page_id"))))
    lower = F.translate("host", UPPER, LOWER)
    wanted = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
    wanted = wanted.select("verdict", lower.alias("host"), "path").select(F.concat("host", "path").alias("rule"), "verdict", "path", reversed_host(F.col("host")).alias("key")).distinct()

    # splitters: quantiles of a sample whose size is bounded by the parameter
    ranges = RANGES_PER_PARTITION * shuffle_partitions(spark)
    total = max(1, urls.count())
    share = min(1.0, sampled_keys / total)
    drawn = sorted((r[0], r[1]) for r in urls.select("order", "key").sample(share, seed=7).limit(2 * sampled_keys).collect())
    splitters = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if len(drawn) >= ranges else []
    place = _range_of([order for order, _ in splitters])

    # a rule host's interval: its own range (its key sorts before every url in it) and all ranges
    # whose splitter begins with its key
    starts = [(k + 1, key[: end + 1]) for k, (_, key) in enumerate(splitters) for end, c in enumerate(key) if c == "."]
    at_start = spark.createDataFrame(starts, "range int, key string")  # splitters x labels of a host
    here = wanted.withColumn("range", place("key"))
    inside = wanted.join(at_start, "key").select(*wanted.columns, "range")
    rule_rows = here.unionByName(inside).distinct()

    both = urls.select(place("order").alias("range"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    both = both.unionByName(rule_rows.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"), "path", "rule", "verdict"))
    # ranges are dealt in turn, so that every partition has equally many
    n = shuffle_partitions(spark)
    dealt = both.repartitionById(n, F.pmod("range", F.lit(n)).cast("int")).sortWithinPartitions("range", "key", "kind")
    schema = "page_id long, host string, path string, rule string, verdict string"
    return dealt.mapInPandas(lambda b: _sweep(b, default), schema)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) AS t(verdict, host, path)
), m AS (
  SELECT b.page_id, b.host, b.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS n
  FROM b LEFT JOIN r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE n = 1
"""
