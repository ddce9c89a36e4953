"""URL rules by host and path: a sort-merge range join over reversed hosts, swept with a stack of nested rules.

`a.example.org` becomes `org.example.a.`, so a rule's host is a prefix and all hosts it covers lie between the prefix
and its last character's successor. Rows and rules are cut into ranges of that order, a rule going into every range it
reaches; each range is then sorted and swept once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from allotment.llm.sampling import smallest

#: Keys that the range bounds are taken from.
SAMPLE = 4096
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), BIG, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ranges(bounds: list[tuple], rules: bool):
    """Adds the number of a row's range, or one row for each range that a rule reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if rules:
                first = [bisect_right(bounds, (k, -(1 << 63))) for k in keys]
                last = [bisect_right(bounds, (k[:-1] + "/", -(1 << 63))) for k in keys]
                take = pa.array([i for i in range(len(keys)) for _ in range(first[i], last[i] + 1)], pa.int64())
                part = [p for i in range(len(keys)) for p in range(first[i], last[i] + 1)]
                batch = batch.take(take)
            else:
                part = [bisect_right(bounds, k) for k in zip(keys, batch.column("tie").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["part", *batch.schema.names])
    return run


class Nest:
    """The rules of one host: verdicts by path."""

    def __init__(self, key: str):
        self.key, self.paths, self.sizes = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        self.paths[path] = (host + path, max(verdict, self.paths.get(path, ("", ""))[1]))
        self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str):
        return next((self.paths[path[:n]] for n in self.sizes if n <= len(path) and path[:n] in self.paths), None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind (rules first): `open` holds the rule hosts around the current key."""
    part, open_ = None, []
    for batch in batches:
        names, verdicts, urls = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "rule", "host", "path", "verdict"))
        for i, (p, key, rule, host, path, verdict) in enumerate(zip(*columns)):
            if p != part:
                part, open_ = p, []
            while open_ and not key.startswith(open_[-1].key):
                open_.pop()
            if rule:
                if not open_ or open_[-1].key != key:
                    open_.append(Nest(key))
                open_[-1].add(host, path, verdict)
                continue
            best = None
            for nest in reversed(open_):
                found = nest.longest(path)
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            urls.append(i)
            names.append(best and best[0])
            verdicts.append(best and best[1])
        kept = batch.take(pa.array(urls, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column("row"), kept.column("host"), kept.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                         ["row", "host", "path", "rule", "verdict"])


def judged(rows: DataFrame, rules: DataFrame, keep: list[str], url_column: str = "url", default: str = "allow") -> DataFrame:
    """Columns `keep` of every row with host, path, rule (host and path of the longest rule that fits, else null) and
    verdict (the rule's, else `default`).

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with its path; the
    longest host and path together wins, then the longer host; of two verdicts of one rule the later word (block
    before allow). Rules without a host fit nothing; a null path is empty. A null url, or one without `://`, has an
    empty host and path and fits no rule. Repeated rows are each judged; other columns are ignored.

    Range bounds come from SAMPLE keys with the smallest hash; rows with one key are spread by a hash of the row, so a
    host with a third of all rows takes as many ranges as it needs.
    """
    spark = rows.sparkSession
    url = rows.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"),
                      host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"),
                      F.xxhash64(*keep, url_column).alias("tie")).withColumn("key", reversed_host(F.col("host")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = smallest(url.select("key", "tie", F.xxhash64("key", "tie").alias("place")), "place", SAMPLE)
    sample = sorted((r.key, r.tie) for r in sample.collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    kind = url.schema["row"].dataType.simpleString()
    placed = url.mapInArrow(_ranges(bounds, False), f"part int, row {kind}, host string, path string, tie long, key string")
    given = rules.filter("host != ''").select(F.translate("host", BIG, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").withColumn("key", reversed_host(F.col("host")))
    reaching = given.mapInArrow(_ranges(bounds, True), "part int, host string, path string, verdict string, key string")
    both = placed.select("part", "key", F.lit(False).alias("rule"), "host", "path", F.lit(None).cast("string").alias("verdict"), "row").unionByName(
        reaching.select("part", "key", F.lit(True).alias("rule"), "host", "path", "verdict", F.lit(None).cast(kind).alias("row")))
    swept = both.repartition(parts, "part").sortWithinPartitions("part", "key", F.desc("rule")).mapInArrow(
        _sweep, f"row {kind}, host string, path string, rule string, verdict string")
    return swept.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
