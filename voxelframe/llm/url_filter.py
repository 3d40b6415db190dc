"""URL rules and block lists by a cascade of Bloom filters, in DataFrame functions only.

The first filter holds the listed keys, the second those keys of the corpus that pass the first
without being listed, the third the listed keys that pass the second, and so on until no false
positive is left. Over the corpus's complete key universe the cascade is exact, and judging a URL
needs no join: its candidate keys (domain suffix + path prefix) are tested against bit arrays that
are constants of the expression. A level has at most MOST_BITS bits, whatever the number of keys;
a fuller level lets more keys through to the next.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import col, stage, unused, without

#: Bits of a level: so many per key, MOST_BITS (2 MB) at most.
BITS_PER_KEY, MOST_BITS = 10, 1 << 24


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """Every domain suffix of at most `labels` labels with every prefix of the path of a listed length."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), labels)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.when((host != "") & (labels > 0), F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).otherwise(F.array().cast("array<string>"))


def _bit_places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    h, step = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits))
    return [F.pmod(h + i * step, F.lit(bits)) for i in range(hashes)]


def _any_list(lists: dict[str, Cascade], test) -> Column:
    """Whether test holds for the cascade of the row's list."""
    return functools.reduce(lambda found, name: found | ((F.col("list") == name) & test(lists[name])), lists, F.lit(False))


def cascades(universe: DataFrame, listed: DataFrame, names: Iterable[str], most_levels: int = 64) -> dict[str, Cascade]:
    """A cascade for each name over the keys of listed (list, key), exact for the universe's column `key`.

    Nulls are no keys; listed keys need not occur in the universe, whose keys may repeat. A level of
    all lists is built at once. The universe is read for the first level alone: what passes it there
    and is not listed is sorted out before any shuffle. What reaches the driver of a level is the bits
    of each list, MOST_BITS at most, and its number of keys.
    """
    built = {name: Cascade() for name in names}
    held = stage(listed.where(F.col("list").isin(*built) & F.col("key").isNotNull()).select("list", "key").distinct())
    yes, other = held, None
    while open_lists := {r["list"]: r["n"] for r in held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}:  # a row for each list
        for name, n in open_lists.items():
            built[name].open_level(n, most_levels)
        lists = {name: built[name] for name in open_lists}
        places = F.coalesce(*[F.when(F.col("list") == name, F.array(*c.places(F.col("key"), -1))) for name, c in lists.items()])
        word = held.select("list", F.explode(places).alias("at")).groupBy("list", (F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
        words = {name: {} for name in lists}
        for r in word.collect():
            words[r["list"]][r["w"]] = r["b"]
        for name, c in lists.items():
            c.close_level(words[name])
        every = universe.where("key is not null").select(F.explode(F.array(*map(F.lit, lists))).alias("list"), "key") if other is None else other
        passed = every.where(_any_list(lists, lambda c: c.passes(F.col("key"), -1)))
        if other is None:
            passed = passed.distinct().join(yes, ["list", "key"], "left_anti")
        held, other = stage(passed), held
    return built


class Cascade:
    """Exact membership of listed keys among a complete key universe."""

    def __init__(self, universe: DataFrame | None = None, listed: DataFrame | None = None, most_levels: int = 64) -> None:
        """universe, listed: one string column `key` each; without them no key is listed."""
        self.levels: list[tuple[Column, int, int]] = []
        if universe is not None and listed is not None:
            self.levels = cascades(universe, listed.select(F.lit("").alias("list"), "key"), [""], most_levels)[""].levels

    def open_level(self, n: int, most_levels: int) -> None:
        """The size of a level for n keys; its bits follow."""
        if len(self.levels) == most_levels:
            raise RuntimeError("too many keys for levels of this size")
        bits = min(MOST_BITS, max(64, BITS_PER_KEY * n))
        self.levels.append((F.lit(None), bits, max(1, min(7, round(bits / n * math.log(2))))))

    def close_level(self, words: dict[int, int]) -> None:
        _, bits, hashes = self.levels[-1]
        full = [words.get(w, 0) for w in range((bits + 63) // 64)]
        self.levels[-1] = (F.from_json(F.lit(json.dumps(full)), "array<bigint>"), bits, hashes)

    def places(self, key: Column, level: int) -> list[Column]:
        _, bits, hashes = self.levels[level]
        return _bit_places(key, level % len(self.levels), bits, hashes)

    def passes(self, key: Column, level: int) -> Column:
        passes = F.lit(True)
        for at in self.places(key, level):
            word = F.get(self.levels[level][0], (at / 64).cast("int"))
            passes = passes & (F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return passes

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.passes(key, i), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of pages (default all) with host, path, rule and verdict of every URL.

    rules: (host, path, verdict), verdict allow or block. A rule fits its host and all subdomains
    if the URL's path starts with the rule's; the longest key host + path wins, of two verdicts for
    keys of one length block. blocked: one column `host`; a URL that no rule fits is blocked if its host or a
    parent domain is listed there, else allowed. Rows of rules and blocked with nulls do not count.

    A null URL and one without :// have empty host and path, no rule, and are allowed. Repeated rows
    are judged alike; an empty rule set allows all. Columns of pages named like the four new ones
    are replaced. Rule lists and block lists are tables; only their longest host and the distinct lengths of the rules'
    paths reach the driver.
    """
    spark = pages.sparkSession
    named = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.concat(F.lower("host"), "path").alias("key")).agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("n"))
    listed = named.select(F.when(F.col("block"), "block").otherwise("allow").alias("list"), "key", "labels", "n")
    if blocked is not None:
        listed = listed.unionByName(blocked.where("host is not null").select(F.lit("deny").alias("list"), F.concat(F.lower("host"), F.lit("\u0001")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.lit(None).cast("int").alias("n")))
    listed = stage(listed)
    most, lengths = listed.agg(F.coalesce(F.max("labels"), F.lit(0)), F.array_sort(F.collect_set("n"))).first()  # no more lengths than the longest path has characters
    labels, sizes = F.lit(most), F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    url = col(url_col)
    cols = without(keep or pages.columns, "host", "path", "rule", "verdict")
    cut = pages.select(*map(col, cols), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), labels, sizes)
    hosts = candidate_keys(F.col("host"), F.lit("\u0001"), labels, F.array(F.lit(1)))
    universe = cut.select(F.explode(F.concat(keys, hosts)).alias("key"))
    block, allow, deny = cascades(universe, listed, ("block", "allow", "deny")).values()
    all_keys, b, a = unused([*cols, "host", "path"], "keys", "b", "a")
    longest = lambda c: F.array_max(F.transform(c, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    best = cut.withColumn(all_keys, keys).withColumn(b, longest(F.filter(all_keys, block.contains))).withColumn(a, longest(F.filter(all_keys, allow.contains)))
    blocks = F.coalesce(F.col(a).isNull() | (F.col(b)["n"] >= F.col(a)["n"]), F.lit(False)) & F.col(b).isNotNull()
    verdict = F.when(blocks, "block").when(F.col(a).isNotNull(), "allow").when(F.exists(hosts, deny.contains), "block").otherwise("allow")
    return best.select(*map(col, cols), "host", "path", F.when(blocks, F.col(b)["k"]).otherwise(F.col(a)["k"]).alias("rule"), verdict.alias("verdict"))
