"""Histograms: single and composite keys, nested arrays, fixed domains, several groupings in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.session import materialise


def counts(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Counts of the keys joined by '/'; nulls as empty."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return rows.groupBy(F.concat_ws("/", *texts).alias("key")).agg(F.count("*").alias(name))


def nested(rows: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """(histogram, key, n) over the elements of several arrays in one pass; null elements don't count."""

    def tag(name: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(name).alias("histogram"), x.cast("string").alias("key"))

    tagged = [F.transform(a, tag(h)) for h, a in arrays.items()]
    exploded = rows.select(F.explode(F.concat(*(F.coalesce(a, F.array().cast("array<struct<histogram:string,key:string>>")) for a in tagged))).alias("x"))
    return exploded.select("x.*").filter("key is not null").groupBy("histogram", "key").agg(F.count("*").alias("n"))


def grouping_sets(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(histogram, key, n): one pass for several groupings; a histogram is named by its keys joined by 'x'."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    texts = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    grouped = texts.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("_gid"), F.count("*").alias("n"))

    def gid(own: Sequence[str]) -> int:
        return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)

    name = reduce(lambda c, s: c.when(F.col("_gid") == gid(s), "x".join(s)), sets, F.when(F.lit(False), ""))
    value = reduce(lambda c, s: c.when(F.col("_gid") == gid(s), F.concat_ws("|", *s)), sets, F.when(F.lit(False), ""))
    return grouped.select(name.alias("histogram"), value.alias("key"), "n")


#: Up to so many symbols are counted side by side, without taking the texts apart.
SIDE_BY_SIDE = 64


def zero_filled(rows: DataFrame, text: str, domain: DataFrame) -> DataFrame:
    """(symbol, n) for every symbol of the domain, single characters: how often the texts hold it.

    A small domain is counted in one pass: a symbol's count is what a text loses in length without it, and only sums are
    shuffled. Of a larger one, an alphabet, the texts are first cut down to its symbols, whose counts are summed before the
    shuffle. Null texts hold nothing; symbols that repeat in the domain have a row each.
    """
    symbols = sorted({r[0] for r in domain.select("symbol").distinct().collect() if r[0]})  # code points, 1,114,112 at most
    if len(symbols) <= SIDE_BY_SIDE:
        n = F.length(text)
        sums = rows.agg(*(F.coalesce(F.sum(n - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))), F.lit(0)).alias(f"_{i}") for i, c in enumerate(symbols)), F.count("*").alias("_rows"))
        found = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("symbol"), F.col(f"_{i}").alias("_n")) for i, c in enumerate(symbols)))).alias("_c")).select("_c.*") if symbols else domain.limit(0).select("symbol", F.lit(0).alias("_n"))
    else:
        others = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in symbols) + "]"
        kept = rows.select(F.explode(F.split(F.regexp_replace(text, others, ""), "")).alias("symbol"))
        found = kept.groupBy("symbol").agg(F.count("*").alias("_n"))
    return domain.join(found, "symbol", "left").select("symbol", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def conditional(rows: DataFrame, conditions: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """One row: counts of the rows that meet each condition, and sums."""
    return rows.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (sums or {}).items()))


def events_by(rows: DataFrame, key: str, events: Column) -> DataFrame:
    """(key, n): the summed sizes of the event arrays; groups without events keep 0."""
    return rows.groupBy(key).agg(F.sum(F.greatest(F.size(F.coalesce(events, F.array())), F.lit(0))).alias("n"))


def distinct_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts, one column each."""
    return rows.agg(*(F.count_distinct(c).alias(c) for c in columns))


def pair_summary(events: DataFrame, pairs_total: int, repeats: int) -> DataFrame:
    """One row over scheduled events (pair, font, source): occurrences, forced characters, target, reached, unique pairs."""
    target = pairs_total * repeats
    return events.agg(
        F.count("*").alias("occurrences"),
        (F.count("*") * 2).alias("forced_characters"),
        F.lit(target).cast("long").alias("target"),
        (F.count("*") == target).alias("reached"),
        F.count_distinct("pair").alias("unique_pairs"),
    )


#: Bins of an open range in a narrowing round.
BINS = 4096


def ranked_values(rows: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values of the given 0-based ranks among the column's values, exactly. Null and NaN aren't values.

    Each round counts, in one pass for all ranks, the values of every open range in BINS bins on the executors, and goes on
    in each rank's bin until it holds one value. A range with fewer doubles than bins is counted value by value. The values
    are written once; six rounds are the most that doubles need.
    """
    values = materialise(rows.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    open_ = {rank: (low, high, rank) for rank in ranks}
    done: dict[int, float] = {}
    while True:
        done |= {rank: low for rank, (low, high, _) in open_.items() if low == high}
        open_ = {rank: at for rank, at in open_.items() if rank not in done}
        if not open_:
            return done
        ranges = sorted({(low, high) for low, high, _ in open_.values()})
        place = F.lit(None).cast("struct<r:int,b:double>")
        for i, (low, high) in enumerate(ranges):
            width = (high - low) / BINS
            whole = math.isfinite(width) and width > math.ulp(max(abs(low), abs(high)))
            bin_ = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).cast("double") if whole else F.col("v") if math.isfinite(width) else F.floor(F.col("v") / (high / BINS))
            place = F.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("r"), bin_.alias("b"))).otherwise(place)
        counted = values.select("v", place.alias("p")).filter("p is not null").groupBy("p").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("p").collect()  # ranks x bins
        for rank, (low, high, left) in open_.items():
            own = ranges.index((low, high))
            for b in counted:
                if b["p"]["r"] == own:
                    if left < b["n"]:
                        open_[rank] = (b["low"], b["high"], left)
                        break
                    left -= b["n"]


def percentiles(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row of exact linear-interpolated percentiles, one column p<share*100> each; null without values. Only bin counts
    are shuffled, not the values."""
    value = F.col(column).cast("double")
    n = rows.agg(F.count(F.when(~F.isnan(value), value))).first()[0]
    places = [share * (n - 1) for share in shares]
    ranks = sorted({min(n - 1, int(at) + step) for at in places for step in (0, 1)}) if n else []
    found = ranked_values(rows, column, ranks) if n else {}
    out = [found[int(at)] + (at - int(at)) * (found[min(n - 1, int(at) + 1)] - found[int(at)]) if n else None for at in places]
    return rows.sparkSession.createDataFrame([tuple(out)], ", ".join(f"p{round(s * 100)} double" for s in shares))


def counters(rows: DataFrame, keys: dict[str, Column], amounts: dict[str, Column] | None = None) -> DataFrame:
    """(counter, key, n): several counters over the rows in one pass. A null key isn't counted; a counter adds 1 for each
    row unless amounts names what it adds."""
    amounts = amounts or {}
    each = [F.struct(F.lit(c).alias("counter"), k.cast("string").alias("key"), amounts.get(c, F.lit(1)).cast("long").alias("n")) for c, k in keys.items()]
    return rows.select(F.explode(F.array(*each)).alias("_c")).filter("_c.key is not null").groupBy("_c.counter", "_c.key").agg(F.sum("_c.n").alias("n"))
