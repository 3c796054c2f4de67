"""Phrase collocation mining (operator 11): candidate phrases by hashed bucket counts and Apriori pruning, then exact scores.

Each pass over the texts counts the phrases of one length exactly and, in a table of buckets, the hashes of the next
length's. A bucket that reaches the support becomes a bit; the bits are broadcast, and a phrase of the next pass is counted
only if its bucket's bit is set and the bits of both its shorter parts are, which come from the exact counts of the pass
before. Bits only prune: a phrase stays by its exact count alone, so no result depends on the table's size, which follows
the text up to MOST_BITS.

A task works on slices of some megabytes: bytes are told apart by a table, words are cut, numbered and hashed in arrays,
and a slice sends one row for each different phrase. Spark sums up before and after the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise, slices

SUPPORT, TOP, COVERED_PERCENT, SCALE = 10, 2000, 50, 1_000_000
NO_LANG = "und"
#: The table of buckets has two to the power of these bits: about one for each BYTES_A_BUCKET of text, in these bounds, so a
#: broadcast table of bits has 16 MB at most and a task's counters 128 MB.
LEAST_BITS, MOST_BITS, BYTES_A_BUCKET = 16, 27, 32
#: A task sends its counters in chunks of so many bits of the table.
CHUNK_BITS = 18
#: Bits in a row of a table made from exact counts, and groups that are ranked apart before a language's best are.
ROW_BITS, SALTS = 1 << 15, 256
HEAD = 20
SLICE_BYTES = 4 << 20

INSIDE, BLANK, BREAK = range(3)
#: A row of a pass: a phrase's count; with a null phrase a language's words; with a null language packed counters.
SCHEMA = "lang string, phrase binary, n long"


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, INSIDE, np.uint8)
    kinds[[0x20, 0x09]] = BLANK
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
    return kinds


def _lowered() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    return low


KINDS, LOWERED = _byte_kinds(), _lowered()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over their range, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _followed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its bytes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    held = words.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    lengths = np.diff(offsets)
    powers = np.cumprod(np.full(max(1, int(lengths.max())), 0x100000001B3, np.uint64), dtype=np.uint64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[at], dtype=np.uint64)])
    return _mixed(sums[offsets[1:]] - sums[offsets[:-1]])


class Words:
    """The words of a slice in their order: codes in a dictionary, languages, and which words the same piece holds."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("text").fill_null(b"")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        kinds = KINDS[data]
        inside = kinds == INSIDE
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a text's first byte, or the end
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])))
        lengths = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(LOWERED[data[inside]])]).dictionary_encode()
        doc = np.searchsorted(offsets, starts, "right") - 1
        # texts without a byte share an offset with the next one; searchsorted from the right takes the text that holds it
        langs = batch.column("lang").fill_null(NO_LANG).dictionary_encode()
        self.words, self.langs = words.dictionary, langs.dictionary
        self.code = np.asarray(words.indices).astype(np.int64)
        self.lang = np.asarray(langs.indices).astype(np.int64)[doc]
        piece = np.cumsum(kinds == BREAK, dtype=np.int32)[starts] + doc if len(starts) else starts
        self.joined = piece[1:] == piece[:-1]
        self.hash = _hashes(self.words)[self.code]
        self.single = _followed(_hashes(self.langs)[self.lang], self.hash)

    def longer(self, shorter: np.ndarray, words: int) -> np.ndarray:
        """Hashes of phrases one word longer than those of the given hashes."""
        return _followed(shorter[:-1], self.hash[words - 1 :]) if len(shorter) > 1 else shorter[:0]

    def counted(self, at: np.ndarray, words: int) -> pa.RecordBatch | None:
        """Rows of the phrases that start at the given words."""
        if not len(at):
            return None
        ids = self.lang[at]
        for k in range(words):
            ids = ids * len(self.words) + self.code[at + k]
            if k < words - 1:  # numbered anew, so that the product stays within 64 bits
                ids = np.unique(ids, return_inverse=True)[1]
        _, first, n = np.unique(ids, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.words.take(pa.array(self.code[first + k])) for k in range(words)]
        phrase = parts[0] if words == 1 else pc.binary_join_element_wise(*parts, " ")
        return _rows(self.langs.take(pa.array(self.lang[first])), phrase.cast(pa.binary()), n)


def _rows(lang: pa.Array | None, phrase: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()) if lang is None else lang, pa.nulls(len(n), pa.binary()) if phrase is None else phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _packed(counters: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of the table: the chunk's number, the task's own mark, the places in the chunk that were hit, four
    bytes each, then their counts, a byte each. The mark keeps equal chunks of two tasks apart."""
    size, mark = 1 << min(bits, CHUNK_BITS), uuid.uuid4().bytes
    for chunk in range(len(counters) // size):
        held = counters[chunk * size : (chunk + 1) * size]
        at = np.flatnonzero(held)
        if len(at):
            yield _rows(None, pa.array([chunk.to_bytes(4, "little") + mark + at.astype("<u4").tobytes() + held[at].tobytes()], pa.binary()), np.zeros(1, np.int64))


def _unpacked(held: pa.Buffer) -> tuple[int, np.ndarray, np.ndarray]:
    n = (len(held) - HEAD) // 5
    return int(np.frombuffer(held, "<u4", 1)[0]), np.frombuffer(held, "<u4", n, HEAD), np.frombuffer(held, np.uint8, n, HEAD + 4 * n)


def _has(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    bucket = hashes >> np.uint64(64 - bits)
    return (table[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _count_pass(length: int, bits: int, longest: int, shorter, buckets):
    """A pass over (lang, text) batches for phrases of `length` words. shorter and buckets are broadcast tables of bits: of
    the frequent phrases one word shorter, and of the hashed counts of this length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits if length < longest else 0, np.uint8)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                found = Words(part)
                if not len(found.code):
                    continue
                hashes, keep = found.single, np.ones(len(found.code), bool)
                if length == 1:
                    total = np.bincount(found.lang, minlength=len(found.langs))
                    yield _rows(found.langs, None, total)
                for words in range(2, length + 1):
                    if words == length:  # both parts that are one word shorter are frequent
                        keep = keep & _has(shorter.value, hashes, bits)
                    keep = keep[:-1] & keep[1:] & found.joined[words - 2 :]
                    hashes = found.longer(hashes, words)
                if length > 1:
                    keep = keep & _has(buckets.value, hashes, bits)
                made = found.counted(np.flatnonzero(keep), length)
                if made is not None:
                    yield made
                if length < longest:
                    after = keep[:-1] & keep[1:] & found.joined[length - 1 :]
                    bucket, n = np.unique(found.longer(hashes, length + 1)[after] >> np.uint64(64 - bits), return_counts=True)
                    bucket = bucket.astype(np.int64)
                    counters[bucket] = np.minimum(255, counters[bucket] + n).astype(np.uint8)  # above the support more doesn't matter
        yield from _packed(counters, bits)

    return run


def _frequent_buckets(packed: DataFrame, bits: int, support: int) -> DataFrame:
    """(row, held): the bits of each chunk, of all tasks' counters together. A task streams the chunks that it is given and
    holds a byte for each of their buckets."""
    size = 1 << min(bits, CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for held in batch.column("phrase"):
                chunk, at, more = _unpacked(held.as_buffer())
                table = tables.setdefault(chunk, np.zeros(size, np.uint8))
                table[at] = np.minimum(table[at].astype(np.int16) + more, 255)
        for chunk, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.packbits(table >= support, bitorder="little").tobytes()], pa.binary())], ["row", "held"])

    return packed.select("phrase").repartition(F.substring("phrase", 1, 4)).mapInArrow(run, "row long, held binary")


def _frequent_rows(phrases: DataFrame, length: int, bits: int) -> DataFrame:
    """(row, held): the bits of phrases of the given length, 32,768 a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase").cast(pa.string()), " ").flatten()
            hashes = _hashes(batch.column("lang"))
            for word in _hashes(words).reshape(-1, length).T:
                hashes = _followed(hashes, word)
            yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(64 - bits)).astype(np.int64))], ["bucket"])

    buckets = phrases.select("lang", "phrase").mapInArrow(run, "bucket long")
    return buckets.groupBy(F.shiftright("bucket", 15).alias("row")).agg(F.bitmap_construct_agg(F.col("bucket").bitwiseAND(ROW_BITS - 1)).alias("held"))


def _broadcast(rows: DataFrame, bits: int):
    """The rows as one table of 2^bits bits, 16 MB at most, on the driver and then on every executor."""
    table = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row, held in rows.toLocalIterator():
        table[row * len(held) : (row + 1) * len(held)] = np.frombuffer(bytes(held), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)


def _bits_for(docs: DataFrame) -> int:
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (n // BYTES_A_BUCKET).bit_length()))


def frequent_phrases(docs: DataFrame, longest: int = 3, support: int = SUPPORT, bits: int | None = None) -> dict[int, DataFrame]:
    """Exact counts (lang, phrase, n) of the phrases of 1 to `longest` words with `support` or more occurrences, by length;
    under 0 a row (lang, n) for each language: its words, all of them.

    Words are lower-cased in A-Z only; phrases don't cross `.,;:!?` or line breaks. Occurrences overlap; repeated documents
    count as often as they occur. Null texts are empty, a null language is `und`. A text of any length is read whole; a task
    holds some twenty times the larger of 4 MB and its longest text, and a byte for each bucket.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    bits = max(15, bits or _bits_for(docs))
    rows = docs.select("lang", F.col("text").cast("binary").alias("text"))
    found: dict[int, DataFrame] = {}
    shorter = buckets = None
    for length in range(1, longest + 1):
        passed = rows.mapInArrow(_count_pass(length, bits, longest, shorter, buckets), SCHEMA)
        # a chunk of counters is a key of its own, so it passes through; phrases are summed before and after the shuffle
        summed = passed.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        held = materialise(summed.filter((F.col("n") >= support) | F.col("lang").isNull() | F.col("phrase").isNull()), f"phrases{length}")
        if length == 1:
            found[0] = held.filter("phrase is null").select("lang", "n")
        phrases = held.filter("lang is not null and phrase is not null")
        found[length] = phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
        if length < longest:
            shorter = _broadcast(_frequent_rows(phrases, length, bits), bits)
            buckets = _broadcast(_frequent_buckets(held.filter("lang is null"), bits, support), bits)
    return found


def _cut(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, longest: int = 3, support: int = SUPPORT, top: int = TOP, covered_percent: int = COVERED_PERCENT, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to `longest` words.

    A phrase of count a, cut after its first k words into parts of counts l and r, scores floor(1000000 a a / (l r)); its
    lowest cut counts, the smallest k of equal ones. A phrase goes if a longer candidate that holds its words has
    covered_percent of its occurrences. Ties in score and count are settled by the phrase's bytes. Products are decimals of
    38 digits, exact for counts under 10^15. Languages without a candidate have no row; no documents give no rows. Columns
    other than lang and text are ignored.
    """
    found = frequent_phrases(docs, longest, support, bits)
    counts = found[1]
    for length in range(2, longest):
        counts = counts.unionByName(found[length])
    candidates = found[2]
    for length in range(3, longest + 1):
        candidates = candidates.unionByName(found[length])
    candidates = candidates.withColumn("words", F.split("phrase", " "))
    size = F.size("words")

    longer = candidates.filter(size > 2)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _cut(F.col("words"), i, m))))
    covering = longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_over"))
    kept = candidates.join(covering, ["lang", "phrase"], "left").filter(F.col("_over").isNull() | (F.col("_over") * 100 < F.col("n") * covered_percent)).drop("_over")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", _cut(F.col("words"), F.lit(1), F.col("k")).alias("_first"), _cut(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("_rest"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = cuts.join(counts.select(F.col("lang"), F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    a, product = F.col("a").cast("decimal(19,0)"), F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")
    scored = cuts.withColumn("_squared", a * a * F.lit(SCALE)).withColumn("_product", product).withColumn("score", F.expr("_squared div _product"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("_c")).select("lang", "phrase", "_c.a", "_c.l", "_c.r", "_c.score")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language may hold most candidates: salted groups give up their worse ones before the language is ranked
    salted = lowest.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("rank") <= top).drop("_s")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(found[0]), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_pcy_phrases(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM words WHERE len(w) > 2),
counts AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
covering AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM candidates WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM candidates WHERE size = 3)
  GROUP BY lang, phrase),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covering o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * c.f),
cuts AS (
  SELECT lang, phrase, f, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM kept
  UNION ALL SELECT lang, phrase, f, 2, array_to_string(w[1:2], ' '), w[3] FROM kept WHERE size = 3),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.first = x.phrase JOIN counts y ON c.lang = y.lang AND c.rest = y.phrase),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest WHERE place = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""
