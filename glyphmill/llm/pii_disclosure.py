"""Personal data and what gives it away (operator 2), in DataFrame and SQL functions only.

Base spans are the stated patterns. The information-theoretic part counts over whole documents: for each personal value v
and each term t of the documents that hold v, corpus counts bound p(v | t) from below, with the confidence of CONFIDENCE
deviations (Wilson's interval), so that a term must have shown itself: one document proves nothing, however rare its words.
The bound's negative logarithm is what is still hidden of v from one who knows t. Where that is at most GENERALISE_BITS the term is generalised, at most REMOVE_BITS removed, wherever it stands in the
documents of v.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import materialise

KINDS = ("email", "ip", "card", "phone")
#: The stated patterns. Possessive quantifiers and the guards before them change no match: what follows a
#: possessive class can't match inside it, and a run that fails from its beginning fails from all its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is worth a search.
HINTS = {"email": "text like '%@%'", "ip": r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'", "card": "text rlike '[0-9](?:[ -]?[0-9]){12}'", "phone": "text like '%+%'"}
#: A term: three or more letters that aren't part of an address.
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}@])(?![A-Za-z0-9._%+-]{0,64}+@)"
#: Addresses are found on the way to the terms, so that no term is taken from within one.
TERM_OR_ADDRESS = f"(?:{PATTERNS['email']})|(?:{TERM})"
#: The same where a text has no address: nothing follows a term that would make it part of one.
BARE_TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
#: Deviations of the lower bound of p(value | term); hidden bits from which a term is generalised, and removed.
CONFIDENCE, GENERALISE_BITS, REMOVE_BITS = 1.96, 2.0, 1.0
#: Matches whose offsets one fold adds up; longer lists are folded in chunks, so work is linear but for n / FOLD chunk sums.
FOLD = 256

_DIGITS = "regexp_replace(x.f, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when i % 2 = 1 then cast(substr({d}, length({d}) - i + 1, 1) as int)"
    " else cast(substr({d}, length({d}) - i + 1, 1) as int) * 2 - if(cast(substr({d}, length({d}) - i + 1, 1) as int) > 4, 9, 0) end) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": "forall(split(x.f, '[.]'), p -> p rlike '^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?$')",
    "card": f"case when length({_DIGITS}) between 13 and 19 then {_LUHN.format(d=_DIGITS)} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with value bound to name: evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def spans_sql(text: str, pattern: str, valid: str = "true", hint: str = "true") -> str:
    """SQL for array<struct<s int, e int, f string>>: the valid matches with their code point offsets.

    The texts between matches and the matches alternate; running lengths are offsets. Matches are folded in chunks of FOLD,
    whose lengths are then added up: appending to one array match by match would copy it each time.
    """
    none = "cast(array() as array<struct<s: int, e: int, f: string>>)"
    # arrays_zip pads the matches with a null beside the text after the last one
    zipped = f"filter(arrays_zip(split({text}, {_quoted(pattern)}, -1), regexp_extract_all({text}, {_quoted(pattern)}, 0)), z -> z.`1` is not null)"
    span = "named_struct('s', a.pos + length(x.p), 'e', a.pos + length(x.p) + length(x.f), 'f', x.f)"
    step = f"(a, x) -> named_struct('pos', a.pos + length(x.p) + length(x.f), 'out', case when {valid} then concat(a.out, array({span})) else a.out end)"
    chunks = f"transform(sequence(0, (size(m) - 1) div {FOLD}), i -> aggregate(slice(m, i * {FOLD} + 1, {FOLD}), named_struct('pos', 0, 'out', {none}), {step}))"
    bases = "aggregate(c, named_struct('pos', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('pos', a.pos + x.pos, 'out', concat(a.out, array(a.pos)))).out"
    moved = "flatten(zip_with(c, o, (x, b) -> transform(x.out, y -> named_struct('s', y.s + b, 'e', y.e + b, 'f', y.f))))"
    whole = _let("c", chunks, _let("o", bases, moved))
    named = f"transform({zipped}, z -> named_struct('p', z.`0`, 'f', z.`1`))"
    return f"case when {hint} then {_let('m', named, f'case when size(m) = 0 then {none} else {whole} end')} else {none} end"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text and an array of spans for each kind; null texts as empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *(F.expr(spans_sql("text", PATTERNS[k], _VALID[k], HINTS[k])).alias(k) for k in KINDS))


def _classes(pairs: DataFrame, what: str, *more: str) -> DataFrame:
    """pairs (rid, what, more...) with `set`, which names the set of rows that hold `what`: values, or terms, of one set
    behave alike and are counted together, so a document of many unique ones forms no product of them."""
    sets = pairs.groupBy(what).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("rid")).alias("_a"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("_b"))
    return pairs.join(sets.select(what, F.struct("_n", "_a", "_b").alias("set")), what).select("rid", what, "set", *more)


def lower_bound(hits, n, root=math.sqrt):
    """The lower end of Wilson's interval for a share of which `hits` of n were seen; numbers or, with Spark's root, columns."""
    z = CONFIDENCE**2
    return (hits + z / 2 - CONFIDENCE * root(hits * (n - hits) / n + z / 4)) / (n + z)


def disclosing_terms(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(rid, term, action) of the rows in `held` (rid, text, values): what the terms of a row disclose of its values.

    A term's documents are counted over all texts. The lower bound of p(v | t) is under together / term_docs, so a term of
    over 2^GENERALISE_BITS value_docs documents can't disclose the value, and neither can one of too few documents for the
    bound: such terms are left out before they meet a value, which loses none.
    """
    bits = 2.0**GENERALISE_BITS
    fewest = next(n for n in range(1, 1000) if lower_bound(n, n) * bits >= 1)
    values = held.select("rid", F.explode("values").alias("value")).distinct()
    sized = _classes(values, "value").select("rid", "set").distinct().withColumn("value_docs", F.col("set._n"))
    most = sized.groupBy("rid").agg(F.max("value_docs").alias("most"))
    words = F.array_distinct(F.expr(f"case when text like '%@%' then regexp_extract_all(lower(text), {_quoted(TERM)}, 0) else regexp_extract_all(lower(text), {_quoted(BARE_TERM)}, 0) end"))
    own = held.select("rid", F.explode(words).alias("term"))
    known = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    rare = own.join(known, "term").join(most, "rid").filter((F.col("term_docs") >= fewest) & (F.col("term_docs") <= bits * F.col("most")))
    terms = materialise(_classes(rare.select("rid", "term", "term_docs"), "term", "term_docs").withColumn("set", F.struct("set", "term_docs")), "terms")
    term_sets = terms.select("rid", F.col("set").alias("term_set")).distinct()
    value_sets = sized.select("rid", F.col("set").alias("value_set"), "value_docs")
    met = value_sets.join(term_sets, "rid").groupBy("value_set", "term_set", "value_docs").agg(F.count("*").alias("together"))
    hidden = -F.log2(lower_bound(F.col("together"), F.col("term_set.term_docs"), F.sqrt))
    telling = met.select("value_set", "term_set", hidden.alias("hidden")).filter(F.col("hidden") <= GENERALISE_BITS)
    reached = value_sets.join(telling, "value_set").groupBy("rid", "term_set").agg(F.min("hidden").alias("hidden"))
    action = F.when(F.col("hidden") <= REMOVE_BITS, F.lit("remove")).otherwise(F.lit("generalise"))
    return terms.join(reached, (terms["rid"] == reached["rid"]) & (terms["set"] == reached["term_set"])).select(terms["rid"], "term", action.alias("action"))


def find(docs: DataFrame) -> DataFrame:
    """A row for each input row: doc_id, text_hash, an array of base spans for each kind, and `terms`: array of
    struct<s, e, action>, where action is 'generalise' or 'remove'.

    Null texts count as empty and hold nothing; repeated rows are documents of their own, in all counts alike, and have equal
    results; null doc_ids are rows like others; further columns are ignored; an empty table gives an empty one. Very long
    texts are read whole, in linear work. Only documents with personal data are written with their texts; very frequent
    values and terms are counted with map-side sums, and no list of a value's documents is built.
    """
    values = ", ".join(f"transform({k}, v -> xxhash64('{k}', v.f))" for k in KINDS)
    holds = " or ".join(f"size({k}) > 0" for k in KINDS)
    found = base_spans(docs).withColumn("values", F.expr(f"array_distinct(concat({values}))")).withColumn("text", F.expr(f"case when {holds} then text end"))
    base = materialise(found.withColumn("rid", F.monotonically_increasing_id()), "personal-data")  # a row's number holds once it is written
    held = base.filter("text is not null").select("rid", "text", "values")
    telling = disclosing_terms(docs, held)
    places = held.select("rid", F.explode(F.expr(spans_sql("text", TERM_OR_ADDRESS))).alias("x")).filter(~F.contains(F.col("x.f"), F.lit("@")))
    places = places.select("rid", F.lower("x.f").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    near = places.join(telling, ["rid", "term"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "action"))).alias("terms"))  # within one text
    none = "cast(array() as array<struct<s: int, e: int, action: string>>)"
    return base.join(near, "rid", "left").select("doc_id", "text_hash", *KINDS, F.expr(f"coalesce(terms, {none})").alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by [EMAIL], [IP], [CARD], [PHONE], generalised terms by [TERM], removed ones by
    nothing; where spans overlap, the first one counts. Null texts stay null; other columns stay."""
    found = find(docs).dropDuplicates(["doc_id", "text_hash"])
    marks = [f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'm', '[{k.upper()}]'))" for k in KINDS]
    marks.append("transform(terms, x -> named_struct('s', x.s, 'e', x.e, 'm', if(x.action = 'remove', '', '[TERM]')))")
    found = found.select(F.col("doc_id").alias("__gm_id"), F.col("text_hash").alias("__gm_h"), F.expr(f"array_sort(concat({', '.join(marks)}))").alias("__gm_marks"))
    hashed = docs.withColumn("__gm_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = hashed.join(found, hashed["doc_id"].eqNullSafe(found["__gm_id"]) & (hashed["__gm_hash"] == found["__gm_h"]), "left")
    step = "(a, x) -> if(x.s < a.at, a, named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), x.m)))"
    clean = f"case when text is not null then aggregate(__gm_marks, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(text, a.at + 1))) end"
    return joined.withColumn("text", F.expr(clean)).select(*docs.columns)


def op2_pii_disclosure(docs: DataFrame) -> DataFrame:
    found = find(docs)
    shown = {k: f"transform({k}, x -> concat_ws(':', '{k}', x.s, x.e))" for k in KINDS}
    base = f"concat({', '.join(shown.values())})"
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.expr(f"sha2(array_join({base}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(concat({base}, transform(terms, x -> concat_ws(':', 'term', x.s, x.e))), ',')").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
