"""Fill-in-middle transformation (operator 13): a table-driven byte automaton finds the units, a second pass cuts.

The automaton reads the bytes of all texts of a batch as one stream, with an end symbol after each text. It has a state
for what the last bytes were (nothing, white space, a word, `<`, `<` and a sentinel's letter) and emits, at each symbol,
whether it starts a code point, whether a unit ends before it and whether it closes a sentinel. Two symbols decide the
state whatever came before, so the stream is cut into lanes that start two symbols early and step through the table side
by side. The first pass counts what is emitted for each text; the second finds the bytes at which the drawn units end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glyphmill.llm._common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred of these so many have their suffix first.
FIM_PERCENT, SPM_PERCENT, SEED = 50, 80, 42

#: Symbols: what a byte is to the automaton.
SPACE, OPEN, LETTER, CLOSE, LEAD, CONTINUATION, END = range(7)
#: States: what stood before. A state's number fits in the low three bits of a table entry, what it emits above them.
FRESH, BLANK, WORD, OPENED, NAMED = range(5)
POINT, CUT, MARK = 1, 2, 4
#: Symbols that decide the state whatever came before them, and lanes that step side by side.
WARM_UP, LANES = 2, 4096


def symbol_table() -> np.ndarray:
    """The symbol of each byte."""
    table = np.full(256, LEAD, np.uint8)
    table[0x80:0xC0] = CONTINUATION
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[ord("<")], table[ord(">")] = OPEN, CLOSE
    table[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
    return table


def transition_table() -> np.ndarray:
    """Entry state * 7 + symbol: the next state, and what is emitted shifted by three bits."""
    table = np.zeros(5 * 7, np.uint8)
    for state in (FRESH, BLANK, WORD, OPENED, NAMED):
        for symbol in range(7):
            after = {SPACE: BLANK, OPEN: OPENED, LETTER: NAMED if state == OPENED else WORD, END: FRESH}.get(symbol, WORD)
            emitted = POINT * (symbol not in (CONTINUATION, END))
            emitted |= CUT * (symbol in (SPACE, END) and state in (WORD, OPENED, NAMED) or symbol == END and state == BLANK)
            emitted |= MARK * (symbol == CLOSE and state == NAMED)
            table[state * 7 + symbol] = after | emitted << 3
    return table


SYMBOLS, TRANSITIONS = symbol_table(), transition_table()


def scan(symbols: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """What the automaton emits at each symbol of a stream that begins fresh."""
    if not len(symbols):
        return np.zeros(0, np.uint8)
    steps = -(-len(symbols) // lanes)
    lanes = -(-len(symbols) // steps)
    padded = np.full(WARM_UP + lanes * steps, END, np.uint8)
    padded[WARM_UP : WARM_UP + len(symbols)] = symbols
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WARM_UP + steps)[::steps].T)
    state, emitted = np.zeros(lanes, np.uint8), np.empty((steps, lanes), np.uint8)
    for j, row in enumerate(rows):
        entry = TRANSITIONS[state * 7 + row]
        state = entry & 7
        if j >= WARM_UP:
            emitted[j - WARM_UP] = entry >> 3
    return emitted.T.reshape(-1)[: len(symbols)]


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, the texts' offsets in them, and the symbols with an end after each text."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    symbols = np.full(len(data) + n, END, np.uint8)
    symbols[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = SYMBOLS[data]
    return data, offsets, symbols


def _draws(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    return np.minimum(first, second), np.maximum(first, second)


def _transform(batch: pa.RecordBatch, fim_percent: int, spm_percent: int) -> pa.RecordBatch:
    column = batch.column("__gm_text").fill_null(b"")
    data, offsets, symbols = _stream(column)
    emitted = scan(symbols)
    first = offsets[:-1] + np.arange(len(column))  # where each text stands in the stream
    last = offsets[1:] + np.arange(len(column))  # its end symbol
    points = np.concatenate([[0], np.cumsum(emitted & POINT, dtype=np.int64)])
    cuts, marks = np.flatnonzero(emitted & CUT), np.flatnonzero(emitted & MARK)
    cuts_before = np.searchsorted(cuts, first)
    n = np.searchsorted(cuts, last, "right") - cuts_before
    marked = np.searchsorted(marks, last) > np.searchsorted(marks, first)
    h = [np.array(batch.column(f"__gm_h{i}").to_numpy(zero_copy_only=False), np.int64) for i in range(1, 5)]
    plain = (first == last) | marked | (h[2] % 100 >= fim_percent)
    spm = h[3] % 100 < spm_percent
    # the second pass: the place in the stream after the first so many units of a text
    ends = np.concatenate([cuts, [0]])
    places = [np.where(k > 0, ends[np.where(k > 0, cuts_before + k - 1, -1)], first) for k in _draws(h, n)]
    counted = [points[b] - points[a] for a, b in ((first, places[0]), (places[0], places[1]))]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    view, made = data.tobytes(), []
    for i, at in enumerate(zip(offsets[:-1].tolist(), (places[0] - np.arange(len(n))).tolist(), (places[1] - np.arange(len(n))).tolist(), offsets[1:].tolist(), strict=True)):
        a, b, c, d = at
        if plain[i]:
            made.append(view[a:d])
        elif spm[i]:
            made.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
        else:
            made.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    output = pa.array(made, pa.binary())
    output = pa.Array.from_buffers(pa.string(), len(made), output.buffers())  # as valid as the text was
    chars = [pa.array(c, pa.int64(), mask=plain) for c in counted]
    return pa.RecordBatch.from_arrays([batch.column("__gm_key"), pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, output], ["__gm_key", "n", "form", "prefix_chars", "middle_chars", "output"])


def fim_transform(docs: DataFrame, key: str = "doc_id", text: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each document: key, n units, form (plain, psm or spm), prefix_chars, middle_chars (code points, null where
    plain) and output, the transformed text.

    Chance is a hash of seed and key, so reruns agree; a null key counts as ''. Null and empty texts, and texts that hold a
    sentinel already, stay plain. A text of any length is cut whole; work is linear in its bytes, memory a few times the
    larger of 8 MB and the longest text. Repeated rows give equal rows; an empty table gives an empty one; further columns
    are ignored, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long").alias(f"__gm_h{i}") for i in range(1, 5)]
    rows = docs.select(F.col(key).alias("__gm_key"), F.col(text).cast("binary").alias("__gm_text"), *draws)
    longs = [StructField(c, LongType()) for c in ("prefix_chars", "middle_chars")]
    schema = StructType([StructField("__gm_key", docs.schema[key].dataType), StructField("n", LongType()), StructField("form", StringType()), *longs, StructField("output", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text="__gm_text"):
                yield _transform(part, fim_percent, spm_percent)

    return rows.mapInArrow(run, schema).withColumnRenamed("__gm_key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from: a transformed text holds each sentinel once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix, suffix = (F.when(form == "psm", parts[i]).otherwise(parts[j]) for i, j in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op13_byte_fim(docs: DataFrame) -> DataFrame:
    """The contract's digests of the outputs and of the texts rebuilt from them."""
    made = fim_transform(docs)
    digests = [F.sha2(c, 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS d1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS d2,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 80 AS spm
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(d1, d2)], '') AS p, array_to_string(u[least(d1, d2) + 1:greatest(d1, d2)], '') AS m, array_to_string(u[greatest(d1, d2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
