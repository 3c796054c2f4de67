"""Phrases (11), reply trees (12) and fill-in-middle (13) against brute force and their SQL."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import byte_fim, pcy_phrases, reply_trees
from glyphmill.llm._common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(rows, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    relation = con.sql(sql)
    assert sorted(relation.columns) == sorted(rows.columns)
    found = sorted((tuple(r[c] for c in relation.columns) for r in rows.collect()), key=str)
    assert found == sorted(relation.fetchall(), key=str)
    return found


# -- phrases ---------------------------------------------------------------------------------------------------------


def brute_phrases(docs, support, longest=3, top=2000, percent=50):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    found = defaultdict(list)
    for (lang, w), a in often.items():
        if any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= percent * a for (x, v), b in often.items() if len(v) > len(w)):
            continue
        score, k, left, right = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(of)[:top], 1))


def phrase_rows(df):
    return sorted(tuple(r) for r in df.collect())


def _prose(seed, n):
    draw = random.Random(seed)
    words = ["alpha", "BETA", "gamma", "é", "x-y", "do\u00a0not", "ß", "z"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r", " : ", "\u2003"]
    return ["".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_phrases_equal_brute_force(spark):
    texts = [*_prose(1, 120), "", None, "one", "...", "word " * 500, "A b. a B", "\u4e2d \u4e2d" * 30]
    docs = [(i, t, [None, "a", "b", "und", ""][i % 5], "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert phrase_rows(pcy_phrases.collocations(df, support=3)) == brute_phrases([(d[1], d[2]) for d in docs], 3)
    assert phrase_rows(pcy_phrases.collocations(df, support=3, longest=2, top=4)) == brute_phrases([(d[1], d[2]) for d in docs], 3, 2, 4)


def test_longer_phrases_go_pass_by_pass(spark):
    docs = [(i, t, "a", "s", 1) for i, t in enumerate(_prose(2, 60) + ["one two three four five"] * 5)]
    df = spark.createDataFrame(docs, DOCS)
    assert phrase_rows(pcy_phrases.collocations(df, support=4, longest=5)) == brute_phrases([(d[1], d[2]) for d in docs], 4, 5)


@pytest.mark.parametrize("bits", [15, None])
def test_buckets_prune_but_do_not_decide(spark, bits):
    """A table of buckets far too small, in which most are full, gives the same rows."""
    docs = table(spark, SF, "documents")
    found = phrase_rows(pcy_phrases.collocations(docs, bits=bits))
    assert found == brute_phrases([(r["text"], r["lang"]) for r in docs.collect()], 10)


def test_buckets_and_parts_prune():
    """Of a pass's phrases only those go on whose bucket and both parts have their bit."""
    text = b"a b c. " * 30 + b" ".join(b"w%d" % i for i in range(2000))
    batch = pa.record_batch({"lang": ["x"], "text": pa.array([text], pa.binary())})
    bits = 20

    class Held:
        def __init__(self, hashes):
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            self.value = np.zeros(1 << bits - 3, np.uint8)
            np.bitwise_or.at(self.value, bucket >> 3, (1 << (bucket & 7)).astype(np.uint8))

    def counted(rows):
        """Buckets of the packed counters, with their counts."""
        out = {}
        for r in rows:
            if r["lang"] is None:
                chunk, at, n = pcy_phrases._unpacked(pa.py_buffer(r["phrase"]))
                out |= dict(zip((at.astype(int) + (chunk << pcy_phrases.CHUNK_BITS)).tolist(), n.tolist(), strict=True))
        return out

    def phrases(rows):
        return {r["phrase"].decode(): r["n"] for r in rows if r["lang"] is not None and r["phrase"] is not None}

    held = lambda buckets: Held(np.array(list(buckets), np.uint64) << np.uint64(64 - bits))
    first = [r for b in pcy_phrases._count_pass(1, bits, 3, None, None)([batch]) for r in b.to_pylist()]
    words = phrases(first)
    assert len(words) == 2003 and words["a"] == 30
    often = Held(pcy_phrases._followed(pcy_phrases._hashes(pa.array(["x"] * 3)), pcy_phrases._hashes(pa.array(["a", "b", "c"]))))
    full = held(b for b, n in counted(first).items() if n >= 10)
    second = [r for b in pcy_phrases._count_pass(2, bits, 3, often, full)([batch]) for r in b.to_pylist()]
    assert phrases(second) == {"a b": 30, "b c": 30}
    assert list(counted(second).values()) == [30]


def test_phrase_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pcy_phrases.op11_pcy_phrases(empty).collect() == []
    clash = spark.createDataFrame([("x y " * 20, None, 1, "q", 2)], "text string, lang string, bucket int, phrase string, n int")
    rows = pcy_phrases.op11_pcy_phrases(clash).collect()
    # pairs of "x y x ..." are each held by a triple with as many occurrences, but for one
    assert {(r["lang"], r["phrase"], r["a"], r["n"]) for r in rows} == {("und", "x y x", 19, 40), ("und", "y x y", 19, 40)}


def test_phrase_sql(spark):
    docs = table(spark, SF, "documents")
    same_as_sql(pcy_phrases.op11_pcy_phrases(docs), pcy_phrases.SQL, documents=docs)


def test_scores_past_64_bits(spark):
    a = 3_000_000_000
    row = spark.range(1).selectExpr(f"cast({a}L as decimal(19,0)) a").selectExpr("a * a * 1000000 s", "a * a p").selectExpr("s div p q").first()
    assert row["q"] == 1_000_000


# -- reply trees ------------------------------------------------------------------------------------------------------

MESSAGES = "tree long, node long, parent long, role string, text string, score double, rank int"


def brute_paths(rows, top):
    """(tree, rank) -> nodes from the root to the leaf, of trees without repeated ids."""
    by = {(t, n): (p, s or 0.0) for t, n, p, _, _, s, _ in rows}
    parents = {(t, p) for t, n, p, *_ in rows if p is not None and (t, p) in by}
    found = defaultdict(list)
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while at is not None and (t, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = by[t, at][0]
        if at in seen:
            continue
        found[t].append((-sum(by[t, x][1] for x in path), n, path[::-1]))
    return {(t, i): p for t, of in found.items() for i, (_, _, p) in enumerate(sorted(of)[:top], 1)}


def _forest(seed):
    draw = random.Random(seed)
    rows = []
    for t in range(12):
        for n in range(draw.randrange(1, 40)):
            parent = None if n == 0 or draw.random() < 0.05 else draw.randrange(max(0, n - 4), n)
            rows.append((t, n, parent, draw.choice(["user", "assistant", None]), f"t{t} n{n}", float(draw.randrange(4)), 0))
    rows += [(50, n, n - 1 if n else None, "user", "deep", 1.0, 0) for n in range(300)]
    rows += [(51, 1, 2, "user", "ring", 1.0, 0), (51, 2, 3, "user", "ring", 1.0, 0), (51, 3, 1, "user", "ring", 1.0, 0), (51, 4, 1, "user", "below", 9.0, 0), (51, 5, 99, "user", "orphan", None, 0), (51, 6, 6, "user", "self", 1.0, 0)]
    rows += [(52, n, None if n == 0 else 0, "user", "wide", 1.0, 0) for n in range(200)]
    return rows


@pytest.mark.parametrize("top", [1, 3])
def test_paths_equal_brute_force(spark, top):
    rows = _forest(top)
    df = spark.createDataFrame(rows, MESSAGES).repartition(5)
    found = defaultdict(list)
    for r in reply_trees.reply_paths(df, "tree", "node", "parent", "score", top).collect():
        found[r["tree"], r["rank"]].append((r["position"], r["id"]["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == brute_paths(rows, top)
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in found.values())


def test_chosen_paths_are_formatted(spark):
    rows = [(1, 1, None, "user", "Q", 0.0, 0), (1, 2, 1, "assistant", "bad", 1.0, 0), (1, 3, 1, "assistant", "good", 5.0, 0), (1, 4, 3, "user", "thanks", 0.0, 0), (None, 1, None, "user", "no tree", None, 0), (2, None, None, "user", None, 1.0, 0)]
    df = spark.createDataFrame(rows, MESSAGES)
    made = reply_trees.format_paths(df, reply_trees.reply_paths(df, "tree", "node", "parent", "score", 2), "tree", "node")
    shown = {(r["tree"], r["rank"]): r for r in made.collect()}
    assert shown[1, 1]["formatted"] == "### user: Q</turn>\n### assistant: good</turn>\n### user: thanks</turn>\n"
    assert shown[1, 2]["formatted"] == "### user: Q</turn>\n### assistant: bad</turn>\n"
    assert [s["text"] for s in shown[1, 1]["segments"] if s["loss"]] == ["good"]
    assert shown[None, 1]["formatted"] == "### user: no tree</turn>\n" and shown[2, 1]["formatted"] == "### user: </turn>\n"


def test_repeated_ids_are_one_message(spark):
    rows = [(1, 1, None, "user", "b", 1.0, 0), (1, 1, None, "user", "a", 1.0, 0), (1, 1, None, "user", "a", 1.0, 0), (1, 2, 1, "assistant", "c", 1.0, 0)]
    df = spark.createDataFrame(rows, MESSAGES)
    made = reply_trees.format_paths(df, reply_trees.reply_paths(df, "tree", "node", "parent", "score"), "tree", "node").first()
    assert made["formatted"] == "### user: a</turn>\n### user: a</turn>\n### user: b</turn>\n### assistant: c</turn>\n"


CONVERSATIONS = "conv_id long, turn long, role string, text string, position int, loss string"


def test_conversations_equal_sql(spark):
    said = ["", None, "plain", "</turn>", "\\</turn>\n", "### user: hi</turn>\n### assistant: x", "\\", "\\\\", "a\\/b", "#### #", "</turn", "\u4e2d\U0001f600", "x" * 20000 + "\\" * 999, "$1 \\$1"]
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "a: b\\", "</turn>"]), draw.choice(said), 1, "x") for c in range(30) for t in range(draw.randrange(1, 9))]
    rows += [(3, 0, "assistant", "tie", 1, "x"), (3, 0, "assistant", "tie", 1, "x"), (None, 0, "user", "no id", 1, "x"), (None, None, "assistant", "no turn", 1, "x")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    found = same_as_sql(reply_trees.op12_reply_trees(df), reply_trees.SQL, conversations=df)
    assert (-7, 2) in {r[:2] for r in found} and sum(r[1] for r in found) == len(rows) + 2


def test_given_conversations(spark):
    df = table(spark, SF, "conversations")
    same_as_sql(reply_trees.op12_reply_trees(df), reply_trees.SQL, conversations=df)
    none = reply_trees.op12_reply_trees(df.limit(0)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in none] == [(-7, 2, 26)]


def test_no_python_on_the_main_path(spark):
    plan = reply_trees.op12_reply_trees(table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- fill in the middle -----------------------------------------------------------------------------------------------


def brute_fim(key, text):
    text, units = text or "", re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text or "")
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "a", " a", "a ", "a  b\tc\n", "<P>", "x<S> y", "<P", "P>", "<<P>", "<P >", "<S>", "< M>", "\u4e2d\u6587 \U0001f600 x", "\u00a0 \u2003", "a\x1cb \x85 c", "\x00 \x0b\x0c", "w " * 5000, "\u00e9" * 3000, " " * 3000]


def fim_rows(df):
    return {(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in byte_fim.fim_transform(df).collect()}


def test_transformed_texts_equal_brute_force(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 12)] + [(None, "no key here", "en", "s", 0), (-5, "a b c d", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert fim_rows(df) == {(r[0], *brute_fim(r[0], r[1])) for r in rows}
    assert {r[2] for r in fim_rows(df)} == {"plain", "psm", "spm"}
    back = byte_fim.op13_byte_fim(df).collect()
    assert {(r["doc_id"], r["restored_sha256"]) for r in back} == {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows}
    same_as_sql(byte_fim.op13_byte_fim(df), byte_fim.SQL, documents=df)


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    found = same_as_sql(byte_fim.op13_byte_fim(docs), byte_fim.SQL, documents=docs)
    assert len({r[0] for r in found}) == docs.count()


def one_by_one(symbols):
    state, out = byte_fim.FRESH, []
    for s in symbols:
        entry = int(byte_fim.TRANSITIONS[state * 7 + s])
        state = entry & 7
        out.append(entry >> 3)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=200), st.integers(1, 40))
def test_lanes_equal_one_scan(symbols, lanes):
    assert byte_fim.scan(np.array(symbols, np.uint8), lanes).tolist() == one_by_one(symbols)


def test_any_slices_of_a_batch(spark):
    """Sliced and empty arrays keep their own offsets."""
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    batch = pa.record_batch({"__gm_key": [r[0] for r in rows], "__gm_text": pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary()), **{f"__gm_h{i}": pa.array([i * 7] * len(rows), pa.int64()) for i in range(1, 5)}})
    whole = byte_fim._transform(batch, 100, 50).to_pylist()
    parts = [r for start in range(0, len(rows), 3) for r in byte_fim._transform(batch.slice(start, 3), 100, 50).to_pylist()]
    assert parts == whole and byte_fim._transform(batch.slice(0, 0), 100, 50).num_rows == 0


def test_fim_edges(spark):
    assert byte_fim.op13_byte_fim(spark.createDataFrame([], DOCS)).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, form string, n int")
    assert {r[2] for r in fim_rows(clash)} <= {"plain", "psm", "spm"}
    names = spark.createDataFrame([("k", "a b c " * 9)], "doc_id string, text string")
    assert {(r[0], *r[1:]) for r in fim_rows(names)} == {("k", *brute_fim("k", "a b c " * 9))}
