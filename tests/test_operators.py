"""Operators on literal rows: dialects, rules, schedules, layout."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import hashed_lines, numeric
from glyphmill.functions import text as t
from glyphmill.operators import alignment, constraints, histograms, layout, planning, samples, scoring, similarity
from glyphmill.plans import generation
from glyphmill.sources import files

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pairs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id long, pred string, gt string")


def test_rates(spark):
    rows = {r["sample_id"]: r for r in scoring.score_rows(pairs(spark, ("ꀉꀊ", "ꀉꀉ"), ("", ""), ("ꀀ", "a"))).collect()}
    assert (rows[0]["dist"], rows[0]["ned"], rows[0]["yi_ned"]) == (1, 0.5, 0.5)
    assert (rows[1]["ned"], rows[1]["yi_ned"]) == (0.0, None)
    assert rows[2]["yi_ned"] is None and rows[2]["flag_gt_ascii_letter"]


def test_script_denominators_differ_by_dialect(spark):
    rows = pairs(spark, ("ꀀ", "ꀀ"), ("ꀀ", "a"))
    assert (scoring.metric_pack(scoring.score_rows(rows)).first()["yi_ned"], scoring.metric_pack(scoring.score_rows(rows)).first()["yi_rows"]) == (0.0, 1)
    assert scoring.overall(scoring.score_strict(rows)).first()["yi_mean_sample_ned"] == 0.5


def test_empty_groups(spark):
    none = pairs(spark).filter("false") if False else spark.createDataFrame([], "sample_id long, pred string, gt string")
    assert scoring.metric_pack(scoring.score_rows(none)).first()["ned"] is None
    assert scoring.mean_ned(none).first()["mean_ned"] == 0.0
    assert scoring.summarize(scoring.score_strict(none)).first()["cer"] is None


def test_slices(spark):
    assert one(spark, t.keep(F.lit("ꀀ꒐"), t.YI_BLOCK)) == "ꀀ꒐"
    assert one(spark, t.keep(F.lit("ꀀ꒐"), t.YI_SYLLABLES)) == "ꀀ"
    assert one(spark, t.keep(F.lit("a漢b"), t.HAN)) == "漢"
    assert one(spark, t.keep_digits(F.lit("1²①⑩五５"))) == "1²①５"
    assert one(spark, t.strip_ws(F.lit("a 　\u001c​b"))) == "a​b"


def test_digits_agree_with_python(spark):
    chars = [chr(c) for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", t.keep_digits(F.col("c")).alias("k")).collect()
    assert [r["c"] for r in rows if (r["k"] == r["c"]) != r["c"].isdigit()] == []


@pytest.mark.parametrize("text", ["", "a\nb\n", "a", "a\n\n", "\n", "a\r\nb", "a\x0bb c", "a\x85"])
def test_line_count(spark, text):
    assert one(spark, t.line_count(F.lit(text))) == len(text.splitlines())


def test_normal_forms(spark):
    raw = "é ﬁ１"
    assert one(spark, t.nfc_ws(F.lit(raw))) == unicodedata.normalize("NFC", raw).replace(" ", "")
    assert one(spark, t.nfkc_ws(F.lit(raw))) == unicodedata.normalize("NFKC", raw).replace(" ", "")


def test_normal_forms_of_many_texts(spark):
    """Texts are held a few at a time, nulls stay."""
    texts = [None if i % 50 == 7 else "e\u0301" * (i % 5) + f"\ufb01{i}" for i in range(3 * t.AT_ONCE + 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1).select("i", t.nfkc_ws(F.col("x")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: x if x is None else unicodedata.normalize("NFKC", x) for i, x in enumerate(texts)}


@pytest.mark.parametrize(("n", "expected"), [(119, False), (120, True)])
def test_long_prediction(spark, n, expected):
    assert one(spark, t.is_long(F.lit("x" * n), F.lit("y" * 10))) is expected
    assert one(spark, t.is_long(F.lit("�" * 20), F.lit("y" * 100)))


def test_flags_and_formatting(spark):
    row = scoring.details(scoring.score_rows(pairs(spark, ("a\\frac\n", "ꀀ"))), "sample_id").first()
    assert row["flags"] == "latex,ascii_letter,extra_ascii_letter,ascii_any"
    assert row["han_ned"] == "" and row["ned"] == "1.000000"
    assert one(spark, t.six_decimals(F.lit(0.6640625))) == "0.664062"


#: Lengths whose rates have seven decimals, the last one a five: the doubles lie beside the ties.
BESIDE_TIES = [(d, n) for n in (320, 640, 1280, 1600, 3200) for d in range(1, n, 14)]


def test_six_decimals_follow_the_binary_value(spark):
    rows = spark.createDataFrame([(d / n,) for d, n in BESIDE_TIES] + [(0.5**7,), (3 * 0.5**7,), (1234567.5,)], "x double")
    assert [r["s"] for r in rows.select(t.six_decimals(F.col("x")).alias("s")).collect()] == [f"{r['x']:.6f}" for r in rows.collect()]


def test_danger_rows_follow_the_binary_value(spark):
    rows = scoring.score_rows(pairs(spark, *(("\\frac" + "x" * (n - d - 5) + "y" * d, "\\frac" + "x" * (n - 5)) for d, n in BESIDE_TIES[::9])))
    assert {(r["dist"], r["gt_len"]): r["ned"] for r in scoring.danger_rows(rows, "sample_id").collect()} == {(d, n): f"{d / n:.6f}" for d, n in BESIDE_TIES[::9]}


def test_details_follow_the_binary_value(spark):
    rows = scoring.score_rows(pairs(spark, *(("x" * (n - d) + "y" * d, "x" * n) for d, n in BESIDE_TIES[4::9])))
    found = scoring.details(rows, "sample_id").collect()
    assert {(r["dist"], r["gt_len"]): (r["ned"], r["ws_ned"]) for r in found} == {(d, n): (f"{d / n:.6f}",) * 2 for d, n in BESIDE_TIES[4::9]}


def test_assistant_texts(spark):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", "x"), ("assistant", "y")], None), ([], None), ([("user", "q")], "label")], "messages array<struct<role:string,content:string>>, label string")
    assert [r[0] for r in rows.select(alignment.assistant_text(F.col("messages"), F.col("label"))).collect()] == ["y", "", "label"]
    with pytest.raises(Exception, match="exactly one assistant"):
        rows.select(alignment.assistant_text_strict(F.col("messages"))).collect()


def test_prediction_fields(spark):
    rows = spark.createDataFrame([(None, "a", (None, "f" * 64)), ("p", "a", ("e" * 64, "f" * 64))], "prediction string, answer string, meta struct<image_sha256:string,inference_image_sha256:string>")
    assert [r[0] for r in rows.select(alignment.prediction_text(rows)).collect()] == ["a", "p"]
    assert [r[0][0] for r in rows.select(alignment.prediction_digest(rows)).collect()] == ["f", "e"]


def test_last_wins_and_strict_alignment(spark):
    results = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("z", 3, "extra")], "id string, pos int, answer string")
    annotations = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r["id"], r["answer"]) for r in alignment.align(annotations, results, "id", "pos").collect()} == {("a", "new"), ("b", None)}
    assert [r["id"] for r in alignment.missing(annotations, results, "id").collect()] == ["b"]
    with pytest.raises(Exception, match="duplicate key|missing or extra"):
        alignment.align_strict(annotations, results, "id").collect()


def test_upsert_and_suffix(spark):
    names = spark.createDataFrame([("it", "B"), ("itx", "A"), ("x", "C")], "name string, value string")
    assert [tuple(r) for r in alignment.suffix_pairs(names, "name", "value", "x").collect()] == [("A", "B", "suffix")]
    base = spark.createDataFrame([("A", "B", "tone_arc")], "a string, b string, source string")
    new = spark.createDataFrame([("A", "B", "cluster_multifont", 0.5), ("A", "C", "cluster_multifont", 0.4)], "a string, b string, source string, score double")
    merged = {tuple(r) for r in alignment.upsert(base, new, ["a", "b"], ["score"]).collect()}
    assert merged == {("A", "B", "tone_arc", "cluster_multifont", 0.5), ("A", "C", "cluster_multifont", None, 0.4)}


def test_breakdown_keeps_empty_groups(spark):
    rows = scoring.score_strict(pairs(spark, ("a", "a"))).withColumn("scene", F.lit("x"))
    domain = spark.createDataFrame([(0, "y", "Y"), (1, "x", "X")], "ord int, key string, label string")
    assert [(r["key"], r["samples"], r["cer"]) for r in scoring.breakdown(rows, "scene", domain).collect()] == [("y", 0, None), ("x", 1, 0.0)]


def test_constraints(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "id string")
    assert {(r["key"], r["n"]) for r in constraints.duplicates(ids, "id").collect()} == {("a", 2), ("", 1), (None, 1)}
    text = spark.createDataFrame([(1, "abc"), (2, "a#b~")], "id int, text string")
    assert [tuple(r) for r in constraints.unexpected_characters(text, "id", "text", "abc").collect()] == [(2, "#~")]
    paths = spark.createDataFrame([(1, ["images/a"]), (2, ["/x"]), (3, ["images/../b"]), (4, []), (5, ["images/a"])], "id int, images array<string>")
    assert {(r["id"], r["violation"]) for r in constraints.unsafe_paths(paths, "id", "images").collect()} == {(1, "duplicate path"), (5, "duplicate path"), (2, "unsafe path"), (3, "unsafe path"), (4, "unsafe path")}
    policy = spark.createDataFrame([("a", 0.25), ("b", 0.8)], "class_key string, strength double")
    assert constraints.policy_violations(policy, 2).count() == 0 and constraints.policy_violations(policy, 7).count() == 1


@QUICK
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6).filter(any), st.integers(1, 500))
def test_quotas(spark, weights, total):
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "ord int, weight double")
    rows = numeric.largest_remainder(table, total).collect()
    assert sum(r["quota"] for r in rows) == total
    assert all(abs(r["quota"] - r["weight"] / sum(weights) * total) < 1 + 1e-9 for r in rows)


def test_quota_ties_go_by_order(spark):
    rows = numeric.largest_remainder(planning.weights_table(spark, planning.TEMPLATE_WEIGHTS), 7).orderBy("ord").collect()
    assert [r["quota"] for r in rows] == [4, 1, 1, 1]


def test_permutation_is_a_bijection(spark):
    rows = planning.permuted(spark.range(50), 7, "id").collect()
    assert sorted(r["place"] for r in rows) == list(range(1, 51))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] != list(range(50))


def test_schedules(spark):
    page0 = planning.context_schedule(spark.range(1).withColumnRenamed("id", "page"), "page", 2162).orderBy("slot").collect()
    assert [r["pair"] for r in page0] == [271 * i for i in range(8)]
    every = planning.context_schedule(spark.range(2162).withColumnRenamed("id", "page"), "page", 2162).groupBy("slot").agg(F.count_distinct("pair").alias("n")).collect()
    assert {r["n"] for r in every} == {2162}
    markers = planning.circled_schedule(spark, 20).collect()
    assert set(Counter(r["marker"] for r in markers).values()) == {20} and len(markers) == 400
    fonts = Counter((r["marker"], r["font"]) for r in markers)
    assert sorted(fonts[("①", f)] for f in range(3)) == [6, 7, 7] and fonts[("①", 0)] == 6
    assert planning.circled_schedule(spark, 0).count() == 0


def test_injection(spark):
    lines = spark.createDataFrame([(i, "line", "abcd") for i in range(30)] + [(99, "page", "abcd")], "line_id long, granularity string, text string")
    bank = spark.createDataFrame([(0, "X", "Y"), (1, "Z", "W")], "pair long, a string, b string")
    rows = planning.inject_pairs(lines, bank, "a-z", 6, 3, 1).collect()
    assert Counter((r["pair"], r["font"]) for r in rows) == {(p, f): 2 for p in (0, 1) for f in range(3)}
    for r in rows:
        chars = r["text"][r["position"] : r["position"] + 2]
        assert set(chars) == ({"X", "Y"} if r["pair"] == 0 else {"Z", "W"}) and len(r["text"]) == 4
        assert (chars[0] in "YW") == r["swapped"]


def test_complex_pages_get_their_share(spark):
    rows = [(i, i, 0, "line", "line_anchor", "abcd") for i in range(20)]
    rows += [(100 + 10 * p + i, 100 + p, i, "page", family, "abcd" if i else "a1") for p, family in enumerate(["two_column_flow"] * 3 + ["single_column_anchor"]) for i in range(4)]
    lines = spark.createDataFrame(rows, "line_id long, row_id long, line_index int, granularity string, layout_family string, text string")
    bank = spark.createDataFrame([(0, "X", "Y"), (1, "Z", "W")], "pair long, a string, b string")
    lanes = planning.injection_lanes(lines, "a-z")
    assert Counter(r["lane"] for r in lanes.collect()) == {"anchor": 20, "single_page": 3, "complex_page": 3}
    assert {r["line_index"] for r in lanes.filter("lane = 'complex_page'").collect()} == {1}
    made = planning.inject_pairs(lines, bank, "a-z", 6, 3, 1, 0.25)
    assert Counter(r["lane"] for r in made.collect()) == {"anchor": 9, "complex_page": 3}
    assert tuple(planning.injection_counters(lanes, made, 12).first()) == (26, 12, 12, 3, 1)
    few = lines.filter("line_id < 8 or granularity = 'page'")
    assert Counter(r["lane"] for r in planning.inject_pairs(few, bank, "a-z", 6, 3, 1, 0.25).collect()) == {"anchor": 6, "complex_page": 2}


def test_latin_plan_covers_the_alphabet(spark):
    rows = planning.latin_plan(spark, 100, 3).collect()
    assert "".join(sorted(r["lower_anchor"] for r in rows if r["lower_anchor"])) == "abcdefghijklmnopqrstuvwxyz"
    assert "".join(sorted("".join(r["upper_anchors"] or "" for r in rows))) == "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert Counter(r["template"] for r in rows)["general_word_shape"] == 65


def test_context_lines(spark):
    bank = spark.range(2162).select(F.col("id").alias("pair"), F.lit("a").alias("a"), F.lit("b").alias("b"))
    schedule = planning.context_schedule(spark.range(3).withColumnRenamed("id", "page"), "page", 2162)
    for r in planning.context_lines(schedule, bank, "abcdef", 5).collect():
        p = r["target_position"]
        assert 12 <= len(r["a_text"]) <= 20 and 4 <= p < len(r["a_text"]) - 4
        assert r["a_text"][:p] == r["b_text"][:p] and r["a_text"][p + 1 :] == r["b_text"][p + 1 :] and (r["a_text"][p], r["b_text"][p]) == ("a", "b")


def test_degradation_plan_keeps_the_contract(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 == 0, "clear_print").when(F.col("id") % 2 == 0, "heavy").otherwise("light").alias("profile"))
    policy = spark.createDataFrame([("light|blur -> tone_sensor|none", 0.8)], "class_key string, strength double")
    plan = planning.degradation_plan(rows, "id", "profile", policy, 4)
    core = plan.select("id", F.lit("line").alias("granularity"), F.lit("x\n").alias("target"), F.lit(1).alias("blocks"), "profile", "operations", "ink_mode", "applied", "strength")
    assert constraints.core_row_violations(core, policy.withColumnRenamed("strength", "expected")).count() == 0
    assert plan.filter("applied").count() > 0


def test_visual_rows_use_the_anchor(spark):
    blocks = spark.createDataFrame([(1, i, x, y, 20) for i, (x, y) in enumerate([(0, 0), (1, 6), (2, 12)])], "page long, id long, x int, y int, h int")
    assert [r["line"] for r in layout.visual_rows(blocks, "page").orderBy("id").collect()] == [0, 0, 1]
    offsets = layout.char_offsets(layout.visual_rows(blocks, "page"), "page", F.lit(3)).orderBy("id").collect()
    assert [(r["char_start"], r["char_end"]) for r in offsets] == [(0, 3), (3, 6), (0, 3)]
    assert layout.canvas_heights(blocks, "page", 10).first()["canvas_height"] == 640


def greedy_cover(edges, remaining):
    """The rule itself, one edge after the other."""
    left, out = set(remaining), []
    while left:
        best = min(edges, key=lambda e: (-len({e[0], e[1]} & left), -e[2], -e[3], e[0], e[1]))
        assert {best[0], best[1]} & left
        out.append(best)
        left -= {best[0], best[1]}
    return out


@settings(QUICK, max_examples=4)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(2, 3), st.integers(0, 3)), min_size=1, max_size=25), st.integers(0, 3))
def test_coverage_floor_is_the_sequential_greedy_cover(spark, drawn, n_accepted):
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), s, m / 4) for a, b, s, m in drawn if a != b}.values())
    if not edges:
        return
    stable = spark.createDataFrame(edges, "i long, j long, font_support long, median_similarity double")
    accepted = spark.createDataFrame([(e[1], e[0]) for e in edges[:n_accepted]], "a long, b long")
    open_ = {v for e in edges for v in e[:2]} - {v for e in edges[:n_accepted] for v in e[:2]}
    assert sorted(tuple(r) for r in similarity.coverage_floor(stable, accepted).collect()) == sorted(greedy_cover(edges, open_))


@pytest.mark.parametrize("block", [3, 4096])
def test_blocks_change_no_neighbour(spark, block):
    rows = spark.createDataFrame([(i % 2, 0, i, [float((i * k) % 7) + 0.1 * k for k in range(1, 6)]) for i in range(24)], "font int, view int, i long, feature array<double>")
    near = {tuple(r)[:4] + (r["rank"],) for r in similarity.neighbours(rows, 3, block).collect()}
    assert near == {tuple(r)[:4] + (r["rank"],) for r in similarity.neighbours(rows, 3).collect()}
    pairs = rows.filter("font = 0").select(F.col("i"), (F.col("i") + 2).alias("j")).filter("j < 24")
    got = {(r["i"], r["j"]): r["mutual_rank"] for r in similarity.pair_evidence(rows, pairs, block, 4).collect()}
    every = {(r["i"], r["j"]): r["rank"] for r in similarity.neighbours(rows, 24).collect()}
    assert got == {k: max(every[k], every[k[::-1]]) for k in got} and len(got) == 11


def test_large_pages_and_percentiles(spark):
    blocks = spark.createDataFrame([(1, i, 0, 10 * i, 5) for i in range(3000)], "page long, id long, x int, y int, h int")
    assert [r["line"] for r in layout.visual_rows(blocks, "page").orderBy("id").collect()] == list(range(3000))
    values = [float((i * 7919) % 10007) ** 1.5 for i in range(12_000)] + [None, 5.0, 5.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    got = histograms.percentiles(rows, "v", [0.0, 0.25, 0.5, 1.0]).first()
    want = rows.agg(*(F.percentile("v", s) for s in (0.0, 0.25, 0.5, 1.0))).first()
    assert list(got) == pytest.approx(list(want)) and got[0] == known[0]
    assert histograms.percentiles(rows.filter("v is null"), "v", [0.5]).first()[0] is None


def test_neighbours_break_ties_by_id(spark):
    rows = spark.createDataFrame([(0, 0, i, [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i in range(5)], "font int, view int, i long, feature array<double>")
    near = {(r["i"], r["rank"]): r["j"] for r in similarity.neighbours(rows, 2).collect()}
    assert (near[(0, 1)], near[(0, 2)], near[(2, 1)], near[(4, 1)], near[(4, 2)]) == (1, 2, 0, 3, 0)


def test_histograms(spark):
    rows = spark.createDataFrame([("a", ["x", None]), ("b", ["x"])], "k string, v array<string>")
    assert {tuple(r) for r in histograms.nested(rows, {"v": F.col("v")}).collect()} == {("v", "x", 2)}
    assert {tuple(r) for r in histograms.events_by(rows, "k", F.when(F.col("k") == "a", F.col("v"))).collect()} == {("a", 2), ("b", 0)}
    domain = spark.createDataFrame([("a",), ("z",)], "symbol string")
    assert {tuple(r) for r in histograms.zero_filled(rows, "k", domain).collect()} == {("a", 1), ("z", 0)}
    counted = histograms.counters(rows, {"k": F.col("k"), "size": F.when(F.col("k") == "a", "s")}, {"size": F.size("v")})
    assert {tuple(r) for r in counted.collect()} == {("k", "a", 1), ("k", "b", 1), ("size", "s", 2)}


def test_files(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a"}\n\n{"id": "b"}\n')
    bad.write_text('{"id": "a"}\n[1]\n')
    assert files.read_json_lines(spark, str(good), "id string").count() == 2
    assert {r["id"] for r in files.read_json_lines_strict(spark, str(good), "id string").collect()} == {"a", "b"}
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_json_lines_strict(spark, str(bad), "id string").collect()
    csv = tmp_path / "d.csv"
    csv.write_text("﻿char,romanization\nꀀ,it\n,none\n")
    assert [tuple(r) for r in files.read_dimension(spark, str(csv), "char").collect()] == [("ꀀ", "it")]
    names = tmp_path / "names.txt"
    names.write_text(" a \n\nb\n")
    assert {r["value"] for r in files.read_list(spark, str(names)).collect()} == {"a", "b"}


def test_publish_is_whole_or_absent(spark, tmp_path):
    target = str(tmp_path / "out")
    made = files.publish(spark, {"rows": spark.range(3)}, target, {"name": "n"})
    assert made["outputs"]["rows"]["rows"] == 3 and (tmp_path / "out" / "manifest.json").exists()
    with pytest.raises(FileExistsError):
        files.publish(spark, {"rows": spark.range(3)}, target)
    with pytest.raises(Exception):  # noqa: B017
        files.publish(spark, {"rows": spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.staging").exists()


def test_reports(spark):
    rows = spark.createDataFrame([("<a>", 1)], "name string, n int")
    assert "&lt;a&gt;" in files.review_page(rows, ["name", "n"], "t", 5)
    assert "- n: 1" in files.summary_markdown({"n": 1}, "t") and "<svg" in files.bar_chart({"a": 0.5}, "t")
    assert files.canonical_lines(rows).first()["value"] == '{"n":1,"name":"<a>"}'


def test_vectors(spark):
    assert one(spark, numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, numeric.blend(F.array(F.lit(10.0)), F.array(F.lit(20.0)), F.lit(0.25))) == [12.5]
    assert one(spark, numeric.fit_scale(F.lit(4800), F.lit(100), 2400)) == 0.5


def test_reports_by_group_equal_the_single_ones(spark):
    rows = [("a", i, f"<n{i}>", 1.0 * i) for i in range(7)] + [("b", 9, "x\"y", 0.25)]
    df = spark.createDataFrame(rows, "g string, i int, name string, v double")
    digests = {r["g"]: r["digest"] for r in files.bank_digests(df.select("g", "i", "name"), "g", ["i"]).collect()}
    pages = {r["g"]: r["html"] for r in files.review_pages(df, "g", ["i", "name"], ["i"], 3).collect()}
    charts = {r["g"]: r["svg"] for r in files.bar_charts(df.filter("g = 'b'"), "g", "name", "v").collect()}
    for g in "ab":
        own = df.filter(F.col("g") == g)
        assert digests[g] == files.pair_bank_digest(own.select("i", "name"), ["i"])
        assert pages[g] == files.review_page(own.orderBy("i"), ["i", "name"], g, 3)
    assert charts["b"] == files.bar_chart({"x&quot;y": 0.25}, "b")


def test_gates_of_many_builds(spark):
    allowed = {"phase": "formal_build_authorized", "formal_build": True, "training": False, "spec_sha256": "ab"}
    cases = [
        ({"build_id": "v1", "train_n": 5, "dev_n": 1, "workers": 2, "ratio_yi": 1.0, "symbol_rate": 0.5}, allowed),
        ({"build_id": "-Draft", "train_n": 0, "dev_n": 1, "workers": 64, "ratio_yi": -1.0, "symbol_rate": 2.0}, allowed | {"training": True}),
        ({"build_id": "a\n", "train_n": 1, "dev_n": 0, "ratio_mixed": 0.1, "heavy_degrade": 1.5}, None),
        ({"build_id": "", "train_n": 1, "dev_n": 1, "workers": 0}, allowed | {"phase": "no", "spec_sha256": "x"}),
    ]
    names = ("train_n", "dev_n", "workers", "ratio_yi", "ratio_mixed", "ratio_common", "mixed_yi_frac", "symbol_rate", "heavy_degrade")
    schema = "k int, build_id string, " + ", ".join(f"{n} double" for n in names) + ", authorization struct<phase:string,formal_build:boolean,training:boolean,spec_sha256:string>"
    rows = [(i, a["build_id"], *(float(a[n]) if n in a else None for n in names), d) for i, (a, d) in enumerate(cases)]
    found = {r["k"]: r["errors"] for r in constraints.build_problems(spark.createDataFrame(rows, schema), "k", ("draft",), "ab").collect()}
    assert found == {i: constraints.argument_errors(a, ("draft",)) + constraints.authorization_errors(d, "ab") for i, (a, d) in enumerate(cases)}


def _clustered(n, seed):
    import numpy as np

    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 8))
    v = centres[draw.integers(0, 12, n)] + 0.02 * draw.normal(size=(n, 8))
    v[::37] = 0.0  # vectors without a direction
    v[5:9] = v[4]  # equal ones
    return v


@pytest.mark.parametrize("block", [16, 50])
def test_cells_lose_no_neighbour(spark, block):
    import numpy as np

    v = _clustered(300, block)
    rows = spark.createDataFrame([(i % 2, 0, i, x.tolist()) for i, x in enumerate(v)], "font int, view int, i long, feature array<double>")
    near = {}
    for r in similarity.neighbours(rows, 4, block).collect():
        near[r["i"], r["rank"]] = (r["j"], r["sim"])
    size = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(size > 0, size, 1)
    for i in range(len(v)):
        same = [j for j in range(i % 2, len(v), 2) if j != i]
        best = sorted(((-float(unit[i] @ unit[j])), j) for j in same)[:4]
        assert [near[i, n][1] for n in range(1, 5)] == pytest.approx([-s for s, _ in best], abs=1e-9)
    pairs = rows.select("i", (F.col("i") + 2).alias("j")).filter("j < 300")
    got = {(r["font"], r["i"], r["j"]): r["mutual_rank"] for r in similarity.pair_evidence(rows, pairs, block, 64).collect()}
    one = {(r["font"], r["i"], r["j"]): r["mutual_rank"] for r in similarity.pair_evidence(rows, pairs, 4096, 64).collect()}
    assert got == one and len(got) == 298


def test_cells_prune_clusters(spark):
    """On tight clusters a vector asks in few cells; on scattered vectors in all that hold any."""
    import numpy as np

    for v, most in ((_clustered(600, 1), 0.35), (np.random.default_rng(2).normal(size=(600, 8)), 1.0)):
        rows = spark.createDataFrame([(0, 0, i, x.tolist()) for i, x in enumerate(v)], "font int, view int, i long, feature array<double>")
        dealt, known = similarity.in_cells(rows, 30)
        assert not known.single and dealt.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 80
        near = similarity.neighbours(rows, 4, 30).filter("rank = 4").select("i", "sim").toPandas().sort_values("i")
        unit = similarity._unit_rows(v)
        need = known.near((0, 0), unit, similarity._bounds(near["sim"].to_numpy(), unit))
        some = (unit * unit).sum(1) > 0
        assert need[some].sum() / (some.sum() * (known.of[0, 0][2] > 0).sum()) <= most


def test_ranks_of_awkward_values(spark):
    import math

    values = [1e308, -1e308, 0.0, 5e-324, 1e-323, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), math.nan, None, 1.0, 1.0, -1.5, 2**53 + 2.0, 7.0]
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert histograms.ranked_values(rows, "v", range(len(known))) == dict(enumerate(known))
    assert histograms.percentiles(rows, "v", [1.0]).first()[0] == 1e308


def test_ranks_with_a_frequent_key(spark):
    rows = spark.createDataFrame([(i if i % 3 else 7, i) for i in range(600)], "k long, v long").repartition(7)
    found = alignment.numbered(rows, "k").orderBy("_n").collect()
    assert [r["_n"] for r in found] == list(range(600)) and [r["k"] for r in found] == sorted(r["k"] for r in found)
    assert found == alignment.numbered(rows.repartition(3), "k").orderBy("_n").collect()


@pytest.mark.parametrize("size", [3, 200])
def test_zero_filled_domains(spark, size):
    symbols = [chr(0x4E00 + i) for i in range(size - 2)] + ["]", "\\"]
    texts = ["".join(symbols[(i * k) % size] for k in range(30)) + "^-z" for i in range(20)] + ["", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    found = {r["symbol"]: r["n"] for r in histograms.zero_filled(rows, "t", spark.createDataFrame([(s,) for s in [*symbols, "absent"[:1]]], "symbol string")).collect()}
    assert found == {s: sum((x or "").count(s) for x in texts) for s in [*symbols, "a"]}


def test_pair_bank_merges_in_order(spark):
    suffixed = spark.createDataFrame([("c", "d", "bax"), ("a", "b", "abx"), ("a", "b", "zzx")], "a string, b string, name string")
    found = [("a", "b", "cluster_multifont", 3, 2.0, 0.5), ("e", "f", "cluster_font_specific", 1, 1.0, 0.9), ("a", "e", "cluster_multifont", 2, 9.0, 0.4), ("a", "d", "cluster_multifont", 3, 9.0, 0.4)]
    candidates = spark.createDataFrame(found, "a string, b string, source string, font_support long, median_mutual_rank double, score double")
    rows = similarity.pair_bank(suffixed, candidates).orderBy("position").collect()
    assert [(r["position"], r["a"], r["b"], r["source"], r["cluster_source"], r["font_support"]) for r in rows] == [
        (0, "a", "b", "tone_arc", "cluster_multifont", 3), (1, "c", "d", "tone_arc", None, None), (2, "a", "d", "cluster_multifont", None, 3), (3, "a", "e", "cluster_multifont", None, 2), (4, "e", "f", "cluster_font_specific", None, 1),
    ]


def test_sample_rows_hold_lines_and_events(spark):
    rows = spark.createDataFrame([(1, "mixed", "page", 2), (2, "pure_yi", "line", 0)], "k long, script_class string, granularity string, eligible_lines long")
    lines = spark.createDataFrame([(1, 1, "b."), (1, 0, "a,"), (1, 2, None)], "k long, line_index int, text string")
    events = spark.createDataFrame([(1, 1, 0, "p", "xy", "f", "s", 1), (1, 0, 3, "q", "yx", "f", "s", 0)], f"k long, {', '.join(f'{c} int' if c in ('line_index', 'position', 'context_variant') else f'{c} string' for c in samples.EVENT)}")
    one, two = samples.sample_rows(rows, lines, events, "k", "dev", "Read.", ".,").orderBy("id").collect()
    assert (one["id"], one["images"]) == ("synth_dev_000001", ["images/dev/mixed/page/000001.png"])
    assert [(m["role"], m["content"]) for m in one["messages"]] == [("user", "Read."), ("assistant", "a,\nb.\n\n")]
    assert [e["positions"] for e in one["meta"]["confusable_events"]] == [[3, 4], [0, 1]] and one["meta"]["symbol_count"] == 2 and one["meta"]["forced_confusable_count"] == 2
    assert two["messages"][1]["content"] == "" and two["meta"]["confusable_events"] == [] and not two["meta"]["has_symbol"]


def test_asks_are_cells_not_copies_of_vectors():
    """Scattered vectors need every cell: what a batch asks for is a row for each cell, not a copy of each vector for each cell."""
    import numpy as np
    import pyarrow as pa

    v = np.random.default_rng(3).normal(size=(2000, 8))
    pivots = similarity._unit_rows(v[:40])
    known = similarity.Known({(0, 0): (pivots, np.append(np.full(40, 1.5), np.inf), np.append(np.full(40, 1), 0))}, {(0, 0): np.append(np.full(40, 50), 0)})
    zero = pa.array(np.zeros(len(v), np.int32))
    asked = pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.full(len(v), 0.3)), pa.array(v.tolist())], ["font", "view", "task", "bound", "feature"])
    assert sum(b.num_rows for b in similarity._wanting(known)([asked])) == 40


def test_copies_and_scattered_vectors_in_many_tasks(spark):
    """Equal vectors are ties to the last bit, whatever task compares them; rows equal brute force."""
    import numpy as np

    draw = np.random.default_rng(4)
    v = draw.normal(size=(700, 16))
    v[100:400:3] = v[50]
    v[::90] = 0.0
    rows = spark.createDataFrame([(0, 0, i, x.tolist()) for i, x in enumerate(v)], "font int, view int, i long, feature array<double>")
    found = {(r["i"], r["rank"]): r["j"] for r in similarity.neighbours(rows, 5, 16).collect()}
    unit = similarity._unit_rows(v)
    for i in range(len(v)):
        sim = np.einsum("d,nd->n", unit[i], unit)
        first = [j for j in np.lexsort((np.arange(len(v)), -np.round(sim, 12))) if j != i][:5]
        assert [found[i, n] for n in range(1, 6)] == first


def plain_line(kind, n, first, second, share, key):
    """A sampled line by its definition, character by character."""
    u = lambda *rest: int(hashlib.md5(":".join([key, *map(str, rest)]).encode()).hexdigest()[:13], 16) / 2**52
    one = lambda pool, x: pool[int(x * len(pool))] if pool else ""
    if kind in ("pure_yi", "pure_common"):
        return "".join(one(first if kind == "pure_yi" else second, u("c", i)) for i in range(1, (n or 0) + 1))
    width = 1 + int(u("width") * 4)
    return "".join(one(first, u("a", i)) if u("run", (i - 1) // width) < share else one(second, u("b", i)) for i in range(1, max(n or 0, 1) + 1))


@pytest.mark.parametrize(("first", "second", "key"), [("abcdefg", "天地人𠀀", "k"), ("ab", "", "k"), ("abc", "de", "a key of more than one block of the digest, " * 2)])
def test_sampled_lines_equal_their_hashes(spark, first, second, key):
    rows = [(i, kind, n) for i, (kind, n) in enumerate((k, n) for k in ("pure_yi", "pure_common", "mixed", None) for n in (None, -1, 0, 1, 4, 9, 10, 20, 120, 1100))]
    df = spark.createDataFrame(rows, "i int, kind string, n int")
    line = planning.sampled_line(F.col("kind"), F.col("n"), first, second, 0.65, 7, F.lit(key), F.col("i"))
    found = {r["i"]: r["line"] for r in df.select("i", line.alias("line")).collect()}
    assert found == {i: plain_line(kind, n, first, second, 0.65, f"7:{key}:{i}") for i, kind, n in rows}


def test_long_lines_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(hashed_lines, "CHARACTERS", 30)
    texts = hashed_lines.line_texts(["mixed", "pure_yi"] * 50, np.arange(100), [b"%d:" % i for i in range(100)], "abc", "de", 0.5)
    df = spark.range(0, 100, 1, 1).select(F.when(F.col("id") % 2 == 0, "mixed").otherwise("pure_yi").alias("kind"), F.col("id").cast("int").alias("n"))
    assert [r[0] for r in df.select(planning.sampled_line(F.col("kind"), F.col("n"), "abc", "de", 0.5, F.col("n"))).collect()] == texts


def test_lines_of_few_plan_rows_are_spread(spark, sf):
    """The rows of a plan are few bytes, which joins leave in few partitions; their lines are the work."""
    assert generation._customer_plan(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
