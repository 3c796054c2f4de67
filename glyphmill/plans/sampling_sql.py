"""SQL of the sampled plans. The hash that stands for chance is plain SQL too, so whole texts can be held against it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from glyphmill.operators import planning

LOWER = "abcdefghijklmnopqrstuvwxyz"


def _u(*keys: str) -> str:
    """A uniform number in [0, 1) from the keys' hash."""
    return f"(('0x' || left(md5(concat_ws(':', {', '.join(keys)})), 13))::BIGINT::DOUBLE / 4503599627370496)"


def _int(low: str | int, high: str | int, *keys: str) -> str:
    return f"({low} + floor({_u(*keys)} * ({high} - {low} + 1)))::INT"


def _one(pool: str, *keys: str) -> str:
    """One hashed element of a SQL list or text."""
    return f"{pool}[floor({_u(*keys)} * len({pool}))::INT + 1]"


def _picked(pool: str, length: str, *keys: str, i: str = "i") -> str:
    """`length` hashed characters of the pool; i names the place among the keys."""
    return f"array_to_string(list_transform(range(1, {length} + 1), lambda {i}: substr({pool}, floor({_u(*keys, i)} * length({pool}))::INT + 1, 1)), '')"


def _choice(values: Sequence[str], shares: Sequence[float], u: str) -> str:
    whens = " ".join(f"WHEN {u} < {sum(shares[: i + 1])!r}::DOUBLE THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"(CASE {whens} ELSE '{values[-1]}' END)"


def _splice(text: str, place: str, piece: str, replaced: int = 0) -> str:
    return f"(left({text}, {place}) || {piece} || substr({text}, {place} + {replaced + 1}))"


def _weights(weights: Mapping[str, float]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{k}', {w!r}::DOUBLE)" for i, (k, w) in enumerate(weights.items())) + ") w(ord, value, weight)"


def _quotas(source: str, total: str, within: str = "") -> str:
    """The rows of source (ord, weight and more) with their quota by largest remainder."""
    by = f"PARTITION BY {within}" if within else ""
    return f"""(SELECT * EXCLUDE (share, rank, spare), (floor(share) + (rank <= spare)::INT)::BIGINT AS quota FROM
  (SELECT *, row_number() OVER ({by} ORDER BY share - floor(share) DESC, ord) AS rank, {total} - sum(floor(share)) OVER ({by}) AS spare FROM
    (SELECT *, weight / sum(weight) OVER ({by}) * {total} AS share FROM {source})))"""


def dealt(name: str, key: str, seed: int) -> str:
    """The table's keys with their place in the shuffled order."""
    return f"(SELECT {key}, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, {key})), {key}) AS place FROM {name})"


def _count(name: str) -> str:
    return f"(SELECT count(*) FROM {name})"


def exact_plan(name: str, key: str, seed: int) -> str:
    return f"SELECT {key}, value FROM {dealt(name, key, seed)} JOIN {_exact(planning.TEMPLATE_WEIGHTS, _count(name), seed)} USING (place)"


def context_schedule(seed: int) -> str:
    """CTE s: a page for each supplier, a pair for each part."""
    return f"s AS (SELECT p AS page, t::INT AS slot, (t // 2)::INT AS font, t % 2 AS c, (p + t * {planning.PAIR_STRIDE}) % {_count('part')} AS pair FROM (SELECT place - 1 AS p FROM {dealt('supplier', 's_suppkey', seed)}) CROSS JOIN range(8) y(t))"


def _exact(weights: Mapping[str, float], total: str, seed: int) -> str:
    return f"""(SELECT value, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, ord, copy)), ord, copy) AS place FROM (SELECT ord, value, unnest(range(1, quota + 1)) AS copy FROM {_quotas(_weights(weights), total)}))"""


def _plan(name: str, key: str, ratio: Mapping[str, float], seed: int) -> str:
    """CTE plan(plan_index, family, granularity, script_class, key): a row of the plan for each row of the table."""
    alone = ", ".join(f"'{f}'" for f in planning.MIXED_ONLY)
    return f"""families AS (SELECT ord AS family_ord, value AS family, quota AS total FROM {_quotas(_weights(planning.FAMILY_WEIGHTS), _count(name))}),
classes AS (SELECT families.*, ord, value AS script_class, weight FROM families, {_weights(ratio)} WHERE family NOT IN ({alone}) UNION ALL SELECT *, 0, 'mixed', 1.0::DOUBLE FROM families WHERE family IN ({alone})),
rows AS (SELECT row_number() OVER (ORDER BY family_ord, ord, copy) - 1 AS plan_index, family, CASE WHEN family = 'line_anchor' THEN 'line' WHEN family = 'region_anchor' THEN 'region' ELSE 'page' END AS granularity, script_class
  FROM (SELECT *, unnest(range(quota)) AS copy FROM {_quotas("classes", "total", "family")})),
plan AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, plan_index)), plan_index) AS place FROM rows) JOIN {dealt(name, key, seed)} USING (place))"""


def _lines(first: str, second: str, share: float, rate: float, seed: int) -> str:
    """CTE lines: plan with line_index and text."""
    k = (str(seed), "plan_index", "line_index")
    spans = "CASE granularity " + " ".join(f"WHEN '{g}' THEN [{a[0]}, {a[1]}, {b[0]}, {b[1]}]" for g, (a, b) in planning.GRANULARITY.items()) + " END"
    run = _u(*k, "'run'", "floor((i - 1) / width)::BIGINT")
    mixed = f"array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN {run} < {share}::DOUBLE THEN {_one(chr(39) + first + chr(39), *k, chr(39) + 'a' + chr(39), 'i')} ELSE {_one(chr(39) + second + chr(39), *k, chr(39) + 'b' + chr(39), 'i')} END), '')"
    m = (*k, "'mark'")
    quotes = "[" + ", ".join(f"['{a}', '{b}']" for a, b in planning.QUOTES) + "]"
    inline = "[" + ", ".join(f"'{x}'" for x in planning.INLINE) + "]"
    quote = _one(quotes, *m, "'quote'")
    return f"""spans AS (SELECT *, {spans} AS s FROM plan),
indexed AS (SELECT *, unnest(range({_int("s[1]", "s[2]", str(seed), "plan_index", "'lines'")})) AS line_index FROM spans),
sized AS (SELECT *, {_int("s[3]", "s[4]", str(seed), "plan_index", "'length'", "line_index")} AS n, {_int(1, 4, *k, "'width'")} AS width FROM indexed),
plain AS (SELECT *, CASE script_class WHEN 'pure_yi' THEN {_picked(f"'{first}'", "n", *k, "'c'")} WHEN 'pure_common' THEN {_picked(f"'{second}'", "n", *k, "'c'")} ELSE {mixed} END AS line FROM sized),
marked AS (SELECT *, CASE WHEN length(line) > 1 THEN {_int(1, "(length(line) - 1)", *m, "'at'")} ELSE length(line) END AS mark_at, {_choice(planning.DECORATIONS, planning.DECORATION_SHARES, _u(*m, "'kind'"))} AS kind FROM plain),
lines AS (SELECT * EXCLUDE (line), CASE WHEN line = '' OR {_u(*m, "'rate'")} >= {rate}::DOUBLE THEN line WHEN kind = 'pause' THEN {_splice("line", "mark_at", _choice(planning.PAUSE, planning.PAUSE_SHARES, _u(*m, "'pause'")))}
  WHEN kind = 'end' THEN line || {_choice(planning.END, planning.END_SHARES, _u(*m, "'end'"))} WHEN kind = 'quote' THEN {quote}[1] || line || {quote}[2] WHEN kind = 'inline' THEN {_splice("line", "mark_at", _one(inline, *m, "'inline'"))}
  ELSE {_splice("line", "mark_at", _picked("'0123456789'", _int(1, 3, *m, "'digits'"), *m, "'digit'"))} END AS text FROM marked)"""


def sample_plan(name: str, key: str, ratio: Mapping[str, float], seed: int) -> str:
    return f"""WITH {_plan(name, key, ratio, seed)}, tagged AS (SELECT *, (row_number() OVER (PARTITION BY granularity, family ORDER BY plan_index) - 1) % 5 = 0 AS clear FROM plan)
SELECT {key}, granularity, family, script_class, CASE WHEN clear THEN 'clear_print' ELSE 'standard' END AS profile FROM tagged"""


def sampled_lines(name: str, key: str, ratio: Mapping[str, float], first: str, second: str, share: float, rate: float, seed: int) -> str:
    return f"WITH {_plan(name, key, ratio, seed)}, {_lines(first, second, share, rate, seed)} SELECT {key}, plan_index, line_index::INT AS line_index, script_class, text FROM lines"


def page_layout(name: str, key: str, ratio: Mapping[str, float], first: str, second: str, share: float, rate: float, seed: int) -> str:
    """Geometry, blocks, rows anchored on their first block, texts from left to right."""
    names = list(planning.GEOMETRY)[:3]
    ranges = "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for pair in planning.GEOMETRY[p] for v in pair) + "]" for p in names) + f"][plan_index % {len(names)} + 1]"
    k = (str(seed), "plan_index")

    def ratio_of(low: int, name: str) -> str:
        return f"(g[{low}] + {_u(*k, name)} * (g[{low + 1}] - g[{low}]))"

    return f"""WITH RECURSIVE {_plan(name, key, ratio, seed)}, {_lines(first, second, share, rate, seed)},
drawn AS (SELECT *, {ranges} AS g FROM lines WHERE granularity = 'page'),
wide AS (SELECT *, {_int("g[1]::INT", "g[2]::INT", *k, "'width'")} AS canvas, {_int(27, 36, *k, "'size'")} AS base FROM drawn),
geometry AS (SELECT *, floor(canvas * {ratio_of(3, "'margin'")})::INT AS margin, floor(canvas * {ratio_of(5, "'gutter'")})::INT AS gutter, floor(base * (1.45::DOUBLE + 0.30::DOUBLE * {_u(*k, "'step'")}))::INT AS step,
  family IN ('two_column_flow', 'aligned_bilingual_rows', 'independent_spatial_columns') AS two FROM wide),
blocks AS (SELECT {key} AS page, line_index AS id, text, CASE WHEN two AND line_index % 2 = 1 THEN margin + trunc((canvas - 2 * margin - gutter) / 2)::INT + gutter ELSE margin END AS x,
  margin + CASE WHEN two THEN line_index // 2 ELSE line_index END * step + CASE WHEN family = 'independent_spatial_columns' AND line_index % 2 = 1 THEN step // 2 ELSE 0 END AS y, trunc(step * 0.7::DOUBLE)::INT AS h FROM geometry),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS rn FROM blocks),
f AS (SELECT page, id, x, text, rn, y AS ay, h AS ah, 0 AS line FROM o WHERE rn = 1
  UNION ALL SELECT page, id, x, text, rn, CASE WHEN s THEN ay ELSE y END, CASE WHEN s THEN ah ELSE h END, CASE WHEN s THEN line ELSE line + 1 END
  FROM (SELECT o.*, f.ay, f.ah, f.line, abs(o.y - f.ay) <= greatest(3, floor(least(f.ah, o.h) * 0.35::DOUBLE)) AS s FROM f JOIN o ON o.page = f.page AND o.rn = f.rn + 1))
SELECT page AS {key}, line, string_agg(text, '' ORDER BY x, id) AS text FROM f GROUP BY page, line"""


def _pair_events(chosen: str, seed: int) -> str:
    """CTE e: the chosen lines (CTE c with cursor and places) with the pair that is due and its place."""
    return f"""bank AS (SELECT pair, a, b, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, pair)), pair) - 1 AS ordered FROM (VALUES (0::BIGINT, 'A', 'B'), (1, 'C', 'D'), (2, 'E', 'F')) t(pair, a, b)), {chosen},
e AS (SELECT c.*, pair, a, b, (cursor % 6 % 3)::INT AS font, (cursor % 6 // 3)::INT AS context_variant, (pair + cursor % 6 % 3) % 2 = 1 AS swapped, {_one("places", str(seed), "line_id", "'place'")}::INT AS position FROM c JOIN bank ON ordered = cursor // 6)"""


_PLACES = "list_filter(range(0, greatest(length(p_name) - 1, 0)), lambda i: regexp_full_match(substr(p_name, i::INT + 1, 2), '[a-z]{2}')) AS places"
_EVENT = "cursor::INT AS cursor, pair, font, context_variant, swapped, position, " + _splice("text", "position", "(CASE WHEN swapped THEN b || a ELSE a || b END)", 2) + " AS text FROM e"


def inject_pairs(seed: int) -> str:
    chosen = f"""p AS (SELECT p_partkey AS line_id, p_name AS text, {_PLACES} FROM part WHERE p_partkey % 4 <> 0),
c AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, line_id)), line_id) - 1 AS cursor FROM p WHERE len(places) > 0)"""
    return f"WITH {_pair_events(chosen, seed)} SELECT line_id, {_EVENT}"


def _on_pages(seed: int) -> str:
    chosen = f"""p AS (SELECT p_partkey AS line_id, p_partkey // 5 AS row_id, p_partkey % 5 AS line_index, p_name AS text, CASE WHEN p_partkey // 5 % 4 <> 0 THEN 'anchor' WHEN p_partkey // 5 % 8 = 0 THEN 'single_page' ELSE 'complex_page' END AS lane, {_PLACES} FROM part),
lanes AS (SELECT * FROM p WHERE len(places) > 0 QUALIFY lane <> 'complex_page' OR row_number() OVER (PARTITION BY row_id, lane ORDER BY line_index) = 1),
n AS (SELECT least(18, count(*) FILTER (lane = 'anchor')) AS chosen, count(*) FILTER (lane = 'complex_page') AS pages FROM lanes), b AS (SELECT chosen, least(pages, round_even(chosen * 0.25::DOUBLE, 0)::BIGINT) AS on_pages FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY md5(concat_ws(':', {seed}, line_id)), line_id) AS rn FROM lanes),
c AS (SELECT r.*, CASE WHEN lane = 'anchor' THEN rn - 1 ELSE chosen - on_pages + rn - 1 END AS cursor FROM r, b WHERE (lane = 'anchor' AND rn <= chosen - on_pages) OR (lane = 'complex_page' AND rn <= on_pages))"""
    return f"WITH {_pair_events(chosen, seed)}"


def inject_pages(seed: int) -> str:
    return f"{_on_pages(seed)} SELECT line_id, lane, {_EVENT}"


def injection_counters(seed: int) -> str:
    return f"""{_on_pages(seed)} SELECT (SELECT count(*) FROM lanes) AS eligible_lines, 18::BIGINT AS target_occurrences, count(*) AS pair_occurrences, count(*) FILTER (lane = 'complex_page') AS complex_page_occurrences, (count(*) = 18)::INT AS full_target_reached FROM e"""


def inject_circled(seed: int) -> str:
    return f"""WITH s AS (SELECT chr(({planning.CIRCLED_FIRST} + m)::INT) AS marker, m, c FROM range({planning.CIRCLED_COUNT}) a(m) CROSS JOIN range(3) b(c)),
s2 AS (SELECT *, ['line_start', 'line_middle', 'line_end'][(m + c) % 3 + 1] AS position_kind, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, marker, c)), marker, c) AS place FROM s),
l AS (SELECT p_partkey AS line_id, p_name AS text, row_number() OVER (ORDER BY md5(concat_ws(':', {seed}, p_partkey)), p_partkey) AS place FROM part WHERE p_partkey % 3 <> 0 AND p_name <> ''),
e AS (SELECT *, CASE position_kind WHEN 'line_start' THEN 0 WHEN 'line_end' THEN length(text) ELSE CASE WHEN length(text) > 1 THEN {_int(1, "(length(text) - 1)", str(seed), "line_id", "'inside'")} ELSE length(text) END END::INT AS position FROM l JOIN s2 USING (place))
SELECT line_id, 'U+' || upper(to_hex({planning.CIRCLED_FIRST} + m)) AS codepoint, c::INT AS font, position_kind, position, {_splice("text", "position", "marker")} AS text FROM e"""


def context_lines(pool: str, seed: int) -> str:
    k = (str(seed), "pair", "slot")
    a, b = (f"substr('{pool}', (p_partkey + {step}) % {len(pool)} + 1, 1)" for step in (0, 1))
    return f"""WITH {context_schedule(seed)}, bank AS (SELECT place - 1 AS pair, {a} AS a, {b} AS b, replace(replace('{pool}', {a}, ''), {b}, '') AS clean FROM {dealt("part", "p_partkey", seed)}),
n AS (SELECT *, {_int(12, 20, *k, "'length'")} AS n FROM s JOIN bank USING (pair)), d AS (SELECT *, {_int(4, "(n - 5)", *k, "'place'")} AS target_position, {_picked("clean", "(n - 1)", *k, "'context'")} AS line FROM n)
SELECT page, slot, font, ['clear', 'mild_old_print'][c + 1] AS condition, pair, [20, 24, 28, 32][(pair + font + c) % 4 + 1]::INT AS font_size, a, b, target_position,
  {_splice("line", "target_position", "a")} AS a_text, {_splice("line", "target_position", "b")} AS b_text FROM d"""


def latin_plan(name: str, source: str, first: str, second: str, seed: int) -> str:
    total = _count(name)
    k = (str(seed), "place")
    capitals = f"CASE WHEN length(coalesce(upper_anchors, '')) > 0 THEN upper_anchors ELSE {_picked(f'{chr(39)}{LOWER.upper()}{chr(39)}', _int(2, 5, *k, chr(39) + 'caps' + chr(39)), *k, chr(39) + 'cap' + chr(39))} END"
    word = f"coalesce(lower_anchor, {_picked(f'{chr(39)}{LOWER}{chr(39)}', '1', *k, chr(39) + 'first' + chr(39))}) || {_picked(f'{chr(39)}{LOWER}{chr(39)}', _int(2, 8, *k, chr(39) + 'len' + chr(39)), *k, chr(39) + 'word' + chr(39))}"
    named = _picked(f"'{LOWER}'", _int(3, 9, *k, "'name'", "c"), *k, "'letters'", "c")
    names = f"array_to_string(list_transform(regexp_extract_all(capitals, '.'), lambda c: c || {named}), ' ')"
    year = f"'No.' || {_int(1, 499, *k, chr(39) + 'no' + chr(39))} || ' (' || {_int(1900, 2100, *k, chr(39) + 'year' + chr(39))} || ')'"
    code = f"capitals || '-' || {_int(1, 99, *k, chr(39) + 'code' + chr(39))}"
    a, b = _picked(f"'{first}'", _int(3, 9, *k, "'ya'"), *k, "'yc'"), _picked(f"'{second}'", _int(3, 8, *k, "'ha'"), *k, "'hc'")
    return f"""WITH t AS (SELECT place, t.value AS template, e.value AS environment, g.value AS granularity, CASE WHEN t.value = 'general_word_shape' THEN 1 WHEN t.value = 'year_number' THEN 0 ELSE 2 END AS k
  FROM {_exact(planning.TEMPLATE_WEIGHTS, total, seed)} t JOIN {_exact(planning.ENVIRONMENT_WEIGHTS, total, seed + 1)} e USING (place) JOIN {_exact(planning.ADDON_GRANULARITY_WEIGHTS, total, seed + 2)} g USING (place)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS r, count(*) OVER (PARTITION BY k) AS m FROM t),
anchored AS (SELECT *, CASE WHEN k = 1 AND r < 26 THEN substr('{LOWER}', r::INT + 1, 1) END AS lower_anchor,
  CASE WHEN k = 2 THEN array_to_string(list_transform(list_filter(range(26), lambda i: i % m = r), lambda i: substr('{LOWER.upper()}', i::INT + 1, 1)), '') END AS upper_anchors FROM r),
named AS (SELECT *, {capitals} AS capitals FROM anchored),
latin AS (SELECT *, CASE template WHEN 'general_word_shape' THEN {word} WHEN 'name_shape' THEN {names} WHEN 'year_number' THEN {year} ELSE {code} END AS latin FROM named),
runs AS (SELECT *, CASE environment WHEN 'pure_latin' THEN [latin] WHEN 'yi_latin' THEN [{a}, latin] ELSE [{a}, {b}, latin] END AS runs FROM latin)
SELECT {source}, template, environment, granularity, lower_anchor, upper_anchors,
  array_to_string(list_transform(list_sort(list_transform(range(len(runs)), lambda i: {{'o': {_u(*k, "'order'", "i")}, 'r': runs[i + 1]}})), lambda s: s.r), '') || chr(10) AS text FROM runs JOIN {dealt(name, source, seed)} USING (place)"""


def residual_rows(split: str, name: str, key: str, first: str, second: str, seed: int) -> str:
    pairs = f"({_count(name)} // 2 * 2)"
    k = (str(seed), "place")
    a, b = _picked(f"'{first}'", _int(5, 11, *k, "'a'", "l"), *k, "'ac'", "l"), _picked(f"'{second}'", _int(4, 9, *k, "'b'", "l"), *k, "'bc'", "l")
    return f"""WITH p AS (SELECT {key}, '{split}_residual_' || lpad((place - 1)::VARCHAR, 4, '0') AS pair_id, value AS pair_type,
  array_to_string(list_transform(range(1, {_int(2, 4, *k, "'lines'")} + 1), lambda l: CASE WHEN {_u(*k, "'swap'", "l")} < 0.5 THEN {b} || {a} ELSE {a} || {b} END), chr(10)) || chr(10) AS text FROM {_exact(dict.fromkeys(planning.RESIDUAL_TYPES, 1.0), pairs, seed)} JOIN {dealt(name, key, seed)} USING (place))
SELECT {key}, pair_id || '_' || pair_role AS id, pair_id, pair_type, pair_role, text FROM p CROSS JOIN (VALUES ('clear'), ('variant')) r(pair_role)"""


def degradation_plan(policy: Mapping[str, float], seed: int) -> str:
    k = (str(seed), "p_partkey")
    names = ", ".join(f"'{d}'" for d in (*planning.DEGRADATIONS, "binarize"))
    strengths = " ".join(f"WHEN '{c}' THEN {s!r}::DOUBLE" for c, s in policy.items())
    return f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'clear_print' WHEN p_partkey % 3 = 0 THEN 'heavy' ELSE 'light' END AS profile FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY {_u(*k, "'operation'", "op")}, op) AS n FROM (SELECT *, unnest([{names}]) AS op FROM r) WHERE profile <> 'clear_print' AND (profile = 'heavy' OR op <> 'binarize')),
c AS (SELECT p_partkey, string_agg(op, ' -> ' ORDER BY n) || ' -> tone_sensor' AS ops, bool_or(op = 'ink') AS has_ink FROM o WHERE n <= CASE WHEN profile = 'heavy' THEN 2 ELSE 1 END GROUP BY p_partkey),
i AS (SELECT r.*, ops, CASE WHEN has_ink THEN CASE WHEN {_u(*k, "'ink'")} < 0.75 THEN 'spread_minfilter' ELSE 'thinning_maxfilter' END END AS ink_mode FROM r LEFT JOIN c USING (p_partkey)),
m AS (SELECT p_partkey, profile, CASE WHEN profile = 'clear_print' THEN 'clear_print' ELSE concat_ws('|', profile, ops, coalesce(ink_mode, 'none')) END AS class_key, ink_mode, CASE class_key {strengths} END AS capped FROM i)
SELECT p_partkey, profile, class_key, ink_mode, capped IS NOT NULL AS applied, coalesce(capped, 1.0::DOUBLE) AS strength FROM m"""
