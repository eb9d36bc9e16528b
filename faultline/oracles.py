"""SQL that gives the rows of the queries over the same tables, for comparison. Built from shared parts."""

from __future__ import annotations

from faultline.config import ABSTAIN_MARKERS, Run
from faultline.functions.text import ALTERNATES
from faultline.operators.candidates import MONTHS
from faultline.operators.pools import PRIME, drawn_by

RUN = Run()
NL = "chr(10)"
PARA = f"{NL} || {NL}"
SPACE = r"[\s\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def norm(x: str) -> str:
    """Normalised answers; the article pass runs twice, as neighbours share a separator."""
    article = r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])"
    bare = f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '{article}', '\\1 \\2', 'g')"
    return f"trim({squeeze(bare)})"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda w: length(w) > 2))"


def token_count(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+'))"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '(?s).[^.!?]*[.!?]|.[^.!?]*$'), lambda s: {strip('s')}), lambda s: s <> '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{SPACE}+'), lambda w: w <> '')"


def keyed(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def abstains(x: str) -> str:
    p = strip(f"lower(coalesce({x}, ''))")
    return f"({p} = '' OR " + " OR ".join("contains({}, '{}')".format(p, m.replace("'", "''")) for m in ABSTAIN_MARKERS) + ")"


def gram_text(x: str) -> str:
    return strip(squeeze(f"lower(coalesce({x}, ''))"))


def grams(t: str) -> str:
    """Distinct character 5-grams of a column of gram texts; a shorter one is its own gram."""
    return f"CASE WHEN {t} = '' THEN [] WHEN length({t}) < 5 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - 3), lambda i: substring({t}, i, 5))) END"


def f1(p: str, g: str) -> str:
    """F1 of two token lists."""
    same = f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda y: y = t)), len(list_filter({g}, lambda y: y = t)))))"
    return f"""CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 OR {same} = 0 THEN 0.0
      ELSE 2 * ({same}::DOUBLE / len({p})) * ({same}::DOUBLE / len({g})) / (({same}::DOUBLE / len({p})) + ({same}::DOUBLE / len({g}))) END"""


#: lines of documents; pages made of them; sections, paragraphs and chunks of the cleaned pages.
PAGES = f"""
doc AS (SELECT doc_id AS page_id, lang AS category_group, source, string_split(coalesce(text, ''), {NL}) AS lines FROM documents),
page AS (SELECT page_id, category_group, source, lines, array_to_string(list_slice(string_split(lines[1], ' '), 1, 3), ' ') AS page_title,
  array_to_string(list_transform(lines, lambda l, i: CASE WHEN i > 1 AND (i - 1) % 4 = 0 THEN '== Section ' || ((i - 1) // 4) || ' ==' || {PARA} ELSE '' END || l), {PARA}) AS raw_text FROM doc)"""
_BODY = rf"regexp_replace(regexp_replace(string_agg(line, {PARA} ORDER BY i), '(?i)\[\d+\]|\[citation needed\]', '', 'g'), '[ \t]+', ' ', 'g')"
SECTIONS = f"""{PAGES},
line AS (SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM doc),
raw_section AS (SELECT page_id, (i - 1) // 4 AS k, {strip(f"regexp_replace({_BODY}, '\n{{3,}}', {PARA}, 'g')")} AS body FROM line GROUP BY ALL),
section AS (SELECT page_id, k, CASE WHEN k = 0 THEN 'Lead' ELSE 'Section ' || k END AS section_title, body FROM raw_section WHERE body <> ''),
clean AS (SELECT page_id, page_title, category_group, coalesce(cleaned_text, '') AS cleaned_text, coalesce(section_count, 0) AS section_count FROM page LEFT JOIN
  (SELECT page_id, string_agg(CASE WHEN k = 0 THEN body ELSE '== ' || section_title || ' ==' || {NL} || body END, {PARA} ORDER BY k) AS cleaned_text, count(*) AS section_count FROM section GROUP BY page_id) USING (page_id))"""
SIZE = RUN.chunking.chunk_tokens
_PARTS = r"regexp_extract_all({}, '(?:\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+)\s*')"


def windows(x: str) -> str:
    """Stretches of SIZE tokens, each token with the white space after it."""
    parts = _PARTS.format(x)
    return f"CASE WHEN len({parts}) <= {SIZE} THEN [{x}] ELSE list_transform(range(0, len({parts}), {SIZE}), lambda k: {strip(f"array_to_string(list_slice({parts}, k + 1, k + {SIZE}), '')")}) END"


_NONE = "[]::VARCHAR[]"
_PACK = f"""list_reduce(list_transform(sents, lambda s: {{'out': {_NONE}, 'cur': s, 'n': {token_count('s')}}}), lambda a, b:
  CASE WHEN b.n > {SIZE} THEN {{'out': list_concat(list_concat(a.out, CASE WHEN a.n > 0 THEN [a.cur] ELSE {_NONE} END), {windows('b.cur')}), 'cur': '', 'n': 0}}
  WHEN a.n > 0 AND a.n + 1 + b.n > {SIZE} THEN {{'out': list_append(a.out, a.cur), 'cur': b.cur, 'n': b.n}}
  WHEN a.n > 0 THEN {{'out': a.out, 'cur': a.cur || ' ' || b.cur, 'n': a.n + 1 + b.n}} ELSE {{'out': a.out, 'cur': b.cur, 'n': b.n}} END, {{'out': {_NONE}, 'cur': '', 'n': 0::BIGINT}})"""
CHUNKS = f"""{SECTIONS},
para AS (SELECT page_id, section_title, k, unnest(ps) AS text, generate_subscripts(ps, 1) AS j FROM
  (SELECT page_id, section_title, k, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM section)),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k, j) - 1 AS paragraph_index, {token_count('text')} AS tokens FROM para),
cut AS (SELECT page_id, paragraph_index, CASE WHEN len(sents) <= 1 THEN {windows('text')} ELSE list_concat(packed.out, CASE WHEN packed.n > 0 THEN [packed.cur] ELSE {_NONE} END) END AS pieces FROM
  (SELECT *, {_PACK} AS packed FROM (SELECT page_id, paragraph_index, text, {sentences('text')} AS sents FROM placed WHERE tokens > {SIZE}))),
piece AS (SELECT page_id, section_title, paragraph_index, 1 AS i, text FROM placed WHERE tokens <= {SIZE} UNION ALL
  SELECT page_id, section_title, paragraph_index, i, {strip('text')} AS text FROM (SELECT page_id, paragraph_index, unnest(pieces) AS text, generate_subscripts(pieces, 1) AS i FROM cut) JOIN (SELECT page_id, paragraph_index, section_title FROM placed) USING (page_id, paragraph_index)),
counted AS (SELECT *, row_number() OVER (PARTITION BY page_id, paragraph_index ORDER BY i) - 1 AS chunk_index FROM (SELECT *, {token_count('text')} AS token_count FROM piece) WHERE token_count >= {RUN.chunking.least_tokens}),
chunk AS (SELECT *, page_id || '_1_' || paragraph_index || '_' || chunk_index AS chunk_id, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text,
  lag(page_id || '_1_' || paragraph_index || '_' || chunk_index) OVER w AS previous_chunk_id, lead(page_id || '_1_' || paragraph_index || '_' || chunk_index) OVER w AS next_chunk_id
  FROM counted JOIN (SELECT page_id, page_title, category_group FROM page) USING (page_id) WINDOW w AS (PARTITION BY page_id ORDER BY paragraph_index, chunk_index))"""


def ratio_repeat(x: str) -> str:
    ps = f"list_filter(list_transform(regexp_split_to_array({strip(x)}, '\\n\\s*\\n'), lambda p: lower({squeeze(strip('p'))})), lambda p: p <> '')"
    return f"CASE WHEN len({ps}) < 2 THEN 0.0 ELSE (len({ps}) - len(list_distinct({ps})))::DOUBLE / len({ps}) END"


def ratio_prose(x: str) -> str:
    ls = f"list_filter(list_transform(string_split(coalesce({x}, ''), {NL}), lambda s: {strip('s')}), lambda s: s <> '')"
    good = f"list_filter({ls}, lambda s: NOT (left(s, 1) IN ('|', '!', '*', '#', '{{') OR regexp_full_match(s, '[^\\p{{L}}\\p{{M}}_]+')))"
    chars = lambda a: f"list_sum(list_transform({a}, lambda s: length(s)))"
    return f"coalesce(coalesce({chars(good)}, 0)::DOUBLE / {chars(ls)}, 0.0)"


REJECTED = f"""{SECTIONS},
early AS (SELECT page_id, category_group, 'too_short' AS reasons, length(raw_text) AS char_count FROM page WHERE length(raw_text) < 2000),
late AS (SELECT page_id, category_group, length(cleaned_text) AS char_count, concat_ws(',', CASE WHEN length(cleaned_text) < 2000 THEN 'too_short_after_clean' END, CASE WHEN section_count < 2 THEN 'insufficient_sections' END,
  CASE WHEN {ratio_prose('cleaned_text')} < 0.55 THEN 'low_prose_ratio' END, CASE WHEN {ratio_repeat('cleaned_text')} > 0.35 THEN 'high_repeat_ratio' END) AS reasons FROM clean WHERE page_id NOT IN (SELECT page_id FROM early)),
rejected AS (SELECT page_id, category_group, reasons, char_count FROM early UNION ALL SELECT page_id, category_group, reasons, char_count FROM late WHERE reasons <> '')"""

GOOD = rf"""{CHUNKS},
good AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY paragraph_index, chunk_index) AS turn FROM chunk
  WHERE token_count BETWEEN 60 AND 320 AND length(text) >= 120 AND (regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])\d{{2,}}($|[^\p{{L}}\p{{N}}_])') OR regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({MONTHS})($|[^\p{{L}}\p{{N}}_])') OR len(regexp_extract_all(text, '[A-Z][a-z]+')) >= 2)),
slotted AS (SELECT *, row_number() OVER (ORDER BY turn, page_id) - 1 AS slot FROM good ORDER BY turn, page_id LIMIT 2000)"""
_COUNTS = {"easy": 400, "medium": 400, "hard": 200}
SCHEDULE = "schedule AS (SELECT row_number() OVER (ORDER BY k, level) - 1 AS slot, difficulty FROM (VALUES " + ", ".join(f"('{d}', {i}, {n})" for i, (d, n) in enumerate(_COUNTS.items())) + ") v(difficulty, level, n), range(1, 1001) r(k) WHERE k <= n)"
CANDIDATES = rf"""{GOOD}, {SCHEDULE},
supported AS (SELECT *, list_sort(list_transform(list_filter({sentences('text')}, lambda s: len({words('s')}) >= 6), lambda s, i: {{'n': -length(s), 'i': i, 's': s}}))[1].s AS support FROM slotted),
answered AS (SELECT *, list_sort(list_transform(list_filter(list_transform({words('support')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> ''), lambda w, i: {{'n': -length(w), 'i': i, 's': w}}))[1].s AS gold FROM supported WHERE support IS NOT NULL),
asked AS (SELECT * EXCLUDE (slot), row_number() OVER (ORDER BY slot) - 1 AS slot, 'Which word completes: ' || left(support, instr(support, gold) - 1) || '____' || substring(support, instr(support, gold) + length(gold)) AS question FROM answered WHERE gold IS NOT NULL),
candidate AS (SELECT 'cand_' || left(sha1(chunk_id || '||' || question), 12) AS candidate_id, question, gold AS gold_answer, support AS supporting_sentence, CASE WHEN regexp_matches(gold, '\d') THEN 'numeric' ELSE 'other' END AS answer_type, difficulty,
  slot, page_id, page_title, section_title, chunk_id, category_group, text AS chunk_text FROM asked JOIN schedule USING (slot) WHERE slot < 1000)"""
RESULTS = f"""{CANDIDATES},
normal AS (SELECT *, {norm('question')} AS nq, {norm('gold_answer')} AS ng, {norm('supporting_sentence')} AS ns, {norm('chunk_text')} AS nc, {norm('page_title')} AS nt, {token_count('question')} AS question_tokens FROM candidate),
ruled AS (SELECT *, concat_ws(',', CASE WHEN length(question) < 12 THEN 'question_too_short' END, CASE WHEN question_tokens > 60 THEN 'question_too_long' END, CASE WHEN contains(nq, ng) THEN 'answer_in_question' END,
  CASE WHEN NOT contains(ns, ng) THEN 'answer_not_in_supporting_sentence' END, CASE WHEN ns <> '' AND NOT contains(nc, ns) THEN 'supporting_sentence_not_in_chunk' END, CASE WHEN nt <> '' AND contains(nq, nt) THEN 'title_leak_in_question' END) AS rules FROM normal),
ruled_result AS (SELECT *, rules = '' AS accepted, CASE WHEN rules = '' THEN 1.0 ELSE 0.1 END AS quality_score, concat_ws(',', nullif(rules, ''), CASE WHEN rules <> '' THEN 'below_quality_threshold' END) AS reasons FROM ruled),
good_one AS MATERIALIZED (SELECT candidate_id, nq, ns || '||' || ng AS fact, {grams('gt')} AS gs, row_number() OVER (ORDER BY slot, candidate_id)::INT AS i FROM (SELECT *, {gram_text('question')} AS gt FROM ruled_result WHERE accepted)),
rival AS (SELECT x.i, y.i AS j FROM good_one x JOIN good_one y ON y.i < x.i AND x.nq = y.nq UNION SELECT x.i, y.i AS j FROM good_one x JOIN good_one y ON y.i < x.i AND x.fact = y.fact UNION
  SELECT i, j FROM (SELECT x.i, y.i AS j, count(*) AS k, any_value(x.m) AS nx, any_value(y.m) AS ny FROM (SELECT i, len(gs) AS m, unnest(gs) AS g FROM good_one) x JOIN (SELECT i, len(gs) AS m, unnest(gs) AS g FROM good_one) y ON x.g = y.g AND y.i < x.i GROUP BY x.i, y.i) WHERE 100 * k >= 85 * (nx + ny - k)),
ordered AS (SELECT i, coalesce(list(j) FILTER (j IS NOT NULL), []::INT[]) AS bad FROM good_one LEFT JOIN rival USING (i) GROUP BY i),
winner AS (SELECT unnest(list_reduce(list({{'k': [i], 'bad': bad}} ORDER BY i), lambda a, b: CASE WHEN list_has_any(a.k, b.bad) THEN a ELSE {{'k': list_concat(a.k, b.k), 'bad': a.bad}} END, {{'k': []::INT[], 'bad': []::INT[]}}).k) AS i FROM ordered),
repeated AS (SELECT x.candidate_id, coalesce(nullif(concat_ws(',', CASE WHEN bool_or(x.nq = y.nq) THEN 'duplicate_question' END, CASE WHEN bool_or(x.fact = y.fact) THEN 'duplicate_supporting_fact' END), ''), 'near_duplicate_question') AS more
  FROM good_one x JOIN rival r ON r.i = x.i JOIN winner w ON w.i = r.j JOIN good_one y ON y.i = r.j WHERE x.i NOT IN (SELECT i FROM winner) GROUP BY x.candidate_id),
result AS (SELECT ruled_result.* EXCLUDE (accepted, reasons), accepted AND more IS NULL AS accepted, concat_ws(',', nullif(reasons, ''), more) AS reasons FROM ruled_result LEFT JOIN repeated USING (candidate_id))"""
_SHARE = RUN.validation.target_clean_seeds // len(RUN.categories)
_WANT = "CASE difficulty " + " ".join(f"WHEN '{d}' THEN {round(_SHARE * r)}" for d, r in (("easy", 0.4), ("medium", 0.4), ("hard", 0.2))) + " END"
_TIE = f"quality_score DESC, {keyed('42', "'seed'", 'candidate_id')}, candidate_id"
_KNOWN = "category_group IN (" + ", ".join(f"'{c}'" for c in RUN.categories) + ")"
_ORDER = f"chosen DESC, CASE WHEN chosen THEN category_group END NULLS FIRST, CASE WHEN chosen THEN in_category END NULLS FIRST, {_TIE}"
SEEDS = f"""{RESULTS},
levelled AS (SELECT *, row_number() OVER (PARTITION BY category_group, difficulty ORDER BY {_TIE}) <= {_WANT} AND {_KNOWN} AS first FROM result WHERE accepted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category_group ORDER BY first DESC, {_TIE}) AS in_category FROM levelled),
picked AS (SELECT *, in_category <= {_SHARE} AND {_KNOWN} AS chosen FROM ranked),
seed AS (SELECT 'seed_' || lpad((row_number() OVER (ORDER BY {_ORDER}) - 1)::VARCHAR, 6, '0') AS sample_id, * EXCLUDE (chosen, first, in_category) FROM (SELECT * FROM picked ORDER BY {_ORDER} LIMIT {RUN.validation.target_clean_seeds}))"""
_KEY = "('0x' || substring({}, {}, 8))::BIGINT % " + str(PRIME)


def pools(purpose: str) -> str:
    """Seeds with their gold chunk, neighbours, and the texts of easy and hard distractors in order."""
    key = keyed("42", f"'{purpose}'", "sample_id")
    return f"""{SEEDS},
ray AS (SELECT sample_id, page_id, category_group, {_KEY.format(key, 1)} AS b, {_KEY.format(key, 9)} AS c FROM seed),
offer AS (SELECT page_id AS d_page, chunk_id AS d_chunk, category_group AS d_category, text AS d_text, md5(text) AS mark, {_KEY.format('md5(text)', 1)} AS a FROM chunk),
valued AS (SELECT sample_id, d_category IS NOT DISTINCT FROM category_group AS same, (a * b + c) % {PRIME} AS v, mark, min(d_chunk) AS d_chunk FROM ray JOIN offer ON d_page <> page_id GROUP BY ALL),
drawn AS (SELECT *, row_number() OVER (PARTITION BY sample_id, same ORDER BY v, mark) AS r FROM valued QUALIFY r <= {drawn_by(RUN)}),
pooled AS (SELECT sample_id, list(d_text ORDER BY r) FILTER (same) AS h, list(d_text ORDER BY r) FILTER (NOT same) AS e FROM drawn JOIN (SELECT d_chunk, d_text FROM offer) USING (d_chunk) GROUP BY sample_id),
base AS (SELECT seed.*, chunk.text AS gold_text, chunk.previous_text, chunk.next_text, coalesce(h, e, []) AS hard, coalesce(e, h, []) AS easy, severity
  FROM seed JOIN chunk USING (chunk_id) LEFT JOIN pooled USING (sample_id), (VALUES ('low'), ('medium'), ('high')) s(severity))"""


def holds(x: str) -> str:
    """The text holds the seed's answer (``ng``)."""
    return f"contains({norm(x)}, ng)"


def case_rows(body: str, kind: str, available: bool, difficulty: str = "CASE severity WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 ELSE 0.75 END", where: str = "true") -> str:
    return f"""WITH {body} SELECT sample_id || '__{kind}__' || severity AS failure_id, severity, ({difficulty})::DOUBLE AS difficulty, len(contexts)::INT AS n, md5(array_to_string(contexts, '|')) AS contexts_md5, {str(available).lower()} AS answer_available FROM made WHERE {where}"""


def full(a: str) -> str:
    return f"list_filter({a}, lambda t: t IS NOT NULL AND {strip('t')} <> '')"


def without_answer(a: str) -> str:
    return f"list_filter({a}, lambda t: NOT {holds('t')})"


_NEAR = "list_filter([previous_text, next_text], lambda t: t IS NOT NULL)"
_MATCH = f"({norm('s')} <> '' AND ns <> '' AND (contains({norm('s')}, ns) OR contains(ns, {norm('s')})))"
_REDUCED = strip(f"array_to_string({without_answer(f'list_filter({sentences('gold_text')}, lambda s: NOT {_MATCH})')}, ' ')")
MISSING = f"""{pools('missing_evidence')}, made AS (SELECT *, {full(f"CASE severity WHEN 'low' THEN list_concat([{_REDUCED}], {without_answer(f'list_slice({_NEAR}, 1, 1)')}) WHEN 'medium' THEN list_slice({without_answer(_NEAR)}, 1, 2) ELSE list_slice({without_answer('list_slice(hard, 1, 6)')}, 1, 3) END")} AS contexts FROM base)"""
NOISE = f"""{pools('context_noise')},
mixed AS (SELECT *, list_append(CASE WHEN severity = 'low' THEN list_slice(easy, 1, 2) WHEN severity = 'medium' THEN list_slice(hard, 1, 4) ELSE list_slice(hard, 1, 6) END, gold_text) AS every FROM base),
made AS (SELECT *, list_transform(list_sort(list_transform(every, lambda t, i: {{'o': {keyed('42', "'noise_order'", 'sample_id', 'severity', '(i - 1)')}, 't': t}})), lambda x: x.t) AS contexts FROM mixed)"""
POSITION = f"""{pools('evidence_position')},
filled AS (SELECT *, list_slice(easy, 1, 7) AS fillers FROM base),
spot AS (SELECT *, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN (len(fillers) + 1) // 2 ELSE len(fillers) END AS pos FROM filled),
made AS (SELECT *, list_concat(list_append(list_slice(fillers, 1, pos), gold_text), list_slice(fillers, pos + 1, len(fillers))) AS contexts FROM spot)"""
NEGATIVE = f"""{SEEDS}, q AS (SELECT *, {token_set("concat_ws(' ', question, supporting_sentence)")} AS qs FROM seed),
c AS (SELECT chunk_id, page_id, category_group, text, {norm('text')} AS ncx, {token_set('text')} AS cs FROM chunk),
pair AS (SELECT sample_id, c.chunk_id, c.text, q.category_group = c.category_group AS same, CASE WHEN len(qs) = 0 THEN 0.0 ELSE len(list_intersect(qs, cs))::DOUBLE / len(qs) END AS overlap FROM q JOIN c ON c.page_id <> q.page_id AND NOT contains(c.ncx, q.ng)),
top AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY same DESC, overlap DESC, chunk_id DESC) AS r FROM pair QUALIFY r <= 8),
made AS (SELECT sample_id, severity, list(text ORDER BY r) AS contexts, floor((2 * sum(floor(overlap * 10000 + 0.5)) + count(*)) / (2 * count(*))) / 10000 AS mean FROM top, (VALUES ('low', 2), ('medium', 4), ('high', 8)) s(severity, most) WHERE r <= most GROUP BY ALL)"""

_AT = "coalesce(list_filter(list_transform(sents, lambda s, i: CASE WHEN contains(s, support) THEN i END), lambda i: i IS NOT NULL)[1], len(sents) + 1)"
_HALVES = f"array_to_string(list_slice(ws, 1, len(ws) // 2), ' ') AS cut_a, array_to_string(list_slice(ws, len(ws) // 2 + 1, len(ws)), ' ') AS cut_b"
_JOIN = lambda *parts: strip("concat_ws(' ', " + ", ".join(parts) + ")")
BOUNDARY = f"""{pools('chunk_boundary')},
cut0 AS (SELECT *, {strip('supporting_sentence')} AS support, {sentences('gold_text')} AS sents, {words('supporting_sentence')} AS ws FROM base),
cut1 AS (SELECT *, {_AT} AS spot, {_HALVES} FROM cut0),
cut2 AS (SELECT *, {strip("array_to_string(list_slice(sents, 1, spot - 1), ' ')")} AS before, {strip("array_to_string(list_slice(sents, spot + 1, len(sents)), ' ')")} AS after, {words('cut_b')} AS sec FROM cut1),
cut3 AS (SELECT *, array_to_string(list_slice(sec, 1, greatest(1, len(sec) // 2)), ' ') AS b1, array_to_string(list_slice(sec, greatest(1, len(sec) // 2) + 1, len(sec)), ' ') AS b2 FROM cut2),
slot AS (SELECT *, CASE severity WHEN 'low' THEN [{_JOIN('before', 'cut_a')}, {_JOIN('cut_b', 'after')}] WHEN 'medium' THEN [{_JOIN('before', 'cut_a')}, {_JOIN('cut_b', 'after')}] ELSE [{_JOIN('before', 'cut_a')}, {strip('b1')}, {_JOIN('b2', 'after')}] END AS golds,
  coalesce({strip('hard[1]')}, '') AS d0, coalesce({strip('hard[2]')}, '') AS d1 FROM cut3),
made AS (SELECT *, list_filter(CASE severity WHEN 'low' THEN golds WHEN 'medium' THEN [golds[1], d0, golds[2]] ELSE [golds[1], d0, golds[2], d1, golds[3]] END, lambda t: t <> '') AS contexts FROM slot WHERE len(list_filter(golds, lambda t: t = '')) = 0)"""
_list = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"


def found(x: str, number: str) -> tuple[str, str, str]:
    """What stands before the first such number that is a word of its own, the number, and the rest."""
    word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    pattern = f"(?s)^(|.*?{other})({number})($|{other}.*$)"
    return tuple(f"regexp_extract({x}, '{pattern}', {k})" for k in (1, 2, 3))


def general(x: str) -> str:
    """As C prints with %g, for numbers from one to below a million."""
    fixed = f"round({x}, 0)"
    for places in range(1, 6):
        fixed = f"CASE WHEN {x} < {10 ** (6 - places)} THEN round({x}, {places}) ELSE {fixed} END"
    return f"regexp_replace(({fixed})::VARCHAR, '\\.0$', '')"


def alternate(gold: str, kind: str, key: str) -> str:
    """Another answer for ``gold`` of the type ``kind``, an SQL string or column."""
    before, year, after = found(gold, "1[0-9]{3}|20[0-9]{2}")
    head, number, tail = found(gold, r"[0-9]+(?:\.[0-9]+)?")
    of = lambda k: f"list_filter({_list(ALTERNATES[k])}, lambda a: {norm('a')} <> {norm(gold)})"
    pick = lambda k: f"{of(k)}[1 + (('0x' || left({key}, 8))::BIGINT % len({of(k)}))]"
    plus = f"CASE WHEN contains({number}, '.') THEN {general(f'(({number})::DOUBLE + 1)')} ELSE (({number})::DECIMAL(38, 0) + 1)::VARCHAR END"
    return f"""CASE WHEN {kind} = 'date' AND {year} <> '' THEN {before} || (({year})::INT - 3) || {after} WHEN {kind} IN ('numeric', 'other') AND {number} <> '' THEN {head} || {plus} || {tail}
  WHEN {kind} = 'date' THEN {pick('date')} WHEN {kind} = 'numeric' THEN {pick('numeric')} ELSE {pick('other')} END"""


CONFLICT = f"""{pools('conflict')},
alt1 AS (SELECT *, {strip('supporting_sentence')} AS support, {alternate('gold_answer', 'answer_type', keyed('42', "'conflict'", 'sample_id', 'severity'))} AS other FROM base),
alt2 AS (SELECT *, {strip("left(support, instr(support, gold_answer) - 1) || other || substring(support, instr(support, gold_answer) + length(gold_answer))")} AS said FROM alt1),
alt3 AS (SELECT *, CASE WHEN {holds('said')} THEN 'Contrary to other reports, the correct answer is ' || other || ', not ' || gold_answer || '.' ELSE said END AS passage, list_filter({full('list_slice(easy, 1, 8)')}, lambda t: t <> gold_text) AS fillers FROM alt2 WHERE said <> '' AND {norm('said')} <> ns),
made AS (SELECT *, {full("CASE severity WHEN 'low' THEN [gold_text, passage] WHEN 'medium' THEN list_concat([passage, gold_text], list_slice(fillers, 1, 2)) ELSE list_slice(list_concat([passage], list_slice(fillers, 1, 5), [passage, gold_text]), 1, 8) END")} AS contexts FROM alt3)"""
_CLEAN = pools("clean")
CLEAN = f"""WITH {_CLEAN}, own AS (SELECT DISTINCT sample_id, gold_text, previous_text, next_text, easy FROM base),
flat AS (SELECT sample_id, t, i FROM (SELECT sample_id, unnest(every) AS t, generate_subscripts(every, 1) AS i FROM (SELECT sample_id, list_concat([gold_text], list_filter(list_concat([previous_text, next_text], easy), lambda t: t IS NOT NULL AND trim(t) <> '')) AS every FROM own))),
once AS (SELECT sample_id, t, min(i) AS i FROM flat GROUP BY ALL), kept AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY i) AS r FROM once)
SELECT sample_id, count(*)::INT AS n, md5(string_agg(t, '|' ORDER BY r)) AS contexts_md5 FROM kept WHERE r <= 8 GROUP BY sample_id"""

PAIRS = "pair AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS prediction FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_TURNS = f"""{PAIRS}, toks AS (SELECT *, {tokens('prediction')} AS p, {tokens('gold')} AS g FROM pair),
scored AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model_name, CASE WHEN turn = 0 THEN 'clean' WHEN turn % 4 = 2 THEN 'context_noise' ELSE 'conflict' END AS condition,
  CASE WHEN turn > 0 THEN CASE conv_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS severity, CASE WHEN {norm('prediction')} = {norm('gold')} THEN 1.0 ELSE 0.0 END AS em, {f1('p', 'g')} AS f, {abstains('prediction')} AS ab,
  CASE WHEN turn > 2 THEN length(gold) > 200 END AS judge FROM toks),
res AS (SELECT *, (coalesce(judge, false) OR em >= 1 OR f >= 0.6)::INT AS ok, CASE WHEN turn > 0 THEN (NOT ab AND f < 0.2)::INT END AS hal FROM scored)"""


def _mean(x: str) -> str:
    return f"round(coalesce(sum({x}::DECIMAL(18, 10))::DOUBLE / count({x}), 0.0), 4)"


_METRICS = f"count(*) AS n, {_mean('ok')} AS accuracy, {_mean('em')} AS exact_match, {_mean('f')} AS token_f1, {_mean('ab::INT')} AS abstention_rate, {_mean('hal')} AS hallucination_rate"
_TITLE = f"lower({squeeze(f"replace({strip('page_title')}, '_', ' ')")})"
_RATES = ["candidates", "accepted", "schema_success_rate", "qa_acceptance_rate", "clean_seed_yield", "failure_verification_pass_rate"]
RUNS = """cnt AS (SELECT source, count(*) AS candidates, count(*) FILTER (n_chars < 200) AS errors, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (toxic = 0) AS seeds,
  count(*) FILTER (lang = 'en') AS valid, count(*) FILTER (lang <> 'en') AS invalid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
run AS (SELECT candidates::DOUBLE AS candidates, accepted::DOUBLE AS accepted, candidates / nullif(candidates + errors, 0) AS schema_success_rate, accepted / nullif(CASE WHEN accepted + rejected > 0 THEN accepted + rejected ELSE candidates END, 0) AS qa_acceptance_rate,
  seeds / nullif(candidates, 0) AS clean_seed_yield, valid / nullif(valid + invalid, 0) AS failure_verification_pass_rate FROM cnt)"""

_COMPONENT = "CASE WHEN r = 'below_quality_threshold' THEN 'quality_threshold' WHEN r IN ('duplicate_question', 'duplicate_supporting_fact', 'near_duplicate_question') THEN 'deduplication' ELSE 'rule_checks' END"
#: First-wins deduplication of all candidates, in the order of their ids.
FIRST_WINS = RESULTS[RESULTS.index("good_one AS MATERIALIZED") : RESULTS.index(",\nresult AS")].replace("FROM ruled_result WHERE accepted", "FROM every").join([f"every AS (SELECT candidate_id, slot, question, {norm('question')} AS nq, {norm('gold_answer')} AS ng, {norm('supporting_sentence')} AS ns FROM candidate), ", ""])
_JUDGED = f"coalesce(answerable AND answer_supported AND answer_unique AND question_clear AND judge_confidence >= {RUN.validation.min_judge_confidence}, false)"
_FIRST = f"coalesce({sentences("coalesce(text, '')")}[1], '')"
MIXED = f"""base AS (SELECT doc_id AS n, {_FIRST} AS first, doc_id % 3 > 0 AS ran, doc_id % 5 > 0 AS told FROM documents),
mixed AS (SELECT n, n::VARCHAR AS candidate_id, ran, ['Who ', 'which ', 'When ', 'What '][n % 4 + 1] || left(first, 40) AS question, ['person', 'organization', 'location', 'other'][n % 4 + 1] AS answer_type, first || CASE WHEN n % 2 = 0 THEN ' and more' ELSE '' END AS support, n % 7 = 0 AS both_,
  CASE WHEN ran THEN n % 11 > 0 END AS answerable, CASE WHEN ran THEN n % 13 > 0 END AS answer_supported, CASE WHEN ran THEN n % 17 > 0 END AS answer_unique, CASE WHEN ran THEN n % 19 > 0 END AS question_clear,
  CASE WHEN ran THEN n % 10 / 10 END AS judge_confidence, CASE WHEN told THEN n % 8 / 8 END AS baseline_f1, CASE WHEN told THEN n % 6 > 1 END AS baseline_correct, n % 9 > 0 AS rule_ok FROM base),
flagged AS (SELECT *, n % 4 IN (0, 1) AND contains(support, ' and ') AND NOT both_ AS multiple FROM mixed)"""


def _score(rules: str, unique: str) -> str:
    judge = "(answerable::INT + answer_supported::INT + answer_unique::INT + question_clear::INT) * 0.25::DOUBLE * judge_confidence"
    total = f"0.3::DOUBLE * ({rules})::INT + 0.1::DOUBLE * ({unique})::INT + 0.3::DOUBLE * coalesce({judge}, ({rules})::INT) + 0.3::DOUBLE * CASE WHEN baseline_correct IS NULL THEN ({rules})::INT ELSE greatest(coalesce(baseline_f1, 0), baseline_correct::INT) END"
    return f"round(least({total}, 1.0), 4)"


SQL = {
    "page_reject_reasons": f"WITH {REJECTED} SELECT page_id, category_group, reasons, char_count::INT AS char_count FROM rejected",
    "page_reject_counts": f"WITH {REJECTED} SELECT category_group, reason, count(*) AS n FROM (SELECT category_group, unnest(string_split(reasons, ',')) AS reason FROM rejected) GROUP BY ALL",
    "page_filter_raw": f"""WITH {PAGES}, named AS (SELECT page_id, raw_text, CASE page_id % 11 WHEN 1 THEN ' List of ' || page_title WHEN 2 THEN page_title || ' (Disambiguation)' WHEN 3 THEN 'A TIMELINE of ' || page_title WHEN 4 THEN 'Outlines of ' || page_title WHEN 5 THEN '' ELSE page_title END AS title FROM page)
SELECT page_id, concat_ws(',', CASE WHEN page_id % 7 = 0 THEN 'redirect' END, CASE WHEN page_id % 13 = 0 OR ends_with(lower(title), '(disambiguation)') THEN 'disambiguation' END, CASE WHEN starts_with(lower(trim(title)), 'list of ') THEN 'list_page' END,
  CASE WHEN contains(lower(title), ' timeline ') THEN 'timeline_page' END, CASE WHEN length(raw_text) < 500 THEN 'too_short' END) AS reasons FROM named""",
    "cleaned_pages": f"WITH {SECTIONS} SELECT page_id, page_title, section_count::INT AS section_count, length(cleaned_text)::INT AS char_count, md5(cleaned_text) AS text_md5 FROM clean",
    "section_rows": f"WITH {SECTIONS} SELECT page_id, section_title, CASE WHEN k = 0 THEN 1 ELSE 2 END AS level, section_title AS path, length(body)::INT AS chars FROM section",
    "prose_ratio": f"SELECT doc_id, round({ratio_prose('text')}, 6) AS ratio FROM documents",
    "paragraph_repeat_ratio": f"WITH {PAGES} SELECT page_id, round({ratio_repeat('raw_text')}, 6) AS ratio FROM page",
    "sentence_counts": f"SELECT doc_id, len(s)::INT AS sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {sentences("coalesce(text, '')")} AS s FROM documents)",
    "token_counts": f"SELECT doc_id, {token_count('text')}::INT AS tokens FROM documents",
    "title_keys": f"WITH {PAGES} SELECT page_id, {_TITLE} AS title_key FROM page",
    "exact_title_dedup": f"WITH {PAGES} SELECT min(page_id) AS page_id, {_TITLE} AS title_key FROM page GROUP BY title_key",
    "title_sample": f"""WITH {PAGES}, once AS (SELECT DISTINCT source, {_TITLE} AS title_key FROM page), drawn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {keyed('42', 'source', 'title_key')}, title_key) AS rank FROM once QUALIFY rank <= 20)
SELECT source, title_key, rank FROM drawn QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY source, rank) = 1""",
    "near_duplicate_pairs": f"""WITH t AS (SELECT doc_id, {strip(squeeze("lower(coalesce(text, ''))"))} AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) < 5 THEN [t] ELSE list_sort(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) END AS gs FROM t),
rep AS (SELECT min(doc_id) AS id, gs, len(gs) AS n FROM g WHERE len(gs) > 0 GROUP BY gs), each AS (SELECT id, n, unnest(gs) AS gram FROM rep),
pair AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb FROM each x JOIN each y ON x.gram = y.gram AND x.id < y.id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 85 GROUP BY x.id, y.id)
SELECT a, b, k::INT AS inter, (na + nb - k)::INT AS either FROM pair WHERE k * 100 >= (na + nb - k) * 85""",
    "category_quota_sample": f"SELECT doc_id AS page_id, lang AS category_group, row_number() OVER (PARTITION BY lang ORDER BY {keyed('42', 'lang', 'doc_id')}, doc_id)::INT AS rank FROM documents QUALIFY rank <= CASE lang " + " ".join(f"WHEN '{c}' THEN {q}" for c, q in RUN.categories.items()) + " END",
    "chunk_rows": f"WITH {CHUNKS} SELECT chunk_id, page_id, section_title, paragraph_index::INT AS paragraph_index, chunk_index::INT AS chunk_index, token_count::INT AS token_count, md5(text) AS text_md5 FROM chunk",
    "chunk_adjacency": f"WITH {CHUNKS} SELECT chunk_id, previous_chunk_id, next_chunk_id FROM chunk",
    "dataset_stats": f"""WITH {CHUNKS}, p AS (SELECT count(*) AS n_pages, min(section_count)::INT AS min_sections, max(section_count)::INT AS max_sections, round(avg(section_count), 2) AS avg_sections FROM clean),
c AS (SELECT count(*) AS n_chunks, min(token_count)::INT AS min_tokens, max(token_count)::INT AS max_tokens, round(avg(token_count), 2) AS avg_tokens, count(previous_chunk_id) AS with_previous, count(next_chunk_id) AS with_next FROM chunk)
SELECT *, CASE WHEN n_pages > 0 THEN round(n_chunks / n_pages, 2) ELSE 0.0 END AS chunks_per_page FROM p, c""",
    "normalize_answer": f"SELECT doc_id, md5({norm('text')}) AS normal_md5 FROM documents",
    "exact_match_turns": f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN {norm('prediction')} = {norm('gold')} THEN 1.0::DOUBLE ELSE 0.0 END AS em FROM pair",
    "token_f1_turns": f"WITH {PAIRS}, toks AS (SELECT conv_id, turn, {tokens('prediction')} AS p, {tokens('gold')} AS g FROM pair) SELECT conv_id, turn, round({f1('p', 'g')}, 6) AS f1 FROM toks",
    "lexical_overlap_turns": f"WITH {PAIRS}, s AS (SELECT conv_id, turn, {token_set('gold')} AS q, {token_set('prediction')} AS x FROM pair) SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, x))::DOUBLE / len(q) END, 6) AS overlap FROM s",
    "abstention_turns": f"SELECT conv_id, turn, role, {abstains('text')} AS abstained FROM conversations",
    "split_in_two": f"SELECT item_id, CASE WHEN len(w) < 2 THEN left(text, greatest(1, length(text) // 2)) ELSE array_to_string(list_slice(w, 1, len(w) // 2), ' ') END AS a, CASE WHEN len(w) < 2 THEN substring(text, greatest(1, length(text) // 2) + 1) ELSE array_to_string(list_slice(w, len(w) // 2 + 1, len(w)), ' ') END AS b FROM (SELECT item_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM benchmark)",
    "char_ngram_counts": f"SELECT item_id, CASE WHEN t = '' THEN 0 WHEN length(t) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) END::INT AS grams FROM (SELECT item_id, {strip(squeeze("lower(coalesce(text, ''))"))} AS t FROM benchmark)",
    "qa_chunk_round_robin": f"WITH {GOOD} SELECT slot::INT AS slot, chunk_id, turn::INT AS turn FROM slotted",
    "difficulty_allocation": "SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, '{d}', {c}::BIGINT)" for n, e, m, h in ((1, 1, 0, 0), (2, 1, 1, 0), (7, 3, 3, 1), (33, 13, 13, 7), (100, 40, 40, 20), (500, 200, 200, 100), (1000, 400, 400, 200)) for d, c in (("easy", e), ("medium", m), ("hard", h))) + ") v(total, difficulty, n)",
    "difficulty_schedule": f"WITH {SCHEDULE} SELECT slot::INT AS slot, difficulty FROM schedule",
    "candidate_rows": f"WITH {CANDIDATES} SELECT candidate_id, slot::INT AS slot, difficulty, answer_type, gold_answer, question, chunk_id FROM candidate",
    "rule_reasons": f"WITH {RESULTS} SELECT candidate_id, rules AS reasons, regexp_matches(lower(question), '^(who|which|what)') AND answer_type IN ('person', 'organization') AND contains(supporting_sentence, ' and ') AND NOT contains(lower(gold_answer), ' and ') AS multiple FROM ruled",
    "uniqueness_flags": f"WITH {MIXED} SELECT candidate_id, multiple FROM flagged",
    "quality_scores": f"WITH {MIXED} SELECT candidate_id, {_score('rule_ok', 'NOT multiple')} AS quality_score, {_JUDGED} AS judged_good FROM flagged",
    "layer_contribution": f"""WITH {MIXED}, parts AS (SELECT list_filter([CASE WHEN NOT rule_ok THEN 'rule_checks' END, CASE WHEN ran AND NOT {_JUDGED} THEN 'llm_judge' END, CASE WHEN NOT baseline_correct THEN 'baseline_test' END,
  CASE WHEN {_score('rule_ok', 'true')} < 0.85 AND n % 2 = 0 THEN 'quality_threshold' END, CASE WHEN n % 23 = 0 THEN 'deduplication' END], lambda c: c IS NOT NULL) AS c FROM flagged)
SELECT component, count(*) AS rejected, count(*) FILTER (alone) AS unique_rejections FROM (SELECT unnest(c) AS component, len(c) = 1 AS alone FROM parts) GROUP BY component""",
    "rejection_reason_counts": f"WITH {RESULTS} SELECT {_COMPONENT} AS component, r AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS r FROM result WHERE reasons <> '') GROUP BY ALL",
    "pages_by_category": f"WITH {REJECTED} SELECT coalesce(category_group, 'unknown') AS value, count(*) AS n FROM page WHERE page_id NOT IN (SELECT page_id FROM rejected) GROUP BY ALL",
    "alternate_answers": f"""WITH g AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '([^\\s]*[^\\s\\d]?\\d+(?:\\.\\d+)?[^\\s]*)', 1) AS gold, (doc_id % 2000 / 8 + 0.0625)::DOUBLE::VARCHAR AS small FROM documents)
SELECT doc_id, {alternate('gold', "'numeric'", keyed('42', 'doc_id'))} AS counted, {alternate('small', "'other'", keyed('42', 'doc_id'))} AS raised, {alternate('gold', "'date'", keyed('42', 'doc_id'))} AS dated FROM g WHERE gold <> ''""",
    "gram_similarity_turns": f"""WITH {PAIRS}, n AS (SELECT conv_id, turn, {gram_text('gold')} AS tg, {gram_text('prediction')} AS tp FROM pair), s AS (SELECT conv_id, turn, {grams('tg')} AS a, {grams('tp')} AS b FROM n)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM s""",
    "validation_results": f"WITH {RESULTS} SELECT candidate_id, accepted, quality_score::DOUBLE AS quality_score, reasons FROM result",
    "validation_contribution": f"""WITH {RESULTS}, part AS (SELECT list_distinct(list_transform(string_split(reasons, ','), lambda r: {_COMPONENT})) AS c FROM result WHERE NOT accepted)
SELECT component, count(*) AS rejected, count(*) FILTER (alone) AS unique_rejections FROM (SELECT unnest(c) AS component, len(c) = 1 AS alone FROM part) GROUP BY component""",
    "question_dedup": f"WITH {CANDIDATES}, {FIRST_WINS} SELECT candidate_id, more IS NULL AS kept, coalesce(more, '') AS reasons FROM every LEFT JOIN repeated USING (candidate_id)",
    "rejected_anti_join": f"WITH {RESULTS} SELECT candidate_id FROM result WHERE NOT accepted",
    "seed_selection": f"WITH {SEEDS} SELECT sample_id, candidate_id, category_group, difficulty, quality_score::DOUBLE AS quality_score FROM seed",
    "inject_missing_evidence": case_rows(MISSING, "missing_evidence", False),
    "inject_context_noise": case_rows(NOISE, "context_noise", True),
    "inject_evidence_position": case_rows(POSITION, "evidence_position", True, "round(pos / greatest(len(fillers), 1), 3)"),
    "inject_hard_negative": case_rows(NEGATIVE, "hard_negative", False, "mean"),
    "inject_chunk_boundary": case_rows(BOUNDARY, "chunk_boundary", True),
    "inject_conflict": case_rows(CONFLICT, "conflict", True),
    "clean_contexts": CLEAN,
    "turn_metrics_by_condition": f"WITH {_TURNS} SELECT model_name, condition, {_METRICS} FROM res GROUP BY ALL",
    "turn_metrics_by_severity": f"WITH {_TURNS} SELECT model_name, condition, severity, {_METRICS} FROM res WHERE condition <> 'clean' AND severity IS NOT NULL GROUP BY ALL",
    "turn_performance_drop": f"WITH {_TURNS}, m AS (SELECT model_name, condition, {_METRICS} FROM res GROUP BY ALL) SELECT m.model_name, m.condition, m.accuracy, round(coalesce(c.accuracy, 0.0) - m.accuracy, 4) AS performance_drop FROM m LEFT JOIN (SELECT * FROM m WHERE condition = 'clean') c USING (model_name) WHERE m.condition <> 'clean'",
    "model_merge": "WITH e AS (SELECT role || '-' || (conv_id % 3) AS model_name, conv_id, turn FROM conversations), n AS (SELECT upper(model_name) AS model_name, conv_id, turn + 1000 AS turn FROM e WHERE conv_id % 3 = 1 AND turn = 0) SELECT * FROM e WHERE lower(model_name) NOT IN (SELECT lower(model_name) FROM n) UNION ALL SELECT * FROM n",
    "stability_mean_std": f"WITH {RUNS}, long AS (UNPIVOT run ON {', '.join(_RATES)} INTO NAME metric VALUE v) SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(CASE WHEN count(v) = 1 THEN 0.0 ELSE stddev_samp(v) END, 6) AS std FROM long GROUP BY metric",
    "human_rates": "SELECT count(quality) AS n, round(avg((quality = 1)::INT), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id)",
    "label_distribution": "SELECT coalesce(quality::VARCHAR, 'unknown') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
}
