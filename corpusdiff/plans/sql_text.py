"""SQL fragments that state the same definitions for the comparison engine (DuckDB dialect)."""

from __future__ import annotations

from corpusdiff.functions.text import alternation
from corpusdiff.plans.driver import DRIVER_RULES as R

WS = "[\\s\\x{0b}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
PUNCTUATION = "[，。、“”‘’《》（）()［］\\[\\]：:；;,.!?！？]"
TITLE_PUNCTUATION = "[\\-—–·・:：,，.。\"''“”‘’（）()《》【】［］\\[\\]、<>/]"
LIKELY = "[\\x{3400}-\\x{9fff}A-Za-z0-9]{2,18}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nt(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', '', 'g'), '{PUNCTUATION}', '', 'g')"


def nc(x: str) -> str:
    return f"lower({nt(x)})"


def na(x: str) -> str:
    return f"regexp_replace({nt(x)}, '[—－]', '-', 'g')"


def collapse(x: str) -> str:
    once = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({once}, '^{WS}+', ''), '{WS}+$', '')"


def entities(x: str) -> str:
    """The named entities that occur in the pages."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{value}')"
    return x


def normalize(x: str) -> str:
    return collapse(entities(x))


def strip_html(x: str) -> str:
    for pattern in (
        "(?i)<script\\b[^>]*>[\\s\\S]*?</script>", "(?i)<style\\b[^>]*>[\\s\\S]*?</style>", "(?i)<br\\s*/?>", "(?i)</p>", "<[^>]+>",
    ):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return normalize(x)


def paragraphs(x: str) -> str:
    bodies = f"regexp_extract_all({x}, '(?i)<p\\b[^>]*>([\\s\\S]*?)</p>', 1)"
    texts = f"list_filter(list_transform({bodies}, lambda p: {strip_html('p')}), lambda p: p <> '')"
    return f"CASE WHEN len({texts}) > 0 THEN {normalize(f'array_to_string({texts}, chr(32))')} ELSE {strip_html(x)} END"


def excerpt(x: str, max_chars: int) -> str:
    n = normalize(x)
    return (
        f"CASE WHEN length({n}) = 0 THEN '' WHEN length({n}) < 72 THEN '短文記事のため、全文相当の引用は表示しません。' "
        f"ELSE {trim(f'substr({n}, 1, least({max_chars - 1}, greatest(48, floor(length({n}) * 0.72)::int)))')} || '…' END"
    )


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def grams(x: str, n: int) -> str:
    """Distinct n-grams of an already normalised text; character arrays keep long texts linear."""
    joined = " || ".join(f"chars[i + {k}]" if k else "chars[i]" for k in range(n))
    return (
        f"(SELECT CASE WHEN len(chars) = 0 OR {x} = '' THEN []::varchar[] WHEN len(chars) <= {n} THEN [{x}] "
        f"ELSE list_distinct(list_transform(range(1, len(chars) - {n} + 2), lambda i: {joined})) END "
        f"FROM (SELECT string_split({x}, '') AS chars))"
    )


def in_list(x: str, values) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})" if values else "false"


def has_cue(x: str, cues) -> str:
    return f"regexp_matches({x}, {q(alternation(cues))})" if cues else "false"


def ordered_distinct(x: str, name: str = "s") -> str:
    return f"(SELECT list_filter({name}, lambda e, i: list_position({name}, e) = i) FROM (SELECT {x} AS {name}))"


def term_weight(x: str) -> str:
    return (
        f"CASE WHEN {in_list(x, R.generic_terms)} THEN 0.35::double WHEN {has_cue(x, R.military_cues + R.policy_cues)} THEN 1.2::double "
        f"ELSE least(1.0::double, greatest(0.45::double, length({x}) / 6.0::double)) END"
    )


def strength(terms: str, scale: str) -> str:
    return f"least(1.0::double, coalesce(list_sum(list_transform({terms}, lambda w: {term_weight('w')})), 0.0::double) / {scale}::double)"


def anchor_score(x: str) -> str:
    cases = [f"WHEN {x} = {q(a.canonical)} THEN {a.score}::double" for a in R.anchors]
    cases += [f"WHEN regexp_matches({x}, {q(p)}) THEN {s}::double" for p, s in R.anchor_score_patterns]
    return f"CASE {' '.join(cases)} ELSE {R.anchor_score_default}::double END"


def high_value(x: str) -> str:
    return f"(({anchor_score(x)}) >= 0.64 AND NOT {in_list(x, R.generic_judge_terms)})"


def strong_short(x: str) -> str:
    return f"(length({x}) >= 4 AND ({anchor_score(x)}) >= 0.9 AND NOT {in_list(x, R.generic_judge_terms)})"


def sort_terms(x: str) -> str:
    keyed = f"list_transform({x}, lambda z: {{'w': -({term_weight('z')}), 'n': -length(z), 't': z}})"
    return f"list_transform(list_sort({keyed}), lambda z: z.t)"


def hashed_date(x: str) -> str:
    digit = "(instr('0123456789abcdef', substr(md5({x}), {i}, 1)) - 1)"
    return f"(DATE '2024-01-01' + (({digit.format(x=x, i=1)} * 16 + {digit.format(x=x, i=2)}) % 64)::int)"


def named(rules, text: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches({text.format(p='')}, {q(p)}) THEN {q(n)} END" for n, p in rules)
    return f"list_filter([{found}], lambda m: m IS NOT NULL)"


ART = f"""art AS (
  SELECT cast(doc_id AS varchar) AS id, doc_id AS pos,
         CASE WHEN cast(regexp_extract(source, '^src([0-9]+)', 1) AS int) % 2 = 0 THEN 'left' ELSE 'right' END AS side,
         {hashed_date('title')} AS issue_date, (doc_id % 8 + 1)::int AS page_number, 'page ' || lang AS page_name,
         title, text, source AS author, concat_ws(' ', nullif(title, ''), nullif(text, '')) AS full_text
  FROM (SELECT *, trim(regexp_extract(text, '^[^.\\n]*')) AS title FROM documents))"""

CANON = f"""canon AS (
  SELECT *, {nt('title')} AS title_nt,
    regexp_replace(regexp_replace({collapse("regexp_replace(regexp_replace(nfc_normalize(title), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')")}, '{WS}+', '', 'g'), '{TITLE_PUNCTUATION}', '', 'g') AS ctitle,
    CASE WHEN page_number = 1 THEN 1.0::double WHEN page_number <= 3 THEN 0.8::double WHEN page_number <= 7 THEN 0.56::double ELSE 0.34::double END AS prominence
  FROM art)"""


def _anchor_rules() -> str:
    parts = ", ".join(
        f"CASE WHEN regexp_matches({'title' if a.headline_only else 'full_text'}, {q(a.pattern)}) THEN {q(a.canonical)} END" for a in R.anchors
    )
    events = f"list_filter(list_transform(regexp_extract_all(full_text, {q(R.event_pattern)}), lambda e: {na('e')}), lambda e: length(e) BETWEEN 4 AND 24 AND {high_value('e')})"
    return ordered_distinct(f"list_concat(list_filter([{parts}], lambda m: m IS NOT NULL), {events})")


def _families() -> str:
    parts = []
    for rule in R.topics:
        source = "head_na" if rule.field == "headline" else "full_na"
        parts.append(f"CASE WHEN {' AND '.join(f'regexp_matches({source}, {q(p)})' for p in rule.patterns)} THEN {q(rule.family)} END")
    return f"list_filter([{', '.join(parts)}], lambda m: m IS NOT NULL)"


_CUES = R.military_cues + R.policy_cues + R.slogan_cues
_NAMED = ", ".join(f"CASE WHEN regexp_matches(full_na, {q(p)}) THEN {q(n)} END" for n, p in R.scoring_anchors)

SIG = f"""{ART}, {CANON},
na AS (SELECT *, {na('full_text')} AS full_na, {na('title')} AS head_na FROM canon),
likely AS (
  SELECT *, list_concat(
      list_filter(list_transform(list_concat(list_filter([{_NAMED}], lambda m: m IS NOT NULL), regexp_extract_all(full_na, {q(R.scoring_event_pattern)})), lambda e: {nt('e')}),
                  lambda e: length(e) BETWEEN 4 AND 24 AND NOT {in_list('e', R.generic_terms)}),
      list_filter(list_transform(regexp_extract_all(full_text, '{LIKELY}'), lambda e: {nt('e')}), lambda e: length(e) >= 2 AND {has_cue('e', _CUES)})) AS raw_terms,
    {_anchor_rules()} AS anchors, {_families()} AS families
  FROM na),
terms AS (
  SELECT *, list_filter({ordered_distinct('raw_terms')}, lambda e: length(e) BETWEEN 2 AND 24) AS explicit FROM likely),
sig AS (
  SELECT id, pos, side, issue_date, page_number, title, ctitle, prominence, anchors, families, explicit, full_text,
    lower(title_nt) AS title_cmp,
    list_filter(explicit, lambda e: {has_cue('e', R.military_cues)}) AS military,
    list_filter(explicit, lambda e: {has_cue('e', R.policy_cues)}) AS policy,
    list_filter(explicit, lambda e: {has_cue('e', R.slogan_cues)} OR {in_list('e', R.generic_terms)}) AS slogan,
    {in_list('ctitle', R.ignorable_titles)} AS ignorable
  FROM terms)"""


def _keys() -> str:
    from corpusdiff.operators.signals import title_triggers

    triggers = title_triggers(R)
    held = ", ".join(f"CASE WHEN contains(ctitle, {q(x)}) THEN {q('H:' + x)} END" for x in triggers)
    title = f"CASE WHEN ctitle <> '' AND (length(ctitle) >= 6 OR regexp_matches(title, {q(alternation(triggers))})) THEN 'T:' || ctitle END"
    return f"list_distinct(list_filter(list_concat([{title}, {held}], list_transform(anchors, lambda a: 'A:' || a)), lambda k: k IS NOT NULL))"


KEYED = f"""{SIG}, keyed AS (SELECT *, {_keys()} AS keys FROM sig WHERE NOT ignorable)"""

_BEST = "priority DESC, l_pos, l_id, r_pos, r_id"

SCORED = f"""{KEYED},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY issue_date, side, title, full_text, prominence ORDER BY pos) AS copy_rank,
    first_value(id) OVER (PARTITION BY issue_date, side, title, full_text, prominence ORDER BY pos) AS rep,
    count(*) OVER (PARTITION BY issue_date, side, title, full_text, prominence) AS copies FROM keyed),
side_rows AS (SELECT *, {grams(nc('full_text'), 3)} AS text_grams, {grams('title_cmp', 2)} AS title_grams FROM numbered WHERE len(keys) > 0 AND copy_rank = 1),
joined AS (
  SELECT l.issue_date, l.id AS l_id, r.id AS r_id, l.pos AS l_pos, r.pos AS r_pos, l.page_number AS l_page, r.page_number AS r_page,
    l.title AS l_title, l.ctitle AS l_ctitle, r.ctitle AS r_ctitle, l.anchors AS l_anchors, r.anchors AS r_anchors,
    l.families AS l_families, r.families AS r_families, l.explicit AS le, r.explicit AS re, l.policy AS lp, r.policy AS rp,
    l.slogan AS ls, r.slogan AS rs, l.military AS lm, r.military AS rm, l.title_cmp AS lt, r.title_cmp AS rt,
    l.text_grams AS lg, r.text_grams AS rg, l.title_grams AS ltg, r.title_grams AS rtg, l.prominence AS lpr, r.prominence AS rpr, l.copies AS l_copies, r.copies AS r_copies
  FROM side_rows l JOIN side_rows r ON l.issue_date = r.issue_date AND l.side = 'left' AND r.side = 'right' AND list_has_any(l.keys, r.keys)),
s1 AS (
  SELECT * EXCLUDE (lg, rg, ltg, rtg), len(list_intersect(lg, rg)) AS tg, len(lg) + len(rg) AS tn, len(list_intersect(ltg, rtg)) AS hg, len(ltg) + len(rtg) AS hn,
    list_filter(le, lambda e: list_contains(re, e)) AS se, list_filter(lp, lambda e: list_contains(rp, e)) AS sp,
    list_filter(ls, lambda e: list_contains(rs, e)) AS ss, list_filter(lm, lambda e: list_contains(rm, e)) AS sm
  FROM joined),
s2 AS (
  SELECT *, CASE WHEN lt = '' OR rt = '' THEN 0.0::double WHEN lt = rt THEN 1.0::double WHEN contains(lt, rt) OR contains(rt, lt) THEN 0.84::double
       WHEN hn - hg = 0 THEN 0.0::double ELSE hg / (hn - hg)::double END AS title_sim,
    CASE WHEN tn - tg = 0 THEN 0.0::double ELSE tg / (tn - tg)::double END AS text_overlap,
    0.72::double + (lpr + rpr) / 2 * 0.28::double AS metadata,
    {strength('se', '5.0')} AS named, {strength('sp', '5.0')} AS policy_score, {strength('ss', '5.0')} * 0.72::double AS slogan_score,
    {sort_terms("list_distinct(list_concat(se, sp, ss, sm))")} AS shared_terms,
    {strength('lp', '6.0')} AS lps, {strength('rm', '6.0')} AS rms
  FROM s1),
s3 AS (SELECT *, least(1.0::double, title_sim * 0.55::double + text_overlap * 0.45::double) AS lexical,
    least(1.0::double, lps * 0.25::double + rms * 0.28::double + policy_score * 0.25::double + named * 0.22::double) AS bridge FROM s2),
s4 AS (SELECT *, least(1.0::double, named * 0.32::double + policy_score * 0.22::double + slogan_score * 0.16::double + bridge * 0.3::double) AS narrative FROM s3),
s5 AS (SELECT *, least(1.0::double, lexical * 0.38::double + narrative * 0.44::double + metadata * 0.18::double) AS confidence,
    len(list_filter(shared_terms, lambda e: NOT {in_list('e', R.generic_terms)})) > 0 AS meaningful FROM s4),
scored AS (
  SELECT *, CASE
      WHEN metadata >= 0.55 AND (title_sim >= 0.76 OR text_overlap >= 0.34) AND meaningful THEN 'same_event'
      WHEN bridge >= 0.46 AND (len(sp) > 0 OR meaningful) THEN 'policy_to_military'
      WHEN len(ss) > 0 AND lexical < 0.42 AND narrative >= 0.18 AND text_overlap < 0.2 THEN 'same_slogan_different_case'
      WHEN len(sp) > 0 AND narrative >= 0.24 THEN 'same_policy' ELSE 'uncertain' END AS match_type
  FROM s5)"""

# All left/right pairs of articles of a date, without blocking keys and with every copy.
ALL_PAIRS = (
    SCORED.replace(" WHERE len(keys) > 0 AND copy_rank = 1)", ")")
    .replace("FROM sig WHERE NOT ignorable)", "FROM sig)")
    .replace(" AND list_has_any(l.keys, r.keys)", "")
    .replace("SELECT l.issue_date, l.id AS l_id", "SELECT l.copy_rank AS l_rank, r.copy_rank AS r_rank, l.issue_date, l.id AS l_id")
)

# Longest common part of at least five characters: the longest run of equal 5-grams on one diagonal.
PHRASED = f"""{SCORED},
uneven AS (SELECT DISTINCT l_ctitle, r_ctitle FROM scored WHERE l_ctitle <> r_ctitle),
lgrams AS (SELECT l_ctitle AS t, unnest(range(1, length(l_ctitle) - 3)) AS i FROM (SELECT DISTINCT l_ctitle FROM uneven)),
rgrams AS (SELECT r_ctitle AS t, unnest(range(1, length(r_ctitle) - 3)) AS j FROM (SELECT DISTINCT r_ctitle FROM uneven)),
hits AS (
  SELECT u.l_ctitle, u.r_ctitle, i, i - j AS diagonal FROM uneven u
  JOIN (SELECT t, i, substr(t, i, 5) AS g FROM lgrams) l ON l.t = u.l_ctitle
  JOIN (SELECT t, j, substr(t, j, 5) AS g FROM rgrams) r ON r.t = u.r_ctitle AND r.g = l.g),
runs AS (
  SELECT l_ctitle, r_ctitle, min(i) AS start, count(*) + 4 AS n FROM (
    SELECT *, i - row_number() OVER (PARTITION BY l_ctitle, r_ctitle, diagonal ORDER BY i) AS island FROM hits)
  GROUP BY l_ctitle, r_ctitle, diagonal, island),
phrases AS (
  SELECT l_ctitle, r_ctitle, substr(l_ctitle, start, n) AS common FROM runs
  QUALIFY row_number() OVER (PARTITION BY l_ctitle, r_ctitle ORDER BY n DESC, start) = 1),
p1 AS (
  SELECT s.*, CASE WHEN s.l_ctitle <> '' AND s.l_ctitle = s.r_ctitle THEN {trim('l_title')}
      WHEN common IS NOT NULL AND NOT {in_list('common', R.generic_judge_terms)} THEN common END AS phrase,
    list_filter(l_families, lambda e: list_contains(r_families, e))[1] AS topic_family
  FROM scored s LEFT JOIN phrases p ON s.l_ctitle = p.l_ctitle AND s.r_ctitle = p.r_ctitle)"""


def _by_score(x: str, longer: bool = False) -> str:
    n = "-length(z)" if longer else "0"
    return f"list_transform(list_sort(list_transform({x}, lambda z, zi: {{'s': -({anchor_score('z')}), 'n': {n}, 'i': zi, 't': z}})), lambda z: z.t)"


def _useful(x: str) -> str:
    return f"(length(trim({x})) >= 2 AND NOT {in_list(x, R.generic_judge_terms)})"


_SHARED_ANCHORS = _by_score(f"list_filter(l_anchors, lambda e: list_contains(r_anchors, e) AND {_useful('e')})")

CANDIDATES = f"""{PHRASED},
c1 AS (SELECT *, {ordered_distinct(f"list_concat(CASE WHEN phrase IS NULL THEN []::varchar[] ELSE [phrase] END, {_SHARED_ANCHORS})")} AS direct_terms FROM p1),
c2 AS (
  SELECT *, {ordered_distinct(f"list_concat(direct_terms, list_filter(shared_terms, lambda e: {_useful('e')}))")} AS useful_terms,
    greatest(0.0::double, least(1.0::double, coalesce(list_sum(list_transform(direct_terms, lambda e: {anchor_score('e')})), 0.0::double) / 2)) AS anchor_score,
    coalesce({_by_score('direct_terms', True)}[1], '') AS strongest
  FROM c1),
c3 AS (
  SELECT *, CASE
      WHEN l_ctitle <> '' AND l_ctitle = r_ctitle AND (length(l_ctitle) >= 8 OR (length(l_ctitle) >= 6 AND lexical >= 0.82 AND metadata >= 0.72)) THEN 'exact'
      WHEN (length(strongest) >= 6 OR {strong_short('strongest')}) AND (confidence >= 0.2 OR {strong_short('strongest')}) AND {high_value('strongest')} THEN 'strong_phrase' END AS title_kind
  FROM c2),
c4 AS (
  SELECT *, len(list_filter(useful_terms, lambda e: {high_value('e')})) > 0 AS has_high_value,
    {_by_score(f"list_filter(direct_terms, lambda e: {in_list('e', R.clusterable)})")}[1] AS best_anchor,
    length(l_ctitle) >= 8 AND NOT {in_list('l_ctitle', R.generic_judge_terms)} AS l_specific,
    length(r_ctitle) >= 8 AND NOT {in_list('r_ctitle', R.generic_judge_terms)} AS r_specific
  FROM c3),
cand AS (
  SELECT *, CASE WHEN title_kind = 'exact' THEN 3.0::double WHEN title_kind = 'strong_phrase' THEN 1.4::double ELSE 0.0::double END
      + CASE WHEN topic_family IS NOT NULL THEN 0.12::double ELSE 0.0::double END + anchor_score * 1.6::double + confidence + least(len(useful_terms), 8) * 0.04::double AS priority,
    CASE WHEN title_kind = 'exact' THEN 1 WHEN title_kind = 'strong_phrase' OR anchor_score >= 0.78 THEN 2 ELSE 3 END AS tier,
    len(useful_terms) > 0 OR title_kind IS NOT NULL AS eligible,
    CASE WHEN title_kind = 'exact' THEN 'exact-title:' || l_ctitle WHEN best_anchor IS NOT NULL THEN 'anchor:' || {na('best_anchor')}
      WHEN l_specific AND r_specific THEN 'title-pair:' || l_ctitle || ':' || r_ctitle WHEN r_specific THEN 'right-title:' || r_ctitle
      WHEN l_specific THEN 'left-title:' || l_ctitle END AS cluster_key
  FROM c4
  WHERE (topic_family IS NOT NULL OR title_kind IS NOT NULL OR len(useful_terms) > 0 OR confidence >= 0.2)
    AND (title_kind IS NOT NULL OR topic_family IS NOT NULL OR anchor_score >= 0.42 OR has_high_value OR confidence >= 0.1)),
pool AS (SELECT *, 'pair:' || l_id || ':' || r_id AS pair_id FROM cand)"""

# The daily report: all article pairs, of which each date keeps the first ones in order of admission.
TOP = f"""{CANDIDATES.replace(' AND copy_rank = 1', '').rpartition(',' + chr(10) + 'pool AS')[0]},
o1 AS (
  SELECT *, row_number() OVER (PARTITION BY issue_date, l_id, eligible ORDER BY {_BEST}) AS ln, row_number() OVER (PARTITION BY issue_date, r_id, eligible ORDER BY {_BEST}) AS rn,
    min({{'a': l_pos, 'b': l_id}}) OVER (PARTITION BY issue_date, r_id, eligible) AS seen
  FROM cand),
o2 AS (
  SELECT *, CASE WHEN tier < 3 THEN tier WHEN eligible AND ln <= 3 THEN 3 WHEN eligible AND rn <= 3 THEN 4 ELSE 5 END AS step FROM o1),
o3 AS (
  SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY step,
      CASE WHEN step = 3 THEN {{'a': l_pos, 'b': l_id, 'c': 0, 'd': '', 'n': ln}} WHEN step = 4 THEN {{'a': seen.a, 'b': seen.b, 'c': r_pos, 'd': r_id, 'n': rn}} END, {_BEST}) AS pool_order
  FROM o2),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY issue_date ORDER BY {_BEST}) AS pool_rank, 'pair:' || l_id || ':' || r_id AS pair_id
  FROM o3 WHERE pool_order <= 96)"""

# The decision on the best labelled copies of two classes holds for the pair of classes.
_DECIDED = """
lab AS (
  SELECT rep, quality, toxic FROM (
    SELECT n.rep, l.quality, l.toxic, row_number() OVER (PARTITION BY n.rep ORDER BY l.quality DESC, l.toxic, n.pos) AS k FROM numbered n JOIN labels l ON l.doc_id = n.pos)
  WHERE k = 1),
dec AS (
  SELECT p.pair_id, l.quality = 1 AND r.quality = 1 AS matched, 100.0::double - 40 * greatest(l.toxic, r.toxic) AS dconf
  FROM pool p JOIN lab l ON l.rep = p.l_id JOIN lab r ON r.rep = p.r_id)"""

ACCEPTED = f"""{CANDIDATES}, {_DECIDED},
a1 AS (
  SELECT p.*, d.matched, d.dconf, bool_or(d.matched IS NOT NULL) OVER (PARTITION BY issue_date) AS judged,
    title_kind IS NOT NULL OR (anchor_score >= 0.72 AND has_high_value) AS concrete
  FROM pool p LEFT JOIN dec d ON p.pair_id = d.pair_id),
a2 AS (
  SELECT *, CASE WHEN title_kind = 'exact' THEN greatest(0.92::double, CASE WHEN matched THEN dconf / 100 ELSE 0 END)
      WHEN title_kind = 'strong_phrase' THEN greatest(0.84::double, CASE WHEN matched THEN dconf / 100 ELSE 0 END)
      WHEN matched THEN dconf / 100 WHEN anchor_score >= 0.78 THEN greatest(0.72::double, confidence) ELSE confidence END AS accepted_confidence
  FROM a1
  WHERE title_kind = 'exact' OR (title_kind = 'strong_phrase' AND has_high_value)
    OR (coalesce(matched, false) AND dconf >= 70 AND concrete) OR (NOT coalesce(judged, false) AND concrete)),
a3 AS (
  SELECT *, bool_or(coalesce(title_kind = 'exact', false)) OVER (PARTITION BY issue_date, l_id) AS lx,
    bool_or(coalesce(title_kind = 'exact', false)) OVER (PARTITION BY issue_date, r_id) AS rx
  FROM a2),
accepted AS (SELECT * FROM a3 WHERE coalesce(title_kind = 'exact', false) OR NOT (lx AND rx AND l_ctitle <> r_ctitle))"""

TITLE_GROUPS = f"""{ART}, {CANON},
tr AS (
  SELECT *, (row_number() OVER (PARTITION BY issue_date, ctitle, side ORDER BY pos) - 1) // 2 AS part
  FROM canon WHERE length(ctitle) >= 8 AND NOT {in_list('ctitle', R.ignorable_titles)}),
tg AS (
  SELECT issue_date, ctitle, part,
    list_transform(list_sort(list({{'p': page_number, 'i': id}}) FILTER (side = 'left')), lambda z: z.i) AS l,
    list_transform(list_sort(list({{'p': page_number, 'i': id}}) FILTER (side = 'right')), lambda z: z.i) AS r
  FROM tr GROUP BY ALL HAVING count(*) FILTER (side = 'left') > 0 AND count(*) FILTER (side = 'right') > 0),
groups AS (SELECT *, 'matched:' || array_to_string(l, '+') || ':' || array_to_string(r, '+') AS group_id FROM tg),
members AS (
  SELECT issue_date, group_id, 'left' AS side, unnest(l) AS article_id FROM groups
  UNION ALL SELECT issue_date, group_id, 'right', unnest(r) FROM groups),
links AS (
  SELECT issue_date, group_id, l_article, unnest(r) AS r_article FROM (SELECT issue_date, group_id, unnest(l) AS l_article, r FROM groups))"""
