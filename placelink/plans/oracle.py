"""The score of a pair as DuckDB SQL, for checking the engine on the driver's tables.

``scored(src)`` continues a WITH clause that has ``src`` (id, query, result) up to ``final`` (id, score).
It holds for ASCII names of one or two words. Of the rungs,
equal stems are those of a word and its plural in -s, and equal phonetic codes are left out: no pair
of the driver's tables needs more (``tests/core/test_oracle.py`` holds that).
"""

from __future__ import annotations

from placelink.lexicons import DEFAULT


def list_of(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


def map_of(table: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"'{k}': {'[' + ', '.join(repr(w) for w in v) + ']'}" for k, v in table.items()) + "}"


CLEAN = r"""trim(regexp_replace(regexp_replace({x}, '[/|\\\-.,"''‘’“”()\[\]#;:!?{{}}]', ' ', 'g'), '\s+', ' ', 'g'))"""
ABBREVIATED = {k: [w for place in v for w in place.split()] for k, v in DEFAULT.abbreviations.items()}
ALTERNATE = {k: v.split() for k, v in DEFAULT.alternates.items()}
_PLACE_WORDS = {w for table in (ABBREVIATED, ALTERNATE) for words in table.values() for w in words}


def _unique(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _expanded(x: str, table: dict[str, list[str]]) -> str:
    return f"list_concat({x}, flatten(list_transform(list_filter({x}, lambda x: list_contains({list_of(table)}, x)), lambda x: {map_of(table)}[x])))"


def garbage(x: str) -> str:
    words = f"string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ')"
    return f"(trim({x}) = '' OR list_contains({list_of(DEFAULT.garbage)}, trim({x})) OR len(list_filter({words}, lambda x: NOT (list_contains({list_of(DEFAULT.garbage)}, x) OR regexp_full_match(x, '\\d+')))) = 0)"


#: Evidence between the tokens q and r of ``pairs``, whose other columns stay; e means a DOUBLE.
EVIDENCE = f"""measured AS (SELECT *, jaro_winkler_similarity(q, r) AS jw, levenshtein(q, r) AS apart, length(r) / length(q) AS share, length(r) >= 4 AND contains(q, r) AS inside,
    starts_with(q, r) OR ends_with(q, r) AS edge, least(length(q), length(r)) / greatest(length(q), length(r)) AS alike,
    coalesce(list_contains({map_of(ABBREVIATED)}[q], r), false) AS short, coalesce(list_contains({map_of(ALTERNATE)}[q], r), false) AS other FROM pairs),
named AS (SELECT *, CASE WHEN q = r THEN 'exact' WHEN short THEN 'abbreviation' WHEN other THEN 'alternate_name'
    WHEN least(length(q), length(r)) >= 4 AND (q = concat(r, 's') OR r = concat(q, 's')) AND right(least(q, r), 1) <> 's' THEN 'stem'
    WHEN NOT (inside AND (edge OR share < 0.75e0)) AND NOT (length(q) <= 2 AND length(r) >= 4) AND jw >= 0.82e0 THEN 'fuzzy'
    WHEN inside THEN 'substring_result_in_query' WHEN length(q) >= 4 AND contains(r, q) THEN 'substring_query_in_result' ELSE 'none' END AS method FROM measured),
evidence AS (SELECT *, q = r OR short OR other OR jw >= 0.82e0 AS same, CASE WHEN method = 'substring_result_in_query' THEN round(share, 4) END AS ratio,
    CASE method WHEN 'exact' THEN 1e0 WHEN 'abbreviation' THEN 0.88e0 WHEN 'alternate_name' THEN 0.82e0 WHEN 'stem' THEN 0.7e0
    WHEN 'fuzzy' THEN least(greatest(jw * 0.91e0, [1e0, 0.88e0, 0.75e0, 0.55e0][least(apart, 3) + 1] * 0.9e0) * CASE WHEN apart = 1 AND jw >= 0.9e0 THEN 1e0 ELSE 0.7e0 + 0.3e0 * alike END, [0.95e0, 0.9e0, 0.82e0, 0.75e0][least(apart, 3) + 1])
    WHEN 'substring_result_in_query' THEN CASE WHEN edge THEN least(0.65e0 * share * 1.6e0, 0.58e0) ELSE least(0.65e0 * share * CASE WHEN share > 0.75e0 THEN 1e0 WHEN share > 0.5e0 THEN 0.75e0 ELSE 0.45e0 END, 0.45e0) END
    WHEN 'substring_query_in_result' THEN least(0.65e0 * length(q) / length(r), 0.4e0) ELSE 0e0 END AS score FROM named)"""

_CODE = "regexp_matches(x, '^[a-z]\\d+|^\\d+[a-z]+$')"
_KNOWN = f"list_contains({list_of(ABBREVIATED)}, x)"
_TOKENS = f"""folded AS (SELECT id, lower(strip_accents(query)) AS nq, lower(strip_accents(result)) AS nr FROM src),
listed AS (SELECT id, {garbage("nq")} OR {garbage("nr")} AS waste, trim(nq) = trim(nr) AS equal,
    list_filter(string_split({CLEAN.format(x="nq")}, ' '), lambda x: x <> '') AS words, list_filter(string_split({CLEAN.format(x="nr")}, ' '), lambda x: x <> '' AND (length(x) >= 2 OR {_KNOWN})) AS name FROM folded),
kept AS (SELECT *, list_filter(words, lambda x: NOT regexp_full_match(x, '\\d+') AND ({_KNOWN} OR length(x) >= 2 AND NOT {_CODE})) AS raw FROM listed),
chosen AS (SELECT *, list_filter(raw, lambda x: NOT list_contains({list_of(DEFAULT.address_stopwords)}, x) OR list_contains(name, x) OR list_contains({list_of(DEFAULT.directions)}, x)) AS q0, list_filter(name, lambda x: NOT list_contains({list_of(DEFAULT.result_stopwords)}, x)) AS r0 FROM kept),
single AS (SELECT id, waste, equal, words, raw, {_unique("q0")} AS qt, {_unique("r0")} AS rt FROM chosen),
once AS (SELECT *, {_expanded("qt", ABBREVIATED)} AS e0 FROM single),
twice AS (SELECT * EXCLUDE (e0), {_unique("e0")} AS e1 FROM once),
thrice AS (SELECT * EXCLUDE (e1), {_expanded("e1", ALTERNATE)} AS e2 FROM twice),
tokens AS (SELECT * EXCLUDE (e2), {_unique("e2")} AS e, len(list_filter(words, lambda x: list_contains({list_of(DEFAULT.admin_words)}, x) AND NOT list_contains(qt, x))) AS admin FROM thrice),
pairs AS (SELECT a.id, a.i, a.q, b.j, b.r, b.m FROM (SELECT id, unnest(e) AS q, generate_subscripts(e, 1) AS i FROM tokens) a JOIN (SELECT id, unnest(rt) AS r, generate_subscripts(rt, 1) AS j, len(rt) AS m FROM tokens) b USING (id))"""

_ONE = """best AS (SELECT id, first({'score': score, 'method': method, 'ratio': ratio} ORDER BY score DESC, i) AS b FROM evidence WHERE m = 1 GROUP BY id),
one AS (SELECT id, coalesce(b.method = 'substring_result_in_query' AND b.ratio >= 0.55e0 AND least((1 + b.ratio) / 2, 0.85e0) > b.score, false) AS elevated, b.score AS plain, least((1 + b.ratio) / 2, 0.85e0) AS high FROM best)"""

_TWO = f"""first_ AS (SELECT id, i, score, same, q = r AS equal, CASE WHEN q = r THEN 1e0 ELSE jw END AS jq FROM evidence WHERE m = 2 AND j = 1),
second_ AS (SELECT id, i, score, same, q = r AS equal, CASE WHEN q = r THEN 1e0 ELSE jw END AS jq FROM evidence WHERE m = 2 AND j = 2),
lead AS (SELECT id, min(i) FILTER (WHERE same) AS f1, first(i ORDER BY jq DESC, i) AS u1, max(jq) AS v1, max(score) AS b1 FROM first_ GROUP BY id),
follow AS (SELECT s.id, min(s.i) FILTER (WHERE s.same AND s.i > f1) AS f2, first(s.i ORDER BY s.jq DESC, s.i) FILTER (WHERE s.i <> u1) AS u2, max(s.jq) FILTER (WHERE s.i <> u1) AS v2, max(s.score) AS b2 FROM second_ s JOIN lead USING (id) GROUP BY s.id),
windowed AS (SELECT a.id, bool_or(a.equal AND b.equal) AS whole, first(least(a.score, b.score) ORDER BY a.i) AS near FROM first_ a JOIN second_ b ON a.id = b.id AND b.i = a.i + 1 WHERE a.same AND b.same GROUP BY a.id),
direct AS (SELECT id, bool_or(gone) AS gone FROM (SELECT id, j, list_contains({list_of(DEFAULT.directions)}, any_value(r)) AND NOT bool_or(q = r OR jw >= 0.82e0) AS gone FROM evidence WHERE m = 2 GROUP BY id, j) GROUP BY id),
parts AS (SELECT id, CASE WHEN whole THEN 1e0 ELSE coalesce(near, 0e0) END AS contiguous, f2 - f1 - 1 AS gaps, (a.jq + b.jq) / 2 AS mean, CASE WHEN v1 >= 0.82e0 AND v2 >= 0.82e0 AND u1 > u2 THEN (1e0 - 0.05e0) * ((v1 + v2) / 2) ELSE 0e0 END AS unordered,
    ((b1 > 0)::INT + (b2 > 0)::INT) AS hits, b1 + b2 AS total, gone FROM lead JOIN follow USING (id) JOIN direct USING (id) LEFT JOIN windowed USING (id) LEFT JOIN first_ a ON a.id = lead.id AND a.i = f1 LEFT JOIN second_ b ON b.id = lead.id AND b.i = f2),
ordered AS (SELECT *, CASE WHEN gaps IS NULL THEN 0e0 WHEN gaps = 0 THEN mean ELSE (1e0 - least(gaps * 0.3e0, 0.65e0)) * mean END AS in_order, CASE WHEN hits = 0 THEN 0e0 ELSE hits / 2 * (total / hits) END AS partial FROM parts),
limited AS (SELECT *, least(partial, CASE WHEN in_order > 0 AND gaps > 0 THEN in_order ELSE 9e0 END, CASE WHEN unordered > 0 THEN unordered ELSE 9e0 END) AS covered FROM ordered),
joined AS (SELECT t.id, CASE WHEN len(e) <> 1 THEN 0e0 WHEN e[1] = array_to_string(rt, '') THEN 0.85e0 WHEN length(array_to_string(rt, '')) >= 4 AND jaro_winkler_similarity(e[1], array_to_string(rt, '')) >= 0.9e0 THEN 0.85e0 * jaro_winkler_similarity(e[1], array_to_string(rt, '')) ELSE 0e0 END AS compound, len(list_filter(e, lambda x: list_contains({list_of(DEFAULT.directions)}, x))) > 0 AS any_way FROM tokens t),
two AS (SELECT l.id, round(contiguous, 4) AS contiguous, greatest(contiguous, in_order, unordered, covered, compound) * CASE WHEN NOT gone THEN 1e0 WHEN any_way THEN 1e0 - 0.15e0 ELSE 0.9e0 END AS value FROM limited l JOIN joined USING (id))"""

_COLLIDES = f"list_contains({list_of(DEFAULT.collisions)}, array_to_string(rt, ' '))"
_EXTRA = f"len(list_filter(qt, lambda x: x <> rt[1] AND length(x) < 7 AND NOT list_contains({list_of({*DEFAULT.address_stopwords, *DEFAULT.directions, *_PLACE_WORDS, *ABBREVIATED, *ALTERNATE})}, x)))"
_PENALTIES = f"""raw_score AS (SELECT t.*, coalesce(CASE WHEN len(rt) = 1 THEN CASE WHEN elevated THEN high ELSE plain END ELSE value END, 0e0) AS s0, coalesce(elevated, false) AS elevated, contiguous,
    list_filter(e, lambda x: contains(x, rt[1]) AND x <> rt[1])[1] AS holder FROM tokens t LEFT JOIN one USING (id) LEFT JOIN two USING (id)),
deep AS (SELECT *, CASE WHEN len(rt) = 1 AND s0 >= 0.35e0 AND NOT list_contains(e, rt[1]) AND holder IS NOT NULL AND NOT starts_with(holder, rt[1]) AND NOT ends_with(holder, rt[1]) AND NOT elevated THEN s0 * CASE WHEN length(rt[1]) / length(holder) < 0.65e0 THEN 0.3e0 ELSE 0.55e0 END ELSE s0 END AS s1 FROM raw_score),
missed AS (SELECT *, CASE WHEN len(rt) = 1 AND s1 >= 0.45e0 AND NOT list_contains(e, rt[1]) AND length(rt[1]) >= 4 AND len(list_filter(e, lambda x: length(x) > length(rt[1]) AND NOT starts_with(x, rt[1]) AND NOT ends_with(x, rt[1]) AND levenshtein(x, rt[1]) = 1)) > 0 THEN s1 * 0.65e0 ELSE s1 END AS s2 FROM deep),
common AS (SELECT *, CASE WHEN len(list_filter(rt, lambda x: NOT list_contains(raw, x))) = 0 AND len(list_filter(rt, lambda x: list_contains({list_of(DEFAULT.collisions)}, x))) = 0 THEN s2
    WHEN {_COLLIDES} AND len(list_filter(rt, lambda x: list_contains(raw, x))) = 0 AND len(list_filter(rt, lambda x: length(x) >= 4 AND len(list_filter(raw, lambda y: starts_with(y, x) OR ends_with(y, x))) > 0)) = 0 THEN s2 * (1e0 - 0.7e0) ELSE s2 END AS s3 FROM missed),
capped AS (SELECT *, CASE WHEN len(list_filter(qt, lambda x: list_contains(rt, x))) > 0 OR len(list_filter(qt, lambda x: {_KNOWN} OR list_contains({list_of(ALTERNATE)}, x))) = 0 THEN s3
    WHEN len(list_filter(qt, lambda x: {_KNOWN})) = 0 AND len(list_filter(qt, lambda x: list_contains({list_of(ALTERNATE)}, x))) = len(qt) THEN least(s3, 0.82e0) ELSE least(s3, 0.88e0) END AS s4 FROM common),
noisy AS (SELECT *, CASE WHEN s4 < 0.9e0 THEN s4 WHEN len(rt) > 1 THEN CASE WHEN contiguous < 1 AND len(words) - len(rt) >= 4 THEN s4 * (1e0 - least((len(words) - len(rt) - 3) * 0.04e0, 0.2e0)) ELSE s4 END
    WHEN len(qt) > 1 AND list_contains(e, rt[1]) AND {_COLLIDES} AND {_EXTRA} >= 2 THEN s4 * (1e0 - 0.3e0) ELSE s4 END AS s5 FROM capped),
administrative AS (SELECT *, CASE WHEN admin > 0 AND s5 >= 0.9e0 THEN s5 * (1e0 - least(admin * 0.02e0, 0.04e0)) ELSE s5 END AS s6 FROM noisy),
final AS (SELECT id, CASE WHEN waste THEN 0e0 WHEN equal THEN 1e0 WHEN len(qt) = 0 OR len(rt) = 0 THEN 0e0 ELSE round(least(greatest(s6, 0e0), 1e0), 4) END AS score FROM administrative)"""


def scored(src: str) -> str:
    return ",\n".join([src, _TOKENS, EVIDENCE, _ONE, _TWO, _PENALTIES])
