"""SQL that states the same rows as the queries over spans, screens, morphemes and forms."""

from __future__ import annotations

from .. import vocab as V
from . import samples as S

RE2 = lambda p: p.replace("\\z", "$").replace("'", "''")
FOLD = lambda c: f"lower(translate({c}, '{V.WIDE}', '{V.NARROW}'))"
TRIM = lambda c: f"regexp_replace({c}, '^[{V.JS_SPACE}]+|[{V.JS_SPACE}]+$', '', 'g')"
HAS = lambda c, p: f"regexp_matches({c}, '{RE2(p)}')"
JUDGE = f"""CASE WHEN n = '' THEN 'empty' WHEN contains(n, '@') THEN 'at-mark' WHEN {HAS('n', '[0-9]')} THEN 'digit'
    WHEN length(n) + length(regexp_replace(n, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) >= {V.LONG_TEXT} THEN 'long-text'
    WHEN n IN ({', '.join(f"'{x}'" for x in V.LABELS)}) THEN 'allowlist' WHEN {HAS('r', V.NAME_LIKE)} THEN 'jp-name-like'
    WHEN {HAS('r', V.ASCII_WORD)} THEN 'ascii-word' ELSE 'unknown' END"""
WORD = "[^ \\t\\r\\x0B\\f]+"
DROPPED = lambda c: FOLD(f"regexp_replace({c}, '[{V.PHRASE_DROP}]+', '', 'g')")
TEXT = lambda values: ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def spans(source: str, terms: tuple[str, ...] = (), labels: tuple[str, ...] = (), line: bool = True, metric: bool = False) -> str:
    """``WITH`` clauses that end in ``flagged``: the rows of ``source`` (``k1, k2, k3, unit_idx, text, vis``, more) with
    ``line_reason, unit_metric, user_kept, label_kept``. Every place of a block is looked at by itself."""
    keys = "k1, k2, k3"
    pieces = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS ord, '{reason}' AS reason, string_split(regexp_replace(jf, '{RE2(p)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM blocks WHERE {HAS('jf', p)}"
        for i, (reason, p) in enumerate(V.LINE_PATTERNS)
    )
    before = V.METRIC_BEFORE[len("(?<!") : -1]

    def phrases(name: str, values: tuple[str, ...], whole: bool) -> str:
        if not values:
            return f"{name} AS (SELECT {keys}, unit_idx FROM o WHERE false)"
        return f"""{name}_of AS (SELECT DISTINCT p FROM (SELECT {DROPPED('v')} AS p FROM (VALUES {TEXT(values)}) t(v)) WHERE p <> ''),
        {name}_at AS (SELECT {keys}, jp, p, unnest(range(0, length(jp) - length(p) + 1)) AS i FROM blocks JOIN {name}_of ON contains(jp, p)),
        {name}_held AS (SELECT DISTINCT {keys}, unnest(range(i, i + length(p))) AS pos FROM {name}_at WHERE substr(jp, i + 1, length(p)) = p),
        {name} AS (SELECT o.k1, o.k2, o.k3, o.unit_idx FROM o JOIN {name}_held c ON o.k1 = c.k1 AND o.k2 = c.k2 AND o.k3 = c.k3 AND c.pos >= o.p0 AND c.pos < o.p0 + length(o.p)
            GROUP BY o.k1, o.k2, o.k3, o.unit_idx, length(o.p) {'HAVING count(*) = length(o.p)' if whole else ''})"""

    found = f"""pieces AS (SELECT {keys}, ord, reason, unnest(parts) AS piece, generate_subscripts(parts, 1) AS nth FROM ({pieces})),
        placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY {keys}, ord ORDER BY nth) - length(piece) AS s0 FROM pieces),
        lined AS (SELECT o.k1, o.k2, o.k3, o.unit_idx, arg_max(s.reason, s.ord) AS line_reason FROM o JOIN placed s ON o.k1 = s.k1 AND o.k2 = s.k2 AND o.k3 = s.k3
            AND s.nth % 2 = 0 AND length(o.f) > 0 AND s.s0 < o.f0 + length(o.f) AND s.s0 + length(s.piece) > o.f0 GROUP BY ALL)"""
    measured = f"""segments AS (SELECT {keys}, vis, string_agg(f, '' ORDER BY unit_idx) AS sf FROM u GROUP BY ALL HAVING {HAS("string_agg(f, '' ORDER BY unit_idx)", V.METRIC)}),
        starts AS (SELECT {keys}, vis, sf, unnest(range(0, length(sf))) AS i FROM segments),
        matches AS (SELECT *, regexp_extract(substr(sf, i + 1), '^{V.METRIC}') AS m FROM starts WHERE i = 0 OR NOT {HAS('substr(sf, i, 1)', before)}),
        metric_held AS (SELECT DISTINCT {keys}, vis, unnest(range(i, i + length(m))) AS pos FROM matches WHERE m <> '' AND NOT regexp_matches(substr(sf, i + length(m) + 1, 1), '[\\p{{L}}\\p{{N}}]')),
        metric AS (SELECT o.k1, o.k2, o.k3, o.unit_idx FROM o JOIN metric_held c ON o.k1 = c.k1 AND o.k2 = c.k2 AND o.k3 = c.k3 AND o.vis = c.vis AND c.pos >= o.v0 AND c.pos < o.v0 + length(o.f)
            GROUP BY o.k1, o.k2, o.k3, o.unit_idx, length(o.f) HAVING count(*) = length(o.f))"""
    same = lambda t: f"u.k1 = {t}.k1 AND u.k2 = {t}.k2 AND u.k3 = {t}.k3 AND u.unit_idx = {t}.unit_idx"
    return f"""WITH source AS ({source}), u AS (SELECT *, {FOLD('text')} AS f, {DROPPED('text')} AS p FROM source),
        o AS (SELECT {keys}, unit_idx, vis, f, p, sum(length(f)) OVER w - length(f) AS f0, sum(length(p)) OVER w - length(p) AS p0, sum(length(f)) OVER (PARTITION BY {keys}, vis ORDER BY unit_idx) - length(f) AS v0
            FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY unit_idx)),
        blocks AS (SELECT {keys}, string_agg(f, '' ORDER BY unit_idx) AS jf, string_agg(p, '' ORDER BY unit_idx) AS jp FROM u GROUP BY ALL),
        {found if line else f"lined AS (SELECT {keys}, unit_idx, '' AS line_reason FROM o WHERE false)"},
        {measured if metric else f"metric AS (SELECT {keys}, unit_idx FROM o WHERE false)"},
        {phrases('users', terms, False)}, {phrases('labelled', labels, True)},
        flagged AS (SELECT u.* EXCLUDE (f, p), lined.line_reason, metric.k1 IS NOT NULL AS unit_metric, users.k1 IS NOT NULL AS user_kept, labelled.k1 IS NOT NULL AS label_kept FROM u
            LEFT JOIN lined ON {same('lined')} LEFT JOIN metric ON {same('metric')} LEFT JOIN users ON {same('users')} LEFT JOIN labelled ON {same('labelled')})"""


def cascade(own: str = JUDGE, name_run: str = "NULL") -> str:
    """Clauses that follow ``flagged`` (with ``semantic, confidence``) and end in ``decided``: ``reason, mask``."""
    return f""", formed AS (SELECT *, {TRIM('text')} AS r, {FOLD(TRIM('text'))} AS n FROM flagged),
        said AS (SELECT *, coalesce(line_reason, {own}) AS own FROM formed),
        weighed AS (SELECT *, line_reason IS NOT NULL OR NOT (own IN ('empty', 'allowlist', 'punct', 'symbol') OR own LIKE 'pos:%') AS masked,
            own IN ('digit', 'at-mark') OR line_reason IS NOT NULL OR coalesce(semantic, '') = 'data' AS data_like FROM said),
        decided AS (SELECT *, reason NOT IN ('user', 'unit-metric', 'empty', 'allowlist', 'punct', 'symbol', 'dom-label', 'label') AND reason NOT LIKE 'pos:%' AND reason NOT LIKE 'noise(%' AS mask FROM (
            SELECT *, CASE WHEN user_kept THEN 'user' WHEN unit_metric AND coalesce(semantic, '') <> 'data' AND coalesce(line_reason, '') NOT LIKE 'email%' THEN 'unit-metric'
            WHEN NOT masked AND semantic = 'data' THEN 'dom-data'
            WHEN NOT masked AND {name_run} IS NOT NULL AND coalesce(semantic, '') <> 'label' AND NOT label_kept AND coalesce(confidence, 100) >= {V.NOISE_CONFIDENCE} THEN {name_run}
            WHEN NOT masked THEN own WHEN NOT data_like AND semantic = 'label' THEN 'dom-label' WHEN NOT data_like AND label_kept THEN 'label'
            WHEN coalesce(confidence, 100) < {V.NOISE_CONFIDENCE} AND NOT data_like THEN 'noise(' || CAST(floor(confidence + 0.5) AS INT) || ')' ELSE own END AS reason FROM weighed))"""


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS b FROM documents"
DOC_WORDS = f"""SELECT doc_id AS k1, CAST(b AS INT) AS k2, 0 AS k3, CAST(k AS INT) AS unit_idx, text, 0 AS vis, NULL::VARCHAR AS semantic, NULL::DOUBLE AS confidence FROM (
    SELECT doc_id, b, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS k FROM (SELECT doc_id, b, regexp_extract_all(line, '{WORD}') AS w FROM ({_LINES})))"""
DOC_SPACED = f"""SELECT k1, k2, k3, 2 * unit_idx AS unit_idx, text, vis, semantic, confidence FROM ({DOC_WORDS}) UNION ALL SELECT k1, k2, k3, 2 * unit_idx + 1, ' ', vis, semantic, confidence FROM ({DOC_WORDS})"""
WHOLE_SPACED = f"""SELECT doc_id AS k1, 0 AS k2, 0 AS k3, CAST(2 * (k - 1) + s AS INT) AS unit_idx, CASE s WHEN 0 THEN w[k] ELSE ' ' END AS text, 0 AS vis FROM (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '{WORD}') AS w FROM documents)), range(2) r(s)"""
TURN_WORDS = f"""SELECT conv_id AS k1, turn AS k2, CAST(b AS INT) AS k3, CAST(k AS INT) AS unit_idx, text, 0 AS vis FROM (
    SELECT conv_id, turn, b, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS k FROM (SELECT conv_id, turn, b, regexp_extract_all(line, '{WORD}') AS w FROM (
        SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS b FROM conversations)))"""

_SAID = " ".join(f"WHEN {at} THEN '{said}'" for at, said in S.SCREEN_TEXTS.items())
_MEANT = "CASE WHEN s % 31 < 4 THEN 'label' WHEN s % 31 BETWEEN 10 AND 14 THEN 'data' END"
SCREEN = f"""SELECT conv_id AS k1, turn AS k2, 0 AS k3, CAST(k AS INT) AS unit_idx, CASE s % {S.SCREEN_CYCLE} {_SAID} ELSE word END AS text, k // {S.ROW_UNITS} AS vis, {_MEANT} AS semantic,
    CASE WHEN s % 7 = 5 THEN 12.5 ELSE 90.0 END::DOUBLE AS confidence, ((k % {S.ROW_UNITS}) * {S.STEP_X})::DOUBLE AS x0, (k // {S.ROW_UNITS} * {S.STEP_Y})::DOUBLE AS y0,
    CASE {_MEANT} WHEN 'label' THEN 'th' WHEN 'data' THEN 'td' END AS kind, CASE WHEN {_MEANT} IS NOT NULL THEN CAST(turn AS INT) END AS table_id, CASE WHEN {_MEANT} IS NOT NULL THEN CAST(k % 4 AS INT) END AS col
    FROM (SELECT *, conv_id * 3 + turn * 5 + k AS s FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM (
        SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t\\r\\n\\x0B\\f]+') AS w FROM conversations)))"""
_FLAGS = spans(SCREEN, S.SCREEN_TERMS, V.LABELS, metric=True)
_SCREEN = _FLAGS + cascade()
_MASKS = f"""{_SCREEN}, merging AS (SELECT *, CASE WHEN lag(unit_idx) OVER w = unit_idx - 1 AND lag(reason) OVER w = reason AND lag(vis) OVER w = vis THEN 0 ELSE 1 END AS new
        FROM decided WHERE mask AND line_reason IS NOT NULL WINDOW w AS (PARTITION BY k1, k2 ORDER BY unit_idx)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY k1, k2 ORDER BY unit_idx) AS island FROM merging),
    parts AS (SELECT k1, k2, 0 AS part, unit_idx AS start, x0, x0 + {S.UNIT_W} AS x1, y0, reason, text, kind, table_id, col FROM decided WHERE mask AND line_reason IS NULL UNION ALL
        SELECT k1, k2, 1, min(unit_idx), min(x0), max(x0) + {S.UNIT_W}, min(y0), min(reason), string_agg(text, '' ORDER BY unit_idx), first(kind ORDER BY unit_idx), first(table_id ORDER BY unit_idx), first(col ORDER BY unit_idx)
        FROM islands GROUP BY k1, k2, island)"""

_MORPHEMES = ", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in m) + ")" for i, m in enumerate(S.MORPHEMES))
_TOKENS = f"""SELECT d.doc_id AS k1, 0 AS k2, 0 AS k3, CAST(i AS INT) AS unit_idx, surface AS text, 0 AS vis, CASE WHEN (doc_id + i) % 13 = 0 THEN 'label' WHEN (doc_id + i) % 17 = 0 THEN 'data' END AS semantic,
    CASE WHEN (doc_id + i) % 9 = 0 THEN 20.0 ELSE 95.0 END AS confidence, surface, pos, d1, d2, known
    FROM (SELECT doc_id, unnest(range({S.LINE_MORPHEMES})) AS i FROM documents) d
    JOIN (VALUES {_MORPHEMES}) m(num, surface, pos, d1, d2, known) ON m.num = (d.doc_id * 7 + i * i * 3 + i * (d.doc_id % 11)) % {len(S.MORPHEMES)}"""
_JUDGE_TOKEN = f"""CASE WHEN n = '' THEN 'empty' WHEN contains(n, '@') THEN 'at-mark' WHEN regexp_matches(n, '[0-9]') THEN 'digit' WHEN NOT regexp_matches(n, '[\\p{{L}}\\p{{N}}]') THEN 'punct'
    WHEN length(n) >= {V.LONG_TEXT} THEN 'long-text' WHEN n IN ({', '.join(f"'{x}'" for x in V.LABELS)}) THEN 'allowlist' WHEN surface IN ({', '.join(f"'{x}'" for x in V.ADDRESS_SUFFIX)}) THEN 'address-suffix'
    WHEN pos = '名詞' AND d1 = '固有名詞' THEN 'proper-noun' WHEN pos = '名詞' AND d1 = '数' THEN 'number' WHEN known = 'UNKNOWN' AND pos = '記号' THEN 'symbol' WHEN known = 'UNKNOWN' THEN 'unknown-token'
    ELSE 'pos:' || pos END"""
_NAMED = f"""classed AS (SELECT *, CASE WHEN pos = '記号' AND d1 = '空白' THEN 'blank'
        WHEN regexp_full_match(surface, '[一-鿿々]+') AND ((pos = '名詞' AND d1 IN ('一般', '固有名詞', 'サ変接続')) OR (pos = '形容詞' AND d1 = '自立')) THEN 'kanji'
        WHEN regexp_full_match(surface, '[ぁ-ゖー]{{1,4}}') AND pos = '名詞' AND d1 IN ('一般', '固有名詞') THEN 'kana' ELSE 'end' END AS cls FROM tokens),
    solid AS (SELECT *, last_value(CASE WHEN cls <> 'blank' THEN cls END IGNORE NULLS) OVER w AS prev, last_value(CASE WHEN cls <> 'blank' THEN d1 = '固有名詞' AND d2 = '人名' END IGNORE NULLS) OVER w AS person
        FROM classed WINDOW w AS (PARTITION BY k1 ORDER BY unit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    runs AS (SELECT *, cls = 'kana' AND prev = 'kanji' AND person AS given, sum(CASE WHEN cls = 'kanji' AND coalesce(prev, '') <> 'kanji' THEN 1 ELSE 0 END) OVER (PARTITION BY k1 ORDER BY unit_idx) AS run FROM solid),
    summed AS (SELECT k1, run, min(unit_idx) AS lo, max(unit_idx) AS hi, bool_or(given) AS kana, count(*) FILTER (cls = 'kanji') AS members, sum(length(surface)) FILTER (cls = 'kanji') AS size,
        bool_or(cls = 'kanji' AND (length(surface) = 1 OR d1 = '固有名詞')) AS sure FROM runs WHERE run > 0 AND (cls = 'kanji' OR given) GROUP BY ALL),
    named AS (SELECT r.k1, r.unit_idx, CASE WHEN kana THEN 'kana-name' WHEN members >= 2 AND size BETWEEN 2 AND 4 AND sure THEN 'kanji-run' END AS name_run
        FROM runs r JOIN summed s ON r.k1 = s.k1 AND r.run = s.run AND r.unit_idx BETWEEN s.lo AND s.hi)"""

_FORM = """WITH w AS (SELECT doc_id AS page_id, list_transform(range(1, 17), lambda i: coalesce(regexp_extract_all(text, '[^ \\t\\r\\n\\x0B\\f]+')[i], 'none')) AS w FROM documents),
    lines AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 6, 6, 6, 6, 7, 8, 9, 10, 11, 11]) AS block_id, unnest(range(20)) AS line_id,
        unnest(['label', 'label', 'label', 'label', 'data', 'data', 'data', 'label', 'data', 'data', 'label', 'data', 'data', 'data', 'label', 'data', 'data', 'data', NULL, NULL]) AS semantic,
        unnest(['nav', 'h1', 'th', 'th', 'td', 'td', 'td', 'label', 'input:email', 'input:password', 'input:submit', 'select', 'select', 'textarea', 'columnheader', 'row', 'cell', 'row', NULL, NULL]) AS kind,
        unnest([NULL, NULL, 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1, 1, 1, 1, NULL, NULL]) AS table_id,
        unnest([NULL, NULL, 0, 1, 0, 1, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 1, 0, 1, NULL, NULL]) AS col,
        unnest([w[1], w[2], 'Name', w[3], w[4], 'x', w[5], 'Mail', w[6], '●●●', w[8], w[9], w[10], w[11], 'Total', w[12], w[13], w[14], w[15], w[16]]) AS text FROM w)"""
_FORM_LINES = _FORM + " SELECT page_id, CAST(block_id AS INT) AS block_id, CAST(line_id AS INT) AS line_id, semantic, kind, CAST(table_id AS INT) AS table_id, CAST(col AS INT) AS col, text FROM lines"
_FORM_UNITS = f"""SELECT page_id AS k1, block_id AS k2, 0 AS k3, CAST(row_number() OVER (PARTITION BY page_id, block_id ORDER BY line_id) - 1 AS INT) AS unit_idx, text, line_id AS vis, semantic, NULL::DOUBLE AS confidence,
    line_id, kind, table_id, col FROM ({_FORM_LINES})"""

_HEXES = "['#0a141e', '#c8640080', NULL, '#aabbcc', '#11223344', NULL]"
_ELEMENTS = f"""WITH e AS (SELECT doc_id AS page_id, i AS ord, ['div', 'img', 'svg', 'span', 'frame', 'body'][(doc_id + i) % 6 + 1] AS tag, (doc_id + i) % 19 = 0 AS glyph, CAST(v - 40 AS DOUBLE) AS x, CAST(v * 3 % 900 - 30 AS DOUBLE) AS y,
        CAST(4 + v * 5 % 90 AS DOUBLE) AS w, CAST(4 + v * 11 % 70 AS DOUBLE) AS h, (doc_id + i) % 23 = 0 AS framed, {_HEXES}[(doc_id + i) % 6 + 1] AS bg_color,
        CASE WHEN i % 3 > 0 THEN {_HEXES}[(doc_id + i * 2 + 1) % 6 + 1] END AS border_color, (doc_id + i) % 5 = 0 AS picture
        FROM (SELECT doc_id, CAST(i AS INT) AS i, (doc_id * 13 + i * 7) % 1000 AS v FROM (SELECT doc_id, unnest(range(30)) AS i FROM documents))),
    seen AS (SELECT * FROM e WHERE NOT (x + w < 0 OR y + h < 0 OR x > 1000 OR y > 800))"""

ORACLE_SQL = {
    "line_pattern_units": spans(DOC_WORDS) + " SELECT k1 AS doc_id, k2 AS block_id, unit_idx, text, line_reason FROM flagged WHERE line_reason IS NOT NULL",
    "user_phrase_protect": spans(TURN_WORDS, terms=("the and", "of the"), line=False) + " SELECT k1 AS conv_id, k2 AS turn, k3 AS block_id, unit_idx, text FROM flagged WHERE user_kept",
    "label_phrase_protect": spans(TURN_WORDS, labels=("the", "and", "for the"), line=False) + " SELECT k1 AS conv_id, k2 AS turn, k3 AS block_id, unit_idx, text FROM flagged WHERE label_kept",
    "long_line_units": spans(WHOLE_SPACED, terms=("the and", "of the", "in the on"), metric=True) + """ SELECT k1 AS doc_id, unit_idx, text, line_reason, unit_metric, user_kept FROM flagged
        WHERE line_reason IS NOT NULL OR unit_metric OR user_kept""",
    "wrapped_lines": f"""WITH chars AS (SELECT conv_id, turn, i, substr(text, i::INT + 1, 1) AS ch, (i % {S.GLYPHS} * {S.GLYPH_W})::DOUBLE AS x0, (i // {S.GLYPHS} * {S.PITCH} + i % 3)::DOUBLE AS y0,
            CASE WHEN i % 13 = 0 THEN 0 ELSE {S.GLYPH_W} END AS w, 12 + i % 2 * 2 AS h FROM (SELECT *, unnest(range(length(text))) AS i FROM conversations)),
        seen AS (SELECT * FROM chars WHERE w > 0 AND x0 <= {S.GLYPH_SCREEN[0]} AND y0 <= {S.GLYPH_SCREEN[1]}),
        told AS (SELECT *, least(lag(y0 + h) OVER o, y0 + h) - greatest(lag(y0) OVER o, y0) < 0.5 * h AS wraps FROM seen WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)),
        parted AS (SELECT *, sum(coalesce(wraps, false)::INT) OVER (PARTITION BY conv_id, turn ORDER BY i) AS part FROM told),
        lines AS (SELECT conv_id, turn, part, string_agg(ch, '' ORDER BY i) AS text, CAST(count(*) AS INT) AS symbols, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1 FROM parted GROUP BY ALL)
        SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY part) - 1 AS INT) AS piece, text, symbols, x0, y0, x1, y1 FROM lines WHERE {TRIM('text')} <> ''""",
    "run_merge": spans(DOC_WORDS, labels=V.LABELS, metric=True) + cascade() + """, masks AS (SELECT *, CASE WHEN line_reason IS NOT NULL AND lag(line_reason) OVER w IS NOT NULL AND lag(unit_idx) OVER w = unit_idx - 1
        AND lag(reason) OVER w = reason THEN 0 ELSE 1 END AS new FROM decided WHERE mask WINDOW w AS (PARTITION BY k1, k2 ORDER BY unit_idx)),
        islands AS (SELECT *, sum(new) OVER (PARTITION BY k1, k2 ORDER BY unit_idx) AS island FROM masks)
        SELECT k1 AS doc_id, k2 AS block_id, min(unit_idx) AS start, max(unit_idx) AS "end", min(reason) AS reason, string_agg(text, '' ORDER BY unit_idx) AS text FROM islands GROUP BY k1, k2, island""",
    "cascade_units": spans(DOC_SPACED, labels=V.LABELS, metric=True) + cascade() + " SELECT k1 AS doc_id, k2 AS block_id, unit_idx, text, mask, reason FROM decided WHERE unit_idx % 2 = 0",
    "cascade_summary": spans(DOC_SPACED, labels=V.LABELS, metric=True) + cascade() + " SELECT k1 AS doc_id, mask, reason, count(*) AS n FROM decided WHERE unit_idx % 2 = 0 GROUP BY ALL",
    "reason_hue": f"""WITH words AS (SELECT text FROM ({DOC_WORDS})), formed AS (SELECT {TRIM('text')} AS r, {FOLD(TRIM('text'))} AS n FROM words), reasons AS (SELECT DISTINCT {JUDGE} AS reason FROM formed)
        SELECT reason, abs(list_reduce(list_concat([0::BIGINT], list_transform(string_split(regexp_replace(reason, '\\(.*\\)$', ''), ''), lambda c: ascii(c)::BIGINT)),
        lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 360 AS hue FROM reasons""",
    "screen_flags": _FLAGS + " SELECT k1 AS conv_id, k2 AS turn, unit_idx, text, line_reason, unit_metric, user_kept, label_kept FROM flagged WHERE line_reason IS NOT NULL OR unit_metric OR user_kept OR label_kept",
    "screen_decide": _SCREEN + " SELECT k1 AS conv_id, k2 AS turn, unit_idx, text, mask, reason FROM decided",
    "screen_masks": _MASKS + f""" SELECT k1 AS conv_id, k2 AS turn, CAST(row_number() OVER (PARTITION BY k1, k2 ORDER BY part, start) - 1 AS INT) AS ord, x0 - {V.MASK_PADDING} AS x, y0 - {V.MASK_PADDING} AS y,
        x1 - x0 + {2 * V.MASK_PADDING} AS w, {S.UNIT_H}.0::DOUBLE + {2 * V.MASK_PADDING} AS h, reason, text, kind, table_id, col FROM parts""",
    "screen_summary": _MASKS + " SELECT reason, count(*) AS n FROM (SELECT reason FROM parts UNION ALL SELECT reason FROM decided WHERE NOT mask) GROUP BY reason",
    "screen_coverage": _SCREEN + """, checked AS (SELECT CASE WHEN text IN ('090-1234-', '5678', 'ann@', 'mail.example.org') THEN 'mask' WHEN text IN ('Save', '検索', '99.95%', '+12', '件') THEN 'keep' END AS "check", mask FROM decided)
        SELECT "check", count(*) FILTER (("check" = 'mask') <> mask) AS violations, count(*) AS n FROM checked WHERE "check" IS NOT NULL GROUP BY 1""",
    "text_run_merge": _SCREEN.replace("WITH source", "WITH RECURSIVE source", 1) + f""", kept AS (SELECT k1 * 1000 + k2 AS page_id, row_number() OVER (PARTITION BY k1, k2 ORDER BY y0, x0, unit_idx) AS nth, x0 AS x, y0 AS y, {S.UNIT_W}.0::DOUBLE AS w, {S.UNIT_H}.0::DOUBLE AS h,
            text, kind, table_id, col, CAST(k2 AS INT) AS block_id FROM decided WHERE NOT mask),
        walk AS (SELECT page_id, nth, 1 AS run, x, y, w, h, text, kind, table_id, col, block_id FROM kept WHERE nth = 1 UNION ALL
            SELECT page_id, nth, CASE WHEN near THEN run ELSE run + 1 END, CASE WHEN near THEN least(x, kx) ELSE kx END, CASE WHEN near THEN least(y, ky) ELSE ky END,
                CASE WHEN near THEN greatest(x + w, kx + kw) - least(x, kx) ELSE kw END, CASE WHEN near THEN greatest(y + h, ky + kh) - least(y, ky) ELSE kh END,
                CASE WHEN near THEN text || CASE WHEN gap >= 0.15 * tall THEN ' ' ELSE '' END || ktext ELSE ktext END, CASE WHEN near THEN CASE WHEN kind IS NOT DISTINCT FROM kkind THEN kind END ELSE kkind END,
                CASE WHEN near THEN CASE WHEN agree THEN table_id END ELSE ktable END, CASE WHEN near THEN CASE WHEN agree THEN col END ELSE kcol END, block_id
            FROM (SELECT *, least(y + h, ky + kh) - greatest(y, ky) > 0.5 * tall AND gap <= 0.6 * tall AS near FROM (
                SELECT a.page_id, k.nth, a.run, a.x, a.y, a.w, a.h, a.text, a.kind, a.table_id, a.col, a.block_id, k.x AS kx, k.y AS ky, k.w AS kw, k.h AS kh, k.text AS ktext, k.kind AS kkind, k.table_id AS ktable, k.col AS kcol,
                greatest(a.h, k.h) AS tall, k.x - (a.x + a.w) AS gap, a.table_id IS NOT DISTINCT FROM k.table_id AND a.col IS NOT DISTINCT FROM k.col AS agree FROM walk a JOIN kept k ON k.page_id = a.page_id AND k.nth = a.nth + 1)))
        SELECT page_id, x, y, w, h, text, block_id, kind, table_id, col FROM walk QUALIFY nth = max(nth) OVER (PARTITION BY page_id, run)""",
    "screen_tokens": f"""WITH units AS ({SCREEN}), chars AS (SELECT k1, k2, unit_idx, confidence, x0, y0, substr(text, CAST(i AS INT) + 1, 1) AS c, i, {S.UNIT_W}.0::DOUBLE / length(text) AS cw FROM (SELECT *, unnest(range(length(text))) AS i FROM units)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY unit_idx, i) - 1 AS pos FROM chars)
        SELECT k1 AS conv_id, k2 AS turn, CAST(pos // 4 AS INT) AS unit_idx, string_agg(c, '' ORDER BY pos) AS text, round(min(x0 + cw * i), 6) AS x0, round(min(y0), 6) AS y0, round(max(x0 + cw * (i + 1)), 6) AS x1, round(max(y0 + {S.UNIT_H}), 6) AS y1,
        min(confidence) AS confidence FROM placed GROUP BY k1, k2, pos // 4""",
    "ocr_units": f"""SELECT k1 AS conv_id, CAST(dense_rank() OVER (PARTITION BY k1 ORDER BY k2) - 1 AS INT) AS block_id, 0 AS line_id, unit_idx, text, confidence, x0 / 2 AS x, y0 / 2 AS y,
        {S.UNIT_W} / 2.0::DOUBLE AS w, {S.UNIT_H} / 2.0::DOUBLE AS h FROM ({SCREEN})""",
    "route_lines": f"SELECT k1 AS conv_id, CASE WHEN k1 % 2 = 0 THEN 'DOM' ELSE 'OCR' END AS route, count(DISTINCT k2) AS lines, count(*) AS words FROM ({SCREEN}) GROUP BY k1",
    "judge_tokens": f"WITH tokens AS ({_TOKENS}), formed AS (SELECT *, {FOLD(TRIM('text'))} AS n FROM tokens) SELECT k1 AS doc_id, unit_idx, {_JUDGE_TOKEN} AS reason FROM formed",
    "name_runs": f"WITH tokens AS ({_TOKENS}), {_NAMED} SELECT k1 AS doc_id, unit_idx, surface AS text, name_run FROM named JOIN tokens USING (k1, unit_idx) WHERE name_run IS NOT NULL",
    "token_decide": f"""WITH tokens AS ({_TOKENS}), {_NAMED}, flagged AS (SELECT t.*, name_run, NULL::VARCHAR AS line_reason, false AS unit_metric, false AS user_kept, false AS label_kept FROM tokens t LEFT JOIN named USING (k1, unit_idx))
        {cascade(_JUDGE_TOKEN, 'name_run')} SELECT k1 AS doc_id, unit_idx, text, mask, reason FROM decided""",
    "form_lines": _FORM_LINES,
    "form_table_link": f"""WITH l AS ({_FORM_LINES}) SELECT c.page_id, c.line_id, c.table_id, c.col, c.text, h.text AS header FROM l c
        LEFT JOIN l h ON h.page_id = c.page_id AND h.table_id = c.table_id AND h.col = c.col AND h.kind IN ('th', 'columnheader') WHERE c.semantic = 'data' AND c.table_id IS NOT NULL""",
    "form_decide": spans(_FORM_UNITS, labels=V.LABELS, metric=True) + cascade() + " SELECT k1 AS page_id, k2 AS block_id, line_id, semantic, kind, table_id, col, mask, reason FROM decided",
    "opaque_regions": _ELEMENTS + " SELECT page_id, ord, x * 2 AS x, y * 2 AS y, w * 2 AS w, h * 2 AS h, 'opaque(' || tag || ')' AS reason FROM seen WHERE tag IN ('img', 'svg', 'frame') AND w >= 24 AND h >= 24",
    "icon_regions": _ELEMENTS + """ SELECT page_id, ord, x, y, w, h, kind FROM (SELECT *, unnest(list_filter([CASE WHEN picture THEN 'bg-image' END,
        CASE WHEN tag IN ('img', 'svg', 'frame') AND (w < 24 OR h < 24) THEN tag WHEN glyph THEN 'glyph' END], lambda k: k IS NOT NULL)) AS kind FROM seen WHERE w BETWEEN 8 AND 64 AND h BETWEEN 8 AND 64)""",
    "decor_regions": _ELEMENTS + """ SELECT page_id, ord, x, y, w, h, bg_color, border_color FROM seen WHERE (bg_color IS NOT NULL OR border_color IS NOT NULL) AND w >= 6 AND h >= 6
        AND NOT (bg_color IS NOT NULL AND border_color IS NULL AND NOT framed AND tag = 'body')""",
    "phrase_lists": """WITH items AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), listed AS (SELECT 0 AS list, item_id AS ord, trim(w[1] || CASE WHEN len(w) > 1 THEN ' ' || w[2] ELSE '' END) AS term FROM items UNION ALL SELECT 1, item_id + 1, trim(w[1]) FROM items),
        firsts AS (SELECT term, min(list * 1000000000 + ord) AS place FROM listed WHERE term <> '' GROUP BY term) SELECT row_number() OVER (ORDER BY place, term) - 1 AS ord, term FROM firsts""",
}

# -- drawings -------------------------------------------------------------------------------------------------------
_DECOR = "(bg_color IS NOT NULL OR border_color IS NOT NULL) AND w >= 6 AND h >= 6 AND NOT (bg_color IS NOT NULL AND border_color IS NULL AND NOT framed AND tag = 'body')"
_OF_SCREENS = _ELEMENTS.replace("FROM documents", "FROM (SELECT conv_id * 1000 + turn AS doc_id FROM conversations)")
_DRAWN = f"""SELECT page_id, 0 AS layer, 0 AS part, ord, x, y, w, h, NULL::VARCHAR AS text, 'decor' AS role, NULL::VARCHAR AS reason, NULL::VARCHAR AS kind, NULL::INT AS table_id, NULL::INT AS col, bg_color AS fill, border_color AS line
        FROM ({ORACLE_SQL["decor_regions"].replace(_ELEMENTS, _OF_SCREENS)})
    UNION ALL SELECT page_id, 1, 0, ord, x, y, w, h, NULL, 'icon', NULL, kind, NULL, NULL, 'data:image/png;' || ord, NULL FROM ({ORACLE_SQL["icon_regions"].replace(_ELEMENTS, _OF_SCREENS)})
    UNION ALL SELECT page_id, 2, 0, NULL, x, y, w, h, text, 'text', NULL, kind, table_id, col, NULL, NULL FROM ({ORACLE_SQL["text_run_merge"]})
    UNION ALL SELECT conv_id * 1000 + turn, 2, 1, ord, x, y, w, h, text, 'revealed', reason, kind, table_id, col, NULL, NULL FROM ({ORACLE_SQL["screen_masks"]}) WHERE reason = 'dom-data' AND text <> ''
    UNION ALL SELECT conv_id * 1000 + turn, 3, 0, ord, x, y, w, h, NULL, 'masked', reason, kind, table_id, col, NULL, NULL FROM ({ORACLE_SQL["screen_masks"]}) WHERE reason <> 'dom-data'"""
_NAMED_ID = lambda prefix, n: f"'m2g-' || {prefix} || '-' || lpad(lower(to_base({n}, 36)), 4, '0')"
_NUMBERED = f"""WITH drawn AS ({_DRAWN}), numbered AS (SELECT *, CAST(sum(CASE layer WHEN 1 THEN 2 ELSE 1 END) OVER (PARTITION BY page_id
        ORDER BY layer, part, ord NULLS LAST, y, x, w, h, kind <> 'bg-image' NULLS FIRST, kind NULLS FIRST, text NULLS FIRST, reason NULLS FIRST ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS n FROM drawn),
    named AS (SELECT page_id, n, {_NAMED_ID("['d', 'i', 't', 'm'][layer + 1]", "n")} AS id, CASE WHEN layer = 1 THEN {_NAMED_ID("'f'", "n - 1")} END AS file_id, layer, role, reason, nullif(kind, '') AS kind,
        CASE WHEN col IS NOT NULL THEN table_id END AS table_id, CASE WHEN table_id IS NOT NULL THEN col END AS col, x, y, w, h, text, CASE WHEN layer = 2 THEN greatest(9, CAST(floor(h / 1.25 + 0.5) AS INT)) END AS font_size,
        fill, line FROM numbered)"""
ORACLE_SQL["wireframe_elements"] = _NUMBERED + " SELECT * EXCLUDE (fill, line) FROM named"
ORACLE_SQL["wireframe_layers"] = f"""SELECT page_id, role, count(*) AS n, min(n) AS "first", max(n) AS "last" FROM ({ORACLE_SQL["wireframe_elements"]}) GROUP BY ALL"""
_CROWDED = _ELEMENTS.replace("WITH e AS (", "WITH own AS (").replace("seen AS (SELECT * FROM e", f"e AS (SELECT page_id // {S.CROWD} AS page_id, CAST(page_id % {S.CROWD} * 30 + ord AS BIGINT) AS ord, * EXCLUDE (page_id, ord) FROM own),\n    seen AS (SELECT * FROM e")
ORACLE_SQL["crowded_decor"] = _CROWDED + f" SELECT page_id, ord, x, y, w, h, bg_color, border_color FROM seen WHERE {_DECOR} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord) <= 600"
ORACLE_SQL["crowded_icons"] = _CROWDED + f""", counted AS (SELECT e.*, coalesce(sum(CASE WHEN {_DECOR} AND NOT (x + w < 0 OR y + h < 0 OR x > 1000 OR y > 800) THEN 1 ELSE 0 END)
            OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
        kinds AS (SELECT *, list_filter([CASE WHEN picture AND before < 600 THEN 'bg-image' END, CASE WHEN tag IN ('img', 'svg', 'frame') AND (w < 24 OR h < 24) THEN tag WHEN glyph THEN 'glyph' END], lambda k: k IS NOT NULL) AS ks
            FROM counted WHERE w BETWEEN 8 AND 64 AND h BETWEEN 8 AND 64 AND NOT (x + w < 0 OR y + h < 0 OR x > 1000 OR y > 800)),
        icons AS (SELECT page_id, ord, x, y, w, h, unnest(ks) AS kind, generate_subscripts(ks, 1) AS part FROM kinds)
        SELECT page_id, ord, x, y, w, h, kind FROM icons QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ord, part) <= 200"""
_PAINTS = "[{r: 10.0::DOUBLE, g: 20.0::DOUBLE, b: 30.0::DOUBLE, a: 1.0::DOUBLE}, {r: 200.0, g: 100.0, b: 0.0, a: 0.5}, NULL, {r: 170.0, g: 187.0, b: 204.0, a: 1.0}, {r: 17.0, g: 34.0, b: 51.0, a: 68 / 255.0::DOUBLE}, NULL]"
_HEX2 = lambda v: f"format('{{:02x}}', CAST(floor({v} + 0.5) AS INT))"
ORACLE_SQL["page_grounds"] = _ELEMENTS + f""", paints AS (SELECT page_id, ord, {_PAINTS}[(page_id + ord) % 6 + 1] AS c FROM e WHERE (ord % 4 = 0 OR tag = 'body') AND NOT framed AND w >= 6 AND h >= 6),
        layers AS (SELECT page_id, list(c ORDER BY ord) AS cs FROM paints WHERE c IS NOT NULL GROUP BY page_id),
        mixed AS (SELECT page_id, list_reduce([{{r: 255.0::DOUBLE, g: 255.0::DOUBLE, b: 255.0::DOUBLE, a: 1.0::DOUBLE}}] || cs, lambda u, f: {{r: f.r * f.a + u.r * (1 - f.a), g: f.g * f.a + u.g * (1 - f.a), b: f.b * f.a + u.b * (1 - f.a), a: 1.0::DOUBLE}}) AS m FROM layers)
        SELECT p.page_id, CASE WHEN m IS NULL THEN '#ffffff' ELSE '#' || {_HEX2('m.r')} || {_HEX2('m.g')} || {_HEX2('m.b')} END AS page_background FROM (SELECT DISTINCT page_id FROM e) p LEFT JOIN mixed USING (page_id)"""
_RECT_LOG = f"""{_MASKS}, logged AS (SELECT k1, k2, list(text || '=' || CASE WHEN mask THEN '塗:' ELSE '残:' END || reason ORDER BY unit_idx) AS decisions FROM decided GROUP BY ALL),
        counted AS (SELECT k1, k2, v, count(*) AS n FROM (SELECT k1, k2, '塗:' || reason AS v FROM parts UNION ALL SELECT k1, k2, '残:' || reason FROM decided WHERE NOT mask) GROUP BY ALL),
        summed AS (SELECT k1, k2, map(list(v ORDER BY v), list(n ORDER BY v)) AS summary FROM counted GROUP BY ALL),
        painted AS (SELECT k1, k2, list({{text: text, reason: reason, source: 'auto'}} ORDER BY part, start) AS masks FROM parts GROUP BY ALL),
        stay AS (SELECT k1, k2, list({{text: text, reason: reason}} ORDER BY unit_idx) AS kept FROM decided WHERE NOT mask GROUP BY ALL)"""
ORACLE_SQL["decision_logs"] = _RECT_LOG + """ SELECT k1 AS conv_id, k2 AS turn, to_json({route: 'DOM', summary: summary, masks: coalesce(masks, []), kept: coalesce(kept, []), decisions: decisions})::VARCHAR AS json
        FROM logged LEFT JOIN summed USING (k1, k2) LEFT JOIN painted USING (k1, k2) LEFT JOIN stay USING (k1, k2)"""


def _object(**fields: str) -> str:
    """A JSON object without the fields that are null."""
    parts = ", ".join(f"""'"{name}":' || to_json({value})::VARCHAR""" for name, value in fields.items())
    return f"'{{' || array_to_string(list_filter([{parts}], lambda p: p IS NOT NULL), ',') || '}}'"


_BOXED, _AT = "CASE WHEN layer IN (0, 3) THEN 1 END", lambda *of: f"[{', '.join(of)}][layer + 1]"
_OPAQUE = "coalesce(starts_with(reason, 'opaque'), false)"
_ELEMENT = _object(
    id="id", type=_AT("'rectangle'", "'image'", "'text'", "'rectangle'"), x="x", y="y", width="w", height="h", fillStyle=_AT("'solid'", "NULL", "NULL", f"CASE WHEN {_OPAQUE} THEN 'cross-hatch' ELSE 'hachure' END"),
    backgroundColor=_AT("coalesce(fill, 'transparent')", "NULL", "NULL", f"CASE WHEN {_OPAQUE} THEN '#dee2e6' ELSE '#ced4da' END"), strokeColor=_AT("coalesce(line, 'transparent')", "'transparent'", "'#1e1e1e'", "'#868e96'"),
    strokeWidth=_BOXED, roughness=_BOXED, fileId="file_id", status="CASE WHEN layer = 1 THEN 'saved' END", scale="CASE WHEN layer = 1 THEN [1, 1] END", text="text", originalText="text", fontSize="font_size",
    textAlign="CASE WHEN layer = 2 THEN 'left' END", verticalAlign="CASE WHEN layer = 2 THEN 'top' END", groupIds="CASE WHEN layer >= 2 THEN ['block-' || page_id % 1000] ELSE [] END",
    customData=f"({_object(m2g='(' + _object(v='1', role='role', reason='reason', kind='kind', tableId='table_id', col='col') + ')::JSON')})::JSON",
)
_FILE = _object(mimeType="'image/png'", id="file_id", dataURL="fill", created="0", lastRetrieved="0")
ORACLE_SQL["wireframe_json"] = _NUMBERED + f""", listed AS (SELECT page_id, string_agg({_ELEMENT}, ',' ORDER BY n) AS es, coalesce(string_agg(CASE WHEN layer = 1 THEN '"' || file_id || '":' || {_FILE} END, ',' ORDER BY file_id), '') AS fs
        FROM named GROUP BY page_id)
    SELECT page_id, '{{"type":"excalidraw","version":2,"elements":[' || es || '],"appState":{{"viewBackgroundColor":"#ffffff"}},"files":{{' || fs || '}}}}' AS json FROM listed"""
