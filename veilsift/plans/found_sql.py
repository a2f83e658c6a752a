"""DuckDB text that finds in the seeded pages what the detectors must find: from the pages themselves, by the rules."""

from __future__ import annotations

from veilsift.functions import patterns as P
from veilsift.operators import rewrite
from veilsift.plans.seeded import SEEDED_SQL, quoted

_Q = lambda p: "'" + p.replace("'", "''") + "'"
KEYWORD, SEMANTIC = _Q("(?i)" + P.KEYWORD_ANY), _Q("(?i)" + P.SEMANTIC_ANY)
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def hit(x: str) -> str:
    return f"regexp_matches({x}, {KEYWORD})"


def instructs(x: str) -> str:
    return f"({hit(x)} OR regexp_matches({x}, {SEMANTIC}))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WHITE}|{_WHITE}$', '', 'g')"


def unescaped(x: str) -> str:
    """The entities that the pages hold; the ampersand last."""
    return f"regexp_replace(replace(replace(replace({x}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;?', '&', 'g')"


def normal(x: str) -> str:
    return f"lower({strip(f'regexp_replace({x}, {_Q(_WHITE)}, {_Q(" ")}, {_Q("g")})')})"


def _phrases(stage: int, vector: str, table: str, text: str, pattern: str, before: int, after: int, most: int, severity: str, confidence: str) -> str:
    """What surrounds each match of a pattern. Lengths of matches and of the gaps between add up to where a match stands."""
    listed = f"SELECT page_id, {text} AS t, regexp_extract_all({text}, {pattern}) AS m, string_split_regex({text}, {pattern}) AS g FROM {table}"
    placed = f"SELECT page_id, t, i, m[i] AS w, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS off FROM ({listed}), unnest(range(1, len(m) + 1)) AS u(i)"
    spot = f"substr(t, greatest(off - {before}, 0) + 1, off + length(w) + {after} - greatest(off - {before}, 0))"
    cut = strip(f"replace({spot}, chr(10), ' ')")
    return f"SELECT page_id, {stage} AS stage, 0 AS part, i AS turn, '{vector}' AS vector, left({cut}, {most}) AS evidence, '{severity}' AS severity, '{confidence}' AS confidence FROM ({placed})"


_INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{E0000}-\x{E01EF}]"
_PLAIN = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
_INNER = lambda tag: f"regexp_extract(p, '(?s)^<{tag}[^>]*>(.*)</{tag}>$', 1)"

#: Pieces of a page in order (script and style whole), and what kind each is; how says whether a text is shown.
PIECES_SQL = (
    SEEDED_SQL
    + r""", pieces AS (
  SELECT page_id, i, ps[i] AS p, CASE WHEN ps[i] LIKE '<!--%' THEN 'comment' WHEN ps[i] LIKE '<script%' THEN 'script' WHEN ps[i] LIKE '<style%' THEN 'style' WHEN ps[i] LIKE '<%' THEN 'tag' ELSE 'text' END AS kind
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+') AS ps FROM seeded), unnest(range(1, len(ps) + 1)) AS u(i)
), tagged AS (
  SELECT *, last_value(CASE WHEN kind = 'tag' THEN p WHEN kind <> 'text' AND kind <> 'comment' THEN '' END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS tag FROM pieces
), texts AS (
  SELECT page_id, i, """
    + f"CASE kind WHEN 'text' THEN {strip(unescaped('p'))} WHEN 'script' THEN {strip(_INNER('script'))} ELSE {strip(_INNER('style'))} END AS t, "
    + r"""CASE WHEN kind = 'script' AND p LIKE '%ld+json%' THEN 'linked' WHEN kind <> 'text' THEN 'shown' WHEN regexp_matches(tag, 'display:none|visibility:hidden|color:#fff') THEN 'hidden' WHEN tag LIKE '%sr-only%' THEN 'read' ELSE 'shown' END AS how
  FROM tagged WHERE kind IN ('text', 'script', 'style')
), seen AS (
  SELECT s.page_id, any_value(s.url) AS url, any_value(s.html) AS html, """
    + f"any_value({unescaped(_PLAIN)}) AS plain, "
    + r"""coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE how = 'shown' AND t <> ''), '') AS visible
  FROM seeded s LEFT JOIN texts USING (page_id) GROUP BY s.page_id
), tokens AS (
"""
    + f"""  SELECT page_id, i, 0 AS turn, 'html_comment' AS vector, left(t, 300) AS evidence, 'high' AS severity, 'high' AS confidence FROM (SELECT page_id, i, {strip("regexp_extract(p, '(?s)^<!--(.*)-->$', 1)")} AS t FROM pieces WHERE kind = 'comment') WHERE {hit("t")}
  UNION ALL SELECT page_id, i, 1, 'hidden_form_field', left('value=' || t, 200), 'high', 'very_high' FROM (SELECT page_id, i, regexp_extract(p, ' value="([^"]*)"', 1) AS t FROM pieces WHERE p LIKE '<input type="hidden"%') WHERE {hit("t")}
  UNION ALL SELECT page_id, i, 2, 'attr_alt', left(t, 200), 'medium', 'high' FROM (SELECT page_id, i, regexp_extract(p, ' alt="([^"]*)"', 1) AS t FROM pieces WHERE kind = 'tag') WHERE {hit("t")}
  UNION ALL SELECT page_id, i, 3, 'attr_data-hint', left(t, 200), 'medium', 'high' FROM (SELECT page_id, i, regexp_extract(p, ' data-hint="([^"]*)"', 1) AS t FROM pieces WHERE kind = 'tag') WHERE {hit("t")}
  UNION ALL SELECT page_id, i, 0, 'json_ld', left(t, 300), 'high', 'high' FROM texts WHERE how = 'linked' AND {hit("t")}
  UNION ALL SELECT page_id, i, 0, CASE how WHEN 'read' THEN 'sr_only_text' ELSE 'css_hidden_text' END, left(t, 300), CASE WHEN {hit("t")} THEN 'high' WHEN how = 'read' THEN 'informational' ELSE 'medium' END, CASE how WHEN 'read' THEN 'high' ELSE 'very_high' END FROM texts WHERE how IN ('hidden', 'read') AND t <> ''
"""
    + r"""), counted AS (
  SELECT page_id, len(regexp_extract_all(html, '[\x{200B}\x{200C}]')) AS zero, len(regexp_extract_all(html, '[\x{202A}-\x{202E}\x{2066}-\x{2069}]')) AS bidi, regexp_extract_all(html, '[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]') AS chosen,
         regexp_extract_all(html, '[\x{E0020}-\x{E007E}]') AS tags, regexp_extract_all(html, '[\x{200B}\x{200C}]{8}') AS bytes FROM seeded
), unseen AS (
  SELECT page_id, 0 AS part, 'zero_width' AS vector, left(zero || ' zero-width chars; decoded=''' || left(array_to_string(list_transform(bytes, lambda b: chr(list_reduce(list_transform(range(1, 9), lambda j: (unicode(substr(b, j, 1)) - 8203)::INTEGER), lambda x, y: 2 * x + y)::INTEGER)), ''), 120) || '''', 200) AS evidence, 'medium' AS severity, 'very_high' AS confidence FROM counted WHERE zero > 0
  UNION ALL SELECT page_id, 1, 'bidi_control', bidi || ' bidi control chars present', 'high', 'high' FROM counted WHERE bidi > 0
  UNION ALL SELECT page_id, 2, 'unicode_tag_block', left('decoded=''' || left(array_to_string(list_transform(tags, lambda c: chr((unicode(c) - 917504)::INTEGER)), ''), 200) || '''', 200), 'high', 'very_high' FROM counted WHERE len(tags) > 0
"""
    + f"""  UNION ALL SELECT page_id, 3, 'variation_selector', left(n || ' variation selectors; decoded=''' || left(d, 160) || '''', 200), CASE WHEN {hit("d")} THEN 'high' ELSE 'medium' END, 'high' FROM (
    SELECT page_id, len(chosen) AS n, array_to_string(list_transform(chosen, lambda c: chr((CASE WHEN unicode(c) < 65536 THEN unicode(c) - 65024 ELSE unicode(c) - 917744 END)::INTEGER)), '') AS d FROM counted) WHERE n >= 4
), pseudo AS (
  SELECT page_id, i, unnest(regexp_extract_all(p, 'content\\s*:\\s*''([^'']*)''', 1)) AS t FROM pieces WHERE kind = 'style'
), metas AS (
  SELECT page_id, i, {unescaped("regexp_extract(p, ' content=" + '"([^"]*)"' + "', 1)")} AS t FROM pieces WHERE p LIKE '<meta %'
), encoded AS (
  SELECT page_id, 0 AS part, m, TRY(decode(from_base64(m || repeat('=', (4 - len(m) % 4) % 4)))) AS d FROM (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z0-9+/]{{24,}}')) AS m FROM seeded)
  UNION ALL SELECT page_id, 1, m, TRY(decode(unhex(m))) FROM (SELECT page_id, unnest(regexp_extract_all(plain, '([0-9a-fA-F][0-9a-fA-F]){{12,}}')) AS m FROM seen)
), linked AS (
  SELECT page_id, i, unnest(regexp_extract_all(t, ':"([^"]*)"', 1)) AS t FROM texts WHERE how = 'linked'
), found AS (
  SELECT page_id, 1 AS stage, i AS part, turn, CASE WHEN sure THEN 'hidden_ai_instruction' ELSE vector END AS vector, left(evidence, 240) AS evidence, CASE WHEN sure THEN 'critical' ELSE severity END AS severity, CASE WHEN sure THEN 'very_high' ELSE confidence END AS confidence
  FROM (SELECT *, vector IN ('css_hidden_text', 'sr_only_text', 'hidden_form_field') AND {instructs("evidence")} AS sure FROM tokens)
  UNION ALL SELECT page_id, 2, part, 0, vector, evidence, severity, confidence FROM unseen
  UNION ALL {_phrases(3, "semantic_instruction", "seen", "visible", SEMANTIC, 50, 70, 240, "medium", "low")}
  UNION ALL {_phrases(4, "keyword", "seen", "plain", KEYWORD, 30, 30, 200, "low", "low")}
  UNION ALL SELECT page_id, 5, i, 0, 'css_pseudo_content', left(t, 200), 'high', 'high' FROM pseudo WHERE length(t) > 8 AND {instructs("t")}
  UNION ALL SELECT page_id, 6, i, 0, 'meta_tag', left(t, 200), 'medium', 'medium' FROM metas WHERE {instructs("t")}
  UNION ALL SELECT page_id, 7, part, 0, CASE part WHEN 0 THEN 'base64_payload' ELSE 'hex_payload' END, left(m, 24) || '... -> ' || left(d, 120), 'high', 'high' FROM encoded WHERE d IS NOT NULL AND {instructs("d")}
  UNION ALL {_phrases(8, "homoglyph_keyword", "seen", "html", KEYWORD, 30, 30, 200, "medium", "medium")}
  UNION ALL SELECT page_id, 9, i, 0, 'json_ld', left(t, 200), 'high', 'high' FROM linked WHERE {instructs("t")}
), findings AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY stage, part, turn) - 1)::INTEGER AS ord, stage, vector, evidence, severity, confidence FROM found
)"""
)


def _score(table: str, points: str, weighty: str, bonus: int, least: int) -> str:
    worth = f"CASE severity {points} ELSE 30 END"
    kinds = f"count(DISTINCT left(evidence, 40)) FILTER (WHERE severity IN ({weighty}))"
    return f"SELECT page_id, least(100, max({worth}) + CASE WHEN {kinds} > 1 AND count(*) >= {least} THEN {bonus} ELSE 0 END)::INTEGER AS score, count(*)::INTEGER AS n FROM {table} GROUP BY page_id"


_STRONG = "'hidden_ai_instruction', 'css_pseudo_content', 'base64_payload', 'hex_payload', 'unicode_tag_block', 'zero_width', 'json_ld', 'css_hidden_text', 'variation_selector'"
_DECIDES = f"CASE WHEN vector IN ({_STRONG}) AND severity IN ('high', 'critical') THEN 0 WHEN vector IN ('semantic_instruction', 'meta_tag', 'homoglyph_keyword') AND regexp_matches(evidence, {_Q('(?i)' + P.REVIEWABLE)}) THEN 1 END"
_POINTS = "WHEN 'informational' THEN 5 WHEN 'low' THEN 15 WHEN 'medium' THEN 45 WHEN 'high' THEN 80"

#: Score, label and deciding finding of each page that has findings.
REDUCED_SQL = (
    PIECES_SQL
    + f", scores AS ({_score('findings', _POINTS + ' WHEN ' + _Q('critical') + ' THEN 95', _Q('medium') + ', ' + _Q('high') + ', ' + _Q('critical'), 10, 1)})"
    + f", tops AS (SELECT * FROM (SELECT *, {_DECIDES} AS rank FROM findings) WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank, ord) = 1)"
    + ", reduced AS (SELECT s.page_id, s.url, coalesce(c.score, 0) AS score, CASE t.rank WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REVIEW' END AS label, coalesce(c.n, 0) AS n_findings, t.vector, t.evidence, t.severity FROM seen s LEFT JOIN scores c USING (page_id) LEFT JOIN tops t USING (page_id))"
)

#: Findings of the older scan: tokens as they are, invisible characters, and the keyword sweep of the visible text.
LEGACY_SQL = (
    PIECES_SQL
    + f", older AS (SELECT page_id, evidence, severity, vector FROM tokens UNION ALL SELECT page_id, evidence, severity, vector FROM unseen UNION ALL SELECT page_id, evidence, severity, vector FROM ({_phrases(3, 'keyword_visible_text', 'seen', 'visible', KEYWORD, 30, 30, 200, 'medium', 'n/a')}))"
    + f", risks AS ({_score('older', _POINTS, _Q('medium') + ', ' + _Q('high'), 15, 2)})"
)

#: Segments that a tag strip reads and the visible text lacks, if they instruct; each once, in order.
DIFF_SQL = (
    PIECES_SQL
    + f", parts AS (SELECT page_id, i, {strip('ps[i]')} AS s FROM (SELECT page_id, string_split_regex(plain, '[.\\n\\r;]+') AS ps FROM seen), unnest(range(1, len(ps) + 1)) AS u(i))"
    + f", missed AS (SELECT page_id, i, s FROM parts JOIN seen USING (page_id) WHERE length(s) >= 8 AND {instructs('s')} AND NOT contains({normal('visible')}, {normal('s')}) QUALIFY row_number() OVER (PARTITION BY page_id, {normal('s')} ORDER BY i) = 1)"
)

#: Sentences of the visible text without invisible characters, and what is removed, in order.
SANITIZE_SQL = (
    REDUCED_SQL
    + f", bare AS (SELECT page_id, visible, regexp_replace(visible, '{_INVISIBLE}', '', 'g') AS b FROM seen)"
    + f", sentences AS (SELECT page_id, i, ps[i] AS s, {instructs('ps[i]')} AS bad FROM (SELECT page_id, regexp_extract_all(b, '[^.\\n]*[.\\n]|[^.\\n]+$') AS ps FROM bare), unnest(range(1, len(ps) + 1)) AS u(i))"
    + f""", removed AS (
  SELECT page_id, 0 AS part, i, CASE vector WHEN 'hidden_form_field' THEN 'hidden:hidden_form_field' WHEN 'sr_only_text' THEN 'hidden:sr_only_text' ELSE 'hidden:css_hidden_text' END AS reason, left(evidence, 200) AS t FROM tokens WHERE vector IN ('hidden_form_field', 'sr_only_text', 'css_hidden_text')
  UNION ALL SELECT page_id, 1, 0, 'invisible_unicode', {quoted(rewrite.INVISIBLE_NOTE)} FROM bare WHERE b <> visible
  UNION ALL SELECT page_id, 2, i, 'stripped_instruction', left({strip('s')}, 200) FROM sentences WHERE bad
), listed AS (
  SELECT page_id, count(*)::INTEGER AS n, '[' || string_agg('{{"reason":"' || reason || '","text":' || to_json(t) || '}}', ',' ORDER BY part, i) || ']' AS removed FROM removed GROUP BY page_id
), cleaned AS (
  SELECT page_id, {strip("regexp_replace(coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE NOT bad), ''), " + _Q(_WHITE) + ", ' ', 'g')")} AS c FROM sentences GROUP BY page_id
)"""
)
