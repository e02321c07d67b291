"""SQL that computes the same results in DuckDB, composed from the same fixed values."""

from __future__ import annotations

from .functions import lexicons as L
from .plans.spec import RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(template: str) -> str:
    return _text(template.format(s=r"\s", b=r"\b", e=r"\b", p=""))


def _phrases(names: list[str], of: str = "low") -> str:
    return "(" + " + ".join(f"CAST(contains({of}, {_text(p)}) AS INTEGER)" for p in names) + ")"


def _sat(x: str, scale: float) -> str:
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE 1 - exp(-({x}) / {float(scale)}) END)"


def _units(x: str) -> str:
    """Length in UTF-16 units: signs beyond the basic plane count twice."""
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _n(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, {pattern}))"


_WORD = r"'[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'"
_PLAIN = r"'[\p{L}\p{N}]+'"
_EMOJI = _text(L.EMOJI)
_BULLET = "^(?:" + "|".join(g for g in L.BULLET_GLYPHS if g not in L.SPACED_GLYPHS) + r"|[\-—\*] )"
_SHOUT = r"(?:^|[^\p{L}])(?:\p{Lu}{5,}|" + "|".join(L.SHOUTED_WORDS) + r")(?:[^\p{L}]|$)"
_TRIM = "trim({}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160))"


def feature_ctes(source: str, links: str = "0") -> str:
    """WITH clause whose last table f has id, the 27 features and word_count. source: a query of id and t (and the number of links, by that name)."""
    shouted = r"(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 4 AND regexp_replace({0}, '[^\p{{L}}]', '', 'g') = upper(regexp_replace({0}, '[^\p{{L}}]', '', 'g')))"
    per = lambda x, scale: _sat(f"(100.0 * ({x}) / greatest(word_count, 1))", scale)
    tail = "list_aggregate(ls[greatest(len(ls) - 1, 1):], 'string_agg', ' ')"
    values = {
        "bulletLineRatio": "coalesce(bullet / nullif(n_lines, 0), 0.0)",
        "emojiDensity": _sat(f"(100.0 * {_n(_EMOJI)} / greatest({_units('t')}, 1))", 1.5),
        "oneSentencePerLineRatio": "coalesce(single / nullif(n_lines, 0), 0.0)",
        "shortLineRatio": "coalesce(short / nullif(n_lines, 0), 0.0)",
        "hookPattern": f"""CASE WHEN len(ls) >= 2 AND hook_at < len(raw) AND {_TRIM.format('raw[hook_at + 1]')} = ''
            THEN least(1.0, 0.5 + CASE WHEN {_units('ls[1]')} <= 60 THEN 0.2 ELSE 0 END + CASE WHEN {_units('ls[1]')} <= 30 THEN 0.2 ELSE 0 END
              + CASE WHEN regexp_matches(ls[1], '[?:.]$') OR {_n(_EMOJI, 'ls[1]')} > 0 THEN 0.1 ELSE 0 END) ELSE 0.0 END""",
        "lineUniformity": f"CASE WHEN n_lines >= 3 THEN least(1.0, greatest(0.0, 1 - {_sat('line_spread', 30)})) ELSE 0.0 END",
        "shoutingRatio": "coalesce(shouts / nullif(n_lines, 0), 0.0)",
        "hookOpeners": _sat(_phrases(L.HOOK_OPENERS), 1.5),
        "hyperbole": _sat(_phrases(L.HYPERBOLE), 1.5),
        "corporateFiller": _sat(_phrases(L.CORPORATE_FILLER), 1.5),
        "llmTells": _sat(_phrases(L.LLM_TELLS), 1.5),
        "emDashDensity": per(_n("'—'"), 1.2),
        "antithesis": _sat("(" + " + ".join(f"CAST(regexp_matches(t, {_re(p)}) AS INTEGER)" for p in L.ANTITHESIS) + ")", 1.2),
        "tricolon": "CASE WHEN coalesce(best_run, 0) < 3 THEN 0.0 ELSE least(1.0, 0.6 + (best_run - 3) * 0.2) END",
        "sentenceUniformity": f"CASE WHEN coalesce(n_sentences, 0) >= 3 THEN least(1.0, greatest(0.0, 1 - {_sat('sentence_spread', 6)})) ELSE 0.0 END",
        "numberDensity": per("coalesce(numbers, 0)", 2.5),
        "entityDensity": per("coalesce(entities, 0)", 4),
        "citationDensity": _sat(links, 1),
        "vagueness": _sat(_phrases(L.VAGUE_QUANTIFIERS), 2),
        "firstPersonRatio": "first_person / greatest(first_person + second_person, 1)",
        "prescriptiveness": per(" + ".join(_n(_re(p)) for p in L.PRESCRIPTIVE), 2),
        "ctaPhrases": _sat(_phrases(L.ENGAGEMENT_CTA), 1.5),
        "authorityBait": _sat(_phrases(L.AUTHORITY_BAIT), 1),
        "questionDensity": per(_n(r"'\?'"), 3),
        "closingHook": f"""CASE WHEN len(ls) = 0 THEN 0.0 ELSE least(1.0, CASE WHEN regexp_matches(lower({tail}), '[?]\\s*$') THEN 0.4 ELSE 0 END
            + CASE WHEN {_phrases(L.ENGAGEMENT_CTA, f'lower({tail})')} > 0 THEN 0.5 ELSE 0 END + CASE WHEN {_n(_EMOJI, tail)} > 0 THEN 0.1 ELSE 0 END
            + CASE WHEN regexp_matches({_TRIM.format('low')}, '(?:#\\w+\\s*){{3}}$') THEN 0.2 ELSE 0 END) END""",
        "pointerEmoji": _sat(_n(_text(L.POINTER)), 1),
        "hashtagDensity": _sat(_n(r"'#[\p{L}\p{N}_]+'"), 3),
    }
    columns = ",\n  ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in values.items())
    return rf"""
source AS ({source}), base AS (
  SELECT id, coalesce(t, '') AS t, lower(coalesce(t, '')) AS low, string_split(coalesce(t, ''), chr(10)) AS raw{', ' + links if links != '0' else ''} FROM source
), bare AS (
  SELECT *, list_filter(list_transform(raw, lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ls,
    list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '[\x01\n]+'), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ss,
    regexp_extract_all(low, {_WORD}) AS ws, list_position(list_transform(raw, lambda x: {_TRIM.format('x')} <> ''), true) AS hook_at FROM base
), line AS (
  SELECT id, unnest(ls) AS l FROM bare
), line_facts AS (
  SELECT id, count(*) AS n_lines, count(*) FILTER (regexp_matches(l, {_text(_BULLET)})) AS bullet,
    count(*) FILTER ({_n("'[.!?]'", 'l')} <= 1) AS single, count(*) FILTER ({_units('l')} < 40) AS short, stddev_pop({_units('l')}) AS line_spread,
    count(*) FILTER (regexp_matches(l, '[!?]{{2}}[^\p{{L}}\p{{N}}]*$') OR {shouted.format('l')} OR (regexp_matches(l, '\p{{Ll}}') AND regexp_matches(l, {_text(_SHOUT)}))) AS shouts
  FROM line GROUP BY id
), sentence AS (
  SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM bare
), counted AS (
  SELECT id, s, i, {_n(_PLAIN, 's')} AS c FROM sentence
), turned AS (
  SELECT *, c BETWEEN 1 AND 7 AS brief, lag(c) OVER w AS last_c, coalesce(lag(c BETWEEN 1 AND 7) OVER w, false) AS last_brief FROM counted WINDOW w AS (PARTITION BY id ORDER BY i)
), streaks AS (
  SELECT *, sum(CASE WHEN brief AND last_brief AND abs(c - last_c) <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS streak FROM turned
), best AS (
  SELECT id, max(n) AS best_run FROM (SELECT id, streak, count(*) FILTER (brief) AS n FROM streaks GROUP BY id, streak) GROUP BY id
), sentence_facts AS (
  SELECT id, count(*) AS n_sentences, stddev_pop(c) AS sentence_spread,
    sum(CASE WHEN {shouted.format('s')} THEN 0 ELSE len(list_filter(regexp_extract_all(s, {_re(L.CAPITALS)}),
      lambda r: NOT starts_with(s, r) OR regexp_matches({_TRIM.format('r')}, '\s') OR regexp_matches(r, '[A-Z]{{2,}}|\d'))) END) AS entities
  FROM counted GROUP BY id
), number_facts AS (
  SELECT id, sum(len(regexp_extract_all(regexp_replace({_TRIM.format('x')}, '^\s*\d{{1,2}}[.)]\s+', ''), {_re(L.NUMBER)}))) AS numbers
  FROM (SELECT id, unnest(raw) AS x FROM base) GROUP BY id
), facts AS (
  SELECT *, CAST(len(ws) AS INTEGER) AS word_count, len(list_filter(ws, lambda x: x IN ('i', 'my', 'me', 'mine'))) AS first_person,
    len(list_filter(ws, lambda x: x IN ('you', 'your', 'yours'))) AS second_person
  FROM bare LEFT JOIN line_facts USING (id) LEFT JOIN sentence_facts USING (id) LEFT JOIN best USING (id) LEFT JOIN number_facts USING (id)
), f AS (
  SELECT id, word_count, {columns}
  FROM facts
)"""


DOCUMENTS = "SELECT doc_id AS id, text AS t FROM documents"


def score_ctes(source: str = DOCUMENTS, links: str = "0") -> str:
    """feature_ctes and tables `scored` (f with total, score, verdict, confidence, uncertain) and `reasons` (ranked signals)."""
    total = " + ".join(f"{k} * {RULES.weights[k]}" for k in L.KEYS if RULES.weights[k])
    logistic = lambda x: f"(1 / (1 + exp(-{RULES.steepness} * (({x}) - {RULES.bias}))))"
    parts = " UNION ALL ".join(
        f"SELECT id, verdict, {i} AS place, {_text(k)} AS key, {_text(label)} AS label, {k} * {RULES.weights[k]} AS weight, abs({k} * {RULES.weights[k]}) * {RULES.informativeness(k)!r} AS rank FROM scored WHERE {k} <> 0"
        for i, (k, _, _, label, _, _) in enumerate(L.FEATURES)
        if RULES.weights[k]
    )
    return f"""{feature_ctes(source, links)}, summed AS (
  SELECT *, {total} AS total FROM f
), rated AS (
  SELECT *, CASE WHEN word_count < {RULES.least_words} AND NOT (ctaPhrases > 0.5 AND closingHook > 0.5)
    THEN {logistic('0.0')} + ({logistic('total')} - {logistic('0.0')}) * word_count / {float(RULES.least_words)} ELSE {logistic('total')} END AS score FROM summed
), scored AS (
  SELECT *, CASE WHEN score >= {RULES.red} THEN 'red' WHEN score <= {RULES.green} THEN 'green' ELSE 'yellow' END AS verdict,
    least(1.0, least(abs(score - {RULES.green}), abs(score - {RULES.red})) / 0.25) AS confidence,
    abs(score - {RULES.green}) < {RULES.margin} OR abs(score - {RULES.red}) < {RULES.margin} AS uncertain FROM rated
), parts AS ({parts}
), reasons AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN sign(weight) = CASE WHEN verdict = 'green' THEN -1 ELSE 1 END THEN 0 ELSE 1 END, rank DESC, place) AS position FROM parts
)"""


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({k}, 6) AS {k}" for k in names)
