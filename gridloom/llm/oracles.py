"""DuckDB SQL for the operators that SQL can express; the others have brute-force tests."""

from __future__ import annotations

from .centroids import CLUSTERS, DIM, ROUNDS, SCALE, SEED
from .chat_format import END, START
from .collocations import ABSORBED_PERCENT, MIN_COUNT, TOP
from .license_scan import GAP, GRAM, MIN_SCORE, NOT_WORD, PHRASES, TEMPLATES
from .pii import BASE, CONTEXT_BONUS, IBAN_LENGTH, KINDS, NAMED_BY, NEARBY, PRIOR
from .pii import MIN_SCORE as MIN_PII
from .quality_rules import RULES, SYMBOLS
from .url_filter import RULES as URL_RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 8))}) AS k, lead(x, 7) OVER o AS last FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
c AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM r) GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutter
  FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT ({" OR ".join(f"({r.rejects})" for r in RULES)}) AS kept FROM m
"""


def _url() -> str:
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))]
    case = lambda f: "CASE " + " ".join(f"WHEN {c} THEN '{f(r)}'" for c, r in fits) + " END"
    return rf"""
WITH p AS (SELECT page_id, url, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS ps FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS canonical FROM q),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS v, canonical IN (SELECT canonical FROM l) AS hit FROM c)
SELECT page_id, host, path, rule, v IS NULL AND coalesce(hit, false) AS listed, coalesce(v, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


def _license() -> str:
    rows = ", ".join(f"({t}, '{label}', {len(w)}, {q}, '{' '.join(w[q : q + GRAM])}')" for t, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for q in range(len(w) - GRAM + 1))
    joined = "' ' || array_to_string(ws, ' ') || ' '"
    at = {label: f"list_filter(range(0, len(ws)), lambda i: {' AND '.join(f"ws[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split()))})" for p, label in PHRASES}
    return rf"""
WITH t(t, label, n, q, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '{NOT_WORD}'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT rid, doc_id, len(ws) AS n_words, {", ".join(f"CASE WHEN contains({joined}, ' {p.split()[-1]} ') THEN {at[label]} ELSE [] END AS {label}" for p, label in PHRASES)} FROM d),
u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS p FROM d),
g AS (SELECT rid, p, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS gram FROM u WINDOW o AS (PARTITION BY rid ORDER BY p)),
hits AS (SELECT rid, t, label, n, p, q, p - q AS diagonal FROM g JOIN t USING (gram)),
diag AS (SELECT DISTINCT rid, t, diagonal FROM hits),
runs AS (SELECT rid, t, diagonal, sum(CASE WHEN gap IS NULL OR gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY rid, t ORDER BY diagonal) AS run FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, t ORDER BY diagonal) AS gap FROM diag)),
covered AS (SELECT DISTINCT rid, t, run, label, n, unnest(range(q, q + {GRAM})) AS w FROM hits JOIN runs USING (rid, t, diagonal)),
long AS (SELECT rid, t, run, max(p) + {GRAM} - min(p) AS long FROM hits JOIN runs USING (rid, t, diagonal) GROUP BY 1, 2, 3),
spans AS (SELECT rid, label, count(*) / greatest(any_value(n), any_value(long)) AS score FROM covered JOIN long USING (rid, t, run) GROUP BY rid, t, run, label),
more AS (SELECT rid, list(DISTINCT label) FILTER (score >= {MIN_SCORE}) AS more, max(score) AS score FROM spans GROUP BY 1),
a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places, list_filter([{", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for _, label in PHRASES)}], lambda x: x IS NOT NULL) AS base FROM b LEFT JOIN more USING (rid))
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, round(coalesce(score, 0), 6) AS score FROM a
"""


CHAT = f"""
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (SELECT s.conv_id, perspective, turn, speaker, said, speaker = perspective AS trained,
  '{START}' || CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head FROM s JOIN seats ON s.conv_id IS NOT DISTINCT FROM seats.conv_id),
w AS (SELECT *, head || said || '{END}' || chr(10) AS segment FROM r),
p AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, said ROWS UNBOUNDED PRECEDING) AS stop FROM w)
SELECT conv_id, perspective, turn, speaker, segment, trained, CAST(stop - length(segment) AS BIGINT) AS char_start, CAST(stop AS BIGINT) AS char_end,
  CAST(CASE WHEN trained THEN stop - length(segment) + length(head) END AS BIGINT) AS mask_start, CAST(CASE WHEN trained THEN stop - 1 END AS BIGINT) AS mask_end FROM p
"""



def _centroids(rounds: int = ROUNDS) -> str:
    """k-means in whole numbers, a round after the other."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(d := CAST({d} AS BIGINT), k := k)) AS best FROM v CROSS JOIN c{t} c GROUP BY rid)")
        if t < rounds:
            steps.append(f"s{t} AS (SELECT best.k AS k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t})")
            steps.append(f"m{t} AS (SELECT k, list(x ORDER BY i) AS q FROM (SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM s{t} GROUP BY k, i) GROUP BY k)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN m{t} m USING (k))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, CAST(best.k AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k
"""


def _personal() -> str:
    """Each kind's scan as a token list that covers the text: matches, and what they pass over."""
    domain, digit = "[A-Za-z0-9-]+", "[0-9]"
    email, ip, card = rf"[A-Za-z0-9._%+-]+@{domain}(\.{domain})+", rf"{digit}+(\.{digit}+)(\.{digit}+)(\.{digit}+)", rf"{digit}([\x20-]?{digit})+"
    phone, iban, tel = r"\+[0-9][\x20().0-9-]+[0-9]", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])+", r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CAST(substr(reverse({digits}), CAST(i AS INT), 1) AS INT) * (2 - i % 2) - CASE WHEN i % 2 = 0 AND substr(reverse({digits}), CAST(i AS INT), 1) > '4' THEN 9 ELSE 0 END)) % 10 = 0"
    long = f"map {{{', '.join(f"'{k}': {n}" for k, n in IBAN_LENGTH.items())}}}[substr(x, 1, 2)]"
    moved = "replace(substr(y, 5) || substr(y, 1, 4), ' ', '')"
    values = f"list_transform(string_split({moved}, ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_concat([0], {values}), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"

    def scan(kind: str, form: str, skip: str, needs: str, ok: str, y: str = "x", shift: str = "0") -> str:
        named = ", ".join(f"'{w}'" for w in NAMED_BY[kind])
        near = LOWER.format(f"substr(t, greatest(0, s - {NEARBY}) + 1, least(s, {NEARBY})) || ' ' || substr(t, e + 1, {NEARBY})")
        return f"""
{kind}_tokens AS (SELECT rid, t, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{form}|{skip}') AS l FROM d WHERE regexp_matches(t, '{needs}'))),
{kind}_found AS (SELECT rid, t, y, s + {shift} AS s, s + {shift} + length(y) AS e FROM (SELECT *, {y} AS y FROM (SELECT rid, t, x, CAST(sum(length(x)) OVER (PARTITION BY rid ORDER BY i) - length(x) AS BIGINT) AS s FROM {kind}_tokens) WHERE regexp_full_match(x, '{form}')) WHERE {ok}),
{kind}_all AS (SELECT rid, {KINDS.index(kind)} AS o, '{kind}' AS kind, s, e, CASE WHEN list_has_any(regexp_extract_all({near}, '[a-z]+'), [{named}]) THEN {PRIOR[kind] + CONTEXT_BONUS:.1f} ELSE {PRIOR[kind]:.1f} END AS score FROM {kind}_found)"""

    def apart(kind: str, before: str) -> str:
        return f"{kind}_kept AS (SELECT * FROM {kind}_all a WHERE score >= {MIN_PII} AND NOT EXISTS (SELECT 1 FROM {before} b WHERE b.rid = a.rid AND b.s < a.e AND a.s < b.e))"

    n_digits = f"length({digits}) BETWEEN {{}} AND {{}}"
    cut_off = f"substr(x, 1, list_filter(range(1, length(x) + 1), lambda i: length(replace(substr(x, 1, CAST(i AS INT)), ' ', '')) = {long})[1])"
    scans = [
        scan("email", email, r"[A-Za-z0-9._%+-]+|[^A-Za-z0-9._%+-]+", "@", "true"),
        scan("ip", ip, "[0-9]+|[^0-9]+", "[0-9]", "list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INT) END)) <= 255"),
        scan("card", card, "[0-9]|[^0-9]+", "[0-9]", f"{n_digits.format(12, 19)} AND {luhn}"),
        scan("phone", phone, r"\+|[^+]+", r"\+", n_digits.format(9, 15)),
        scan("iban", iban, "[A-Za-z0-9]+|[^A-Za-z0-9]+", "[A-Z]{2}[0-9]{2}", f"length(y) > 0 AND NOT regexp_matches(substr(t, s + length(y) + 1, 1), '[A-Za-z0-9]') AND {mod97}", y=f"coalesce({cut_off}, '')"),
        scan("ssn", "[0-9-]+", "[^0-9-]+", "[0-9]", "regexp_full_match(x, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND x[1:3] NOT IN ('000', '666') AND x[1:3] < '900' AND x[5:6] <> '00' AND x[8:11] <> '0000'"),
        scan("tel", r"[0-9().\x20-]+", r"[^0-9().\x20-]+", "[0-9]", rf"regexp_full_match(x, '[\x20.-]*{tel}[\x20.-]*')", y=f"regexp_extract(x, '{tel}')", shift=r"length(regexp_extract(x, '^[\x20.-]*'))"),
    ]
    order = "ORDER BY s, o"
    one = "kind || ':' || s || ':' || e"
    base = "kind IN ('email', 'ip', 'card', 'phone')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{",".join(scans)},
base AS MATERIALIZED (SELECT * FROM email_all UNION ALL SELECT * FROM ip_all UNION ALL SELECT * FROM card_all UNION ALL SELECT * FROM phone_all),
{apart("iban", "base")}, with_iban AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM iban_kept),
{apart("ssn", "with_iban")}, with_ssn AS MATERIALIZED (SELECT * FROM with_iban UNION ALL SELECT * FROM ssn_kept),
{apart("tel", "with_ssn")}, spans AS (SELECT * FROM with_ssn UNION ALL SELECT * FROM tel_kept),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg({one}, ',' {order}) FILTER ({base}) AS base_said, string_agg({one}, ',' {order}) AS said, string_agg(CAST(CAST(score AS DECIMAL(3, 1)) AS VARCHAR), ',' {order}) AS scores FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base_said, '')) AS base_sha256, coalesce(said, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (rid)
"""


PHRASES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT rid, lang, unnest(l) AS piece, generate_subscripts(l, 1) AS p FROM (SELECT rid, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS l FROM d)),
u AS (SELECT rid, lang, p, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT rid, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM p)),
w AS (SELECT lang, x AS w1, lead(x, 1) OVER o AS w2, lead(x, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY rid, p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM w WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
cuts AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 c JOIN f1 x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN f1 y ON (y.lang, y.w1) = (c.lang, c.w2)
  WHERE c.f >= {MIN_COUNT} AND NOT EXISTS (SELECT 1 FROM f3 g WHERE g.lang = c.lang AND ((g.w1, g.w2) = (c.w1, c.w2) OR (g.w2, g.w3) = (c.w1, c.w2)) AND 100 * g.f >= {ABSORBED_PERCENT} * c.f)
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f FROM f3 c JOIN f1 x ON (x.lang, x.w1) = (c.lang, c.w1) JOIN f2 y ON (y.lang, y.w1, y.w2) = (c.lang, c.w2, c.w3)
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM f3 c JOIN f2 x ON (x.lang, x.w1, x.w2) = (c.lang, c.w1, c.w2) JOIN f1 y ON (y.lang, y.w1) = (c.lang, c.w3)),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= {TOP}
"""


ORACLES = {"op11_collocations": PHRASES_SQL, "op12_personal_data": _personal(), "op13_centroid_clustering": _centroids(), "op3_license_scan": _license(), "op6_url_filter": _url(), "op9_quality_rules": QUALITY, "op10_chat_format": CHAT}
