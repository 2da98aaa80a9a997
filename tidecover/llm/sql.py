"""DuckDB SQL equal to those queries that SQL can express."""

from __future__ import annotations

from .quality import COMMON_WORDS

NON_SPACE = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]+"


def quality_sql() -> str:
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON_WORDS.items())
    left = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    share = lambda x, i: f"coalesce({x}[{i}], 0)::DOUBLE / list_sum({x})"

    def js(p: str, q: str) -> str:
        part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
        a, b = share(p, "i"), share(q, "i")
        return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(a, b)} + {part(b, a)}) / 2)), 0))"

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS k FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NON_SPACE}')) AS ls, CASE k {lists} END AS cw FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g) WHERE c > 1),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
c AS (SELECT w.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {left('[#*$%&|<>]')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
    [{left('[ \\t-\\r]')}, {left('[#*$%&|<>]')}, {left('[A-Z]')}, {left('[0-9]')}, {left('[.,;:!?]')}, length(regexp_replace(t, '[ \\t-\\r#*$%&|<>A-Z0-9.,;:!?]', '', 'g'))] AS ch,
    list_transform(cw, lambda x: len(list_filter(ws, lambda y: y = x))) AS c12 FROM w LEFT JOIN h USING (rid)),
f AS (SELECT *, CASE WHEN c12 IS NOT NULL THEN list_append(c12, len(ws) - list_sum(c12)) END AS cm FROM c),
ok AS (SELECT * FROM f WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
p AS (SELECT k, {sums('ch', 6)} AS rch, {sums('cm', 13)} AS rcm FROM ok WHERE k <> 'other' GROUP BY 1 UNION ALL SELECT 'other', {sums('ch', 6)}, NULL FROM ok),
j AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN length(t) > 0 THEN {js('ch', 'rch')} END AS jc, CASE WHEN n_words > 0 AND cm IS NOT NULL THEN {js('cm', 'rcm')} END AS jw FROM f LEFT JOIN p USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_words >= 50 AND coalesce(jc, 0) > 0.285 OR n_words >= 100 AND coalesce(jw, 0) > 0.27) AS kept FROM j"""


def pii_sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "secret": r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({digits})[i] AS INTEGER) ELSE (CAST(reverse({digits})[i] AS INTEGER) * 2) // 10 + (CAST(reverse({digits})[i] AS INTEGER) * 2) % 10 END)) % 10 = 0"
    turned = "concat(replace(m, ' ', '')[5:], replace(m, ' ', '')[1:4])"
    expanded = f"array_to_string(list_transform(string_split({turned}, ''), lambda x: CASE WHEN ascii(x) < 58 THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END), '')"
    mod97 = f"list_reduce(list_transform(string_split({expanded}, ''), lambda x: CAST(x AS INTEGER)), lambda a, b: (a * 10 + b) % 97) = 1"
    near = lambda words: rf"regexp_matches(lower(near), '(?:^|[^a-z])(?:{words})')"
    good = {
        "email": "true",
        "ip": r"list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(x, 18) AS BIGINT), 0) <= 255))",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "ssn": f"NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND {near('ssn|social security')}",
        "secret": f"len(list_distinct(string_split(m, ''))) >= 10 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]') AND {near('key|token|secret|password|passwd|auth|credential')}",
    }
    each = []
    for n, (kind, p) in enumerate(patterns.items()):
        each.append(f"""SELECT rid, {n} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT rid, ms[i] AS m, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, concat(right(ps[i], 40), ' ', left(ps[i + 1], 40)) AS near
            FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d))) WHERE {good[kind]}""")
    listed = lambda cond: f"coalesce(string_agg(concat(kind, ':', CAST(s AS VARCHAR), ':', CAST(e AS VARCHAR)), ',' ORDER BY o, s) FILTER ({cond}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), x AS ({" UNION ALL ".join(each)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({listed('o < 4')}) AS base_sha256, {listed('o IS NOT NULL')} AS spans, count(kind) AS n_spans FROM d LEFT JOIN x USING (rid) GROUP BY rid"""


def decontamination_sql(n: int = 10) -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    cut = lambda t: rf"list_filter(string_split_regex(translate(coalesce({t}, ''), {az}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""WITH b AS (SELECT item_id, {cut('text')} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {n} - 1], ' ') AS win, least(len(ws), {n}) AS m FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {n - 1}, least(len(ws), 1)) + 1)) AS i FROM b)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {cut('text')} AS ws FROM documents),
dw AS (SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hit AS (SELECT rid, i, m, item_id FROM dw JOIN bw USING (m, win)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
it AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""


ORACLE = {"op1_pii": pii_sql(), "op6_quality_rules": quality_sql(), "op8_decontamination": decontamination_sql()}
