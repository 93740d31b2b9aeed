"""DuckDB statements for the queries that SQL can express, written from the operators' parameters."""

from __future__ import annotations

from wayfield.llm import mixing, secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"


def url_rules(rules: list[tuple[str, str, str]]) -> str:
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(map(str, rules))}
), hits AS (
  SELECT page_id, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets() -> str:
    patterns = {"assign": secret_scan.ASSIGN, "access": secret_scan.ACCESS, "hex": secret_scan.HEX, **{c.kind: c.pattern for c in secret_scan.CLASSES}}
    found = ", ".join(f"regexp_extract_all(t, {_quoted(p)}) AS m_{k}, string_split_regex(t, {_quoted(p)}) AS g_{k}" for k, p in patterns.items())
    total = lambda x, n: f"coalesce(list_sum(list_transform({x}[1:{n}], lambda s: len(s))), 0)"
    at = lambda k: f"({total(f'g_{k}', 'i')} + {total(f'm_{k}', '(i - 1)')})"
    span = lambda k: f"list_transform(range(1, len(m_{k}) + 1), lambda i: {{'start': CAST({at(k)} AS BIGINT), 'rank': {secret_scan.KINDS.index(k)}, 'stop': CAST({at(k)} + len(m_{k}[i]) AS BIGINT)}})"
    spans = ", ".join(f"{span(k)} AS s_{k}" for k in patterns)
    table = "[" + ", ".join(f"CAST({w} AS BIGINT)" for w in secret_scan.weights()) + "]"
    extra = []
    for c in secret_scan.CLASSES:
        kinds = lambda p: f"len(regexp_extract_all(m, '{p}'))"
        words = f"({kinds('[0-9]')} = 0 AND ({secret_scan.CAPITALS} * {kinds('[A-Z]')} <= len(m) OR {secret_scan.SMALL} * {kinds('[a-z]')} <= len(m)))"
        suppressed = " OR ".join([words, *(f"regexp_matches(m, {_quoted(r)})" for r in secret_scan.allowed_for(c))])
        chars = f"string_split(substr(m, w + 1, {secret_scan.WINDOW}), '')"
        score = f"list_sum(list_transform(list_distinct({chars}), lambda ch: {table}[len(list_filter({chars}, lambda y: y = ch)) + 1]))"
        hot = f"CASE WHEN {suppressed} THEN [] ELSE list_filter(range(0, len(m) - {secret_scan.WINDOW} + 1), lambda w: {score} <= {secret_scan.hot_sum(c.bits)}) END"
        hots = f"list_transform(m_{c.kind}, lambda m: {hot})"
        rank = secret_scan.KINDS.index(c.kind)
        extra.append(
            f"list_filter(list_transform(list_zip(s_{c.kind}, {hots}), lambda z: {{'start': CAST(z[1].start + list_min(z[2]) AS BIGINT), 'rank': {rank}, 'stop': CAST(z[1].start + list_max(z[2]) + {secret_scan.WINDOW} AS BIGINT)}}), lambda s: s.start IS NOT NULL) AS e_{c.kind}"
        )
    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    joined = lambda x: f"coalesce(array_to_string(list_transform(list_sort({x}), lambda s: {names}[s.rank + 1] || ':' || s.start || ':' || s.stop), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, t, regexp_extract_all(t, {_quoted(secret_scan.ASSIGN)}, 2) AS v, {found} FROM d),
placed AS (SELECT doc_id, v, {", ".join(f"m_{c.kind}" for c in secret_scan.CLASSES)}, {spans} FROM found),
kept AS (SELECT * REPLACE (list_transform(list_filter(list_zip(s_assign, v), lambda z: len(z[2]) >= {secret_scan.MIN_ASSIGNED}), lambda z: z[1]) AS s_assign) FROM placed),
hot AS (SELECT *, {", ".join(extra)} FROM kept)
SELECT doc_id, CAST(len(s_assign) AS BIGINT) AS n_assign, CAST(len(s_access) AS BIGINT) AS n_access, CAST(len(s_hex) AS BIGINT) AS n_hex,
  sha256({joined("list_concat(list_concat(s_assign, s_access), s_hex)")}) AS base_sha256,
  {joined("list_concat(list_concat(list_concat(s_assign, s_access), s_hex), list_concat(" + ", ".join(f"e_{c.kind}" for c in secret_scan.CLASSES) + "))")} AS spans
FROM hot
"""


def mixture(plan: mixing.MixPlan, domain: str) -> str:
    weight = lambda c, w: "CASE " + c + " " + " ".join(f"WHEN '={k}' THEN CAST({v} AS DOUBLE)" for k, v in w.items()) + " ELSE CAST(1 AS DOUBLE) END" if w else "CAST(1 AS DOUBLE)"
    named = lambda c: f"coalesce('=' || CAST({c} AS VARCHAR), '~')"
    place = lambda e: f"md5('{plan.seed}|' || {e} || '|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || digest)"
    parts, above = [], []
    for depth, (level, weights) in enumerate((("dm", plan.domain_weights), ("lg", plan.lang_weights), ("sc", plan.source_weights))):
        keys = ["dm", "lg", "sc"][: depth + 1]
        over, up = (f"PARTITION BY {', '.join(above)} " if above else ""), (f"JOIN give{depth - 1} USING ({', '.join(above)})" if above else "CROSS JOIN root")
        parts.append(f"""
cap{depth} AS (SELECT {", ".join(keys)}, CAST(sum(tokens) * {plan.max_epochs} AS DOUBLE) AS cap, {weight(level, weights)} AS w FROM leaves GROUP BY {", ".join(keys)}),
rank{depth} AS (SELECT *, CASE WHEN w > 0 THEN cap / w END AS ratio FROM cap{depth} {up}),
run{depth} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM rank{depth} WINDOW o AS ({over}ORDER BY ratio NULLS LAST, {level})),
full{depth} AS (SELECT *, coalesce(given - spent >= ratio * open_w, false) AS f FROM run{depth}),
sum{depth} AS (SELECT *, coalesce(sum(cap) FILTER (WHERE f) OVER ({over}), 0) AS taken, coalesce(sum(w) FILTER (WHERE NOT f) OVER ({over}), 0) AS left_w FROM full{depth}),
give{depth} AS (SELECT {", ".join(keys)}, CASE WHEN f THEN cap ELSE least(cap, CASE WHEN left_w > 0 THEN (given - taken) * w / left_w ELSE 0 END) END AS given FROM sum{depth})""")
        above = keys
    return f"""
WITH d AS (SELECT doc_id, lang, source, {domain} AS domain, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS n, md5(coalesce(text, '')) AS digest FROM documents),
keyed AS (SELECT *, {named("domain")} AS dm, {named("lang")} AS lg, {named("source")} AS sc FROM d),
leaves AS (SELECT dm, lg, sc, sum(n) AS tokens FROM keyed GROUP BY 1, 2, 3),
root AS (SELECT least(CAST({plan.budget_share} AS DOUBLE), CAST({plan.max_epochs} AS DOUBLE)) * coalesce(sum(tokens), 0) AS given FROM leaves),
{",".join(parts)},
planned AS (SELECT dm, lg, sc, tokens, CAST(floor(given) AS BIGINT) AS budget, CAST(floor(CAST(floor(given) AS BIGINT) / tokens) AS BIGINT) AS epochs FROM leaves JOIN give2 USING (dm, lg, sc) WHERE tokens > 0),
ordered AS (SELECT k.*, epochs, budget - epochs * tokens AS rest, {place("CAST(epochs AS VARCHAR)")} AS place FROM keyed k JOIN planned USING (dm, lg, sc)),
chosen AS (SELECT *, epochs + CASE WHEN sum(n) OVER (PARTITION BY dm, lg, sc ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, lang, source, domain, n AS n_tokens, CAST(unnest(range(copies)) AS BIGINT) AS epoch FROM chosen
"""


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def inner_products(k: int, every: int) -> str:
    """The k largest inner products of every row whose id ``every`` divides."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def product_codes(parts: int, entries: int, rounds: int) -> str:
    """Integer product quantisation: every part against every entry."""
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, len(embedding) // {parts} AS w
  FROM embeddings WHERE {_SOUND}),
x AS (SELECT vec_id, label, part, x[part * w + 1 : part * w + w] AS p FROM v, (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, f.entry, p AS e FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) f USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT x.vec_id, x.label, x.part, x.p, b{r}.entry,
  CAST(list_sum(list_transform(list_zip(x.p, b{r}.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x JOIN b{r} USING (part)),
a{r} AS MATERIALIZED (SELECT vec_id, label, part, p, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, entry, i, CAST(sum(p[i + 1]) AS BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range((SELECT max(w) FROM v))) AS i) GROUP BY ALL),
m{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    return f"""
WITH {", ".join(steps)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM c, h"""
