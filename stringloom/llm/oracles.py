"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from stringloom.llm import pii, url_filter, vector_codes

EXACT_DEDUP = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
    ), g AS (
        SELECT n, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -length(t), b := doc_id)) AS keep_id FROM d GROUP BY n
    )
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g ON d.n = g.n
"""


def _matches(name: str, source: str, pattern: str) -> str:
    """CTEs that end with `name` (row, start, "end", value): all matches in `t`, by the lengths of what lies between them."""
    return f"""
        {name}_pieces AS (SELECT row, t, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found FROM {source}),
        {name}_rows AS (SELECT row, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM {name}_pieces WHERE len(found) > 0),
        {name} AS (SELECT row, value, CAST(sum(length(gap) + length(value)) OVER w AS INTEGER) - length(value) AS start, CAST(sum(length(gap) + length(value)) OVER w AS INTEGER) AS "end"
            FROM {name}_rows WINDOW w AS (PARTITION BY row ORDER BY i))"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_DIGIT = f"CAST(substr({_DIGITS}, length({_DIGITS}) - i, 1) AS INTEGER)"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGIT} ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{_DIGIT} + 1] END)) % 10 = 0"
_HOLDS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda x: coalesce(TRY_CAST(x AS UBIGINT) <= 255, false)))",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def personal_data() -> str:
    """The base kinds, and terms that disclose them: counts of documents and of texts, shares of information, places."""
    kinds = list(pii.KINDS)
    finds = ",".join(_matches(k, "d", p) for k, (p, _) in pii.PATTERNS.items())
    base = " UNION ALL ".join(f"SELECT row, {i} AS kind, start, \"end\", value FROM {k} WHERE {_HOLDS[k]}" for i, k in enumerate(pii.PATTERNS))
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    span = f"{names}[kind + 1] || ':' || start || ':' || \"end\""
    words = f"list_distinct(list_transform(list_filter(regexp_extract_all(outside, '{pii.TERM}'), lambda x: length(x) >= {pii.SHORTEST}), lambda x: lower(x)))"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), {finds},
        base AS ({base}),
        before AS (SELECT row, start, "end", coalesce(max("end") OVER (PARTITION BY row ORDER BY start, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM base),
        rest AS (SELECT row, string_agg(substr(t, done + 1, start - done), ' ' ORDER BY start) FILTER (WHERE start >= done) || ' ' || substr(any_value(t), max("end") + 1) AS outside FROM before JOIN d USING (row) GROUP BY row),
        words AS (SELECT row, t, r.row IS NOT NULL AS held, {words.replace("outside", "coalesce(outside, t)")} AS terms FROM d LEFT JOIN rest r USING (row)),
        counted AS (SELECT term, count(*) AS documents FROM (SELECT unnest(terms) AS term FROM words) GROUP BY term),
        once AS (SELECT t, count(*) AS n, any_value(terms) AS terms, min(row) AS row FROM words WHERE held GROUP BY t),
        held AS (SELECT DISTINCT t, n, terms, value FROM once JOIN base USING (row)),
        own AS (SELECT value, sum(n) AS contexts FROM held GROUP BY value HAVING count(*) >= {pii.SUPPORT}),
        pairs AS (SELECT t, n, value, contexts, unnest(terms) AS term FROM held JOIN own USING (value)),
        joint AS (SELECT value, contexts, term, sum(n) AS both_n FROM pairs GROUP BY ALL HAVING count(*) >= {pii.SUPPORT}),
        shares AS (SELECT value, term, CASE WHEN log2(total / contexts) > 0 THEN 1 + log2(least(1.0::DOUBLE, both_n::DOUBLE / documents)) / log2(total / contexts) END AS share
                   FROM joint JOIN counted USING (term), (SELECT greatest(2, count(*))::DOUBLE AS total FROM d)),
        hits AS (SELECT t, term, max(CASE WHEN share > {pii.REMOVE} THEN {kinds.index("remove")} ELSE {kinds.index("generalise")} END) AS kind FROM pairs JOIN shares USING (value, term) WHERE share > {pii.GENERALISE} GROUP BY ALL),
        risky AS (SELECT DISTINCT row, t FROM d WHERE t IN (SELECT t FROM hits)), {_matches("terms", "risky", pii.TERM)},
        added AS (SELECT w.row, h.kind, w.start, w."end" FROM terms w JOIN d USING (row) JOIN hits h ON d.t = h.t AND lower(w.value) = h.term
                  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w."end" AND w.start < b."end")),
        based AS (SELECT row, string_agg({span}, ',' ORDER BY kind, start) AS spans, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(pii.PATTERNS))} FROM base GROUP BY row),
        whole AS (SELECT row, string_agg({span}, ',' ORDER BY kind, start) AS spans FROM (SELECT row, kind, start, "end" FROM base UNION ALL SELECT * FROM added) GROUP BY row)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.PATTERNS)}, sha256(coalesce(based.spans, '')) AS base_sha256, coalesce(whole.spans, '') AS spans FROM d LEFT JOIN based USING (row) LEFT JOIN whole USING (row)"""


#: Places where paths of one host part that the SQL follows, one after the other; the query has no such bound.
LEVELS = 6


def url_verdicts() -> str:
    """Rules, and the tree of path templates with its levels one after the other."""
    rules = sorted(url_filter.RULES, key=lambda x: (-len(x[1]), x[1]))
    fits = [(what, own, *own.partition("/")[::2]) for what, own in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN (host = '{r[2]}' OR ends_with(host, '.{r[2]}')) AND starts_with(path, '/{r[3]}') THEN '{r[i]}'" for r in fits) + " END"
    levels = ""
    for k in range(LEVELS):
        levels += f"""
        open{k} AS (SELECT *, parts[level + 1:] AS rest FROM nodes{k} WHERE len(parts) > level),
        ends{k} AS (SELECT host, template, list_transform(list_filter(list_zip(min(rest), max(rest), range(1, 1 + greatest(len(min(rest)), len(max(rest))))),
            lambda p: p[1] IS DISTINCT FROM p[2]), lambda p: p[3])[1] AS differs, min(rest) AS a FROM open{k} GROUP BY host, template),
        common{k} AS (SELECT host, template, CASE WHEN differs IS NULL THEN a ELSE a[1:differs - 1] END AS common FROM ends{k}),
        branches{k} AS (SELECT host, template, rest[1] AS segment, sum(blocked) AS blocked, sum(allowed) AS allowed,
            concat_ws('|', min(len(rest)), max(len(rest)), coalesce(min(rest[2]), ''), coalesce(max(rest[2]), '')) AS shape FROM open{k} GROUP BY ALL),
        whole{k} AS (SELECT host, template, sum(blocked) AS b, sum(allowed) AS a FROM branches{k} GROUP BY ALL),
        judged{k} AS (SELECT *, blocked + allowed > 0 AS labelled, blocked + allowed > 0 AND a + b > blocked + allowed
            AND abs(blocked / greatest(blocked + allowed, 1)::DOUBLE - (b - blocked) / greatest(a + b - blocked - allowed, 1)::DOUBLE)
                <= {url_filter.ERRORS} * sqrt((b + 1.0::DOUBLE) / (a + b + 2) * (1 - (b + 1.0::DOUBLE) / (a + b + 2)) * (1.0::DOUBLE / greatest(blocked + allowed, 1) + 1.0::DOUBLE / greatest(a + b - blocked - allowed, 1))) AS alike
            FROM branches{k} JOIN whole{k} USING (host, template)),
        kin{k} AS (SELECT host, template, shape, count(*) > 1 AS kin FROM judged{k} WHERE alike GROUP BY ALL),
        named{k} AS (SELECT host, template, segment, CASE WHEN len(common) > 0 THEN common ELSE [CASE WHEN alike OR (kin AND NOT labelled) THEN '*' ELSE segment END] END AS names
            FROM judged{k} LEFT JOIN kin{k} USING (host, template, shape) JOIN common{k} USING (host, template)),
        nodes{k + 1} AS (SELECT n.host, parts, blocked, allowed, CASE WHEN len(parts) > level THEN n.template || '/' || array_to_string(names, '/') ELSE n.template END AS template,
            CASE WHEN len(parts) > level THEN level + len(names) ELSE level END AS level
            FROM nodes{k} n LEFT JOIN named{k} m ON n.host = m.host AND n.template = m.template AND len(parts) > level AND parts[level + 1] = m.segment),"""
    strength, prior = url_filter.STRENGTH, url_filter.PRIOR
    return rf"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS given, regexp_extract(substr(rest, 1 + length(regexp_extract(rest, '^[^/?#]*'))), '^[^?#]*') AS path FROM cut),
        hosts AS (SELECT page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
        rows AS (SELECT *, {case(1)} AS rule, {case(0)} AS ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
            lambda x: CASE WHEN regexp_full_match(x, '[0-9a-fA-F-]{{16,}}') THEN '<id>' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END) AS parts FROM hosts),
        nodes0 AS (SELECT host, parts, count(*) FILTER (WHERE ruled = 'block') AS blocked, count(*) FILTER (WHERE ruled = 'allow') AS allowed, '' AS template, 0 AS level FROM rows GROUP BY host, parts), {levels}
        placed AS (SELECT * FROM nodes{LEVELS}),
        shares AS (SELECT host, sum(blocked) / nullif(sum(blocked) + sum(allowed), 0)::DOUBLE AS share FROM placed GROUP BY host, parts[1]),
        by_host AS (SELECT host, (coalesce(sum(share), 0) + {strength} * {prior}::DOUBLE) / (count(share) + {strength}::DOUBLE) AS host_purity FROM shares GROUP BY host),
        known AS (SELECT host, template, (sum(blocked) + {strength} * any_value(host_purity)) / (sum(blocked) + sum(allowed) + {strength}::DOUBLE) AS purity FROM placed JOIN by_host USING (host) GROUP BY host, template)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
        FROM rows JOIN placed USING (host, parts) JOIN known USING (host, template)"""


def filter_audit_sql() -> str:
    """Each document along each order; every count by itself."""
    fails = " ".join(f"WHEN '{f}' THEN {f}" for f in "ABCDE")
    number = " + ".join(f"{f}::INT" for f in "ABCDE")
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        marked AS (SELECT part, len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C,
            regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
            FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, s, substr(o, s, 1) AS f FROM orders, (SELECT unnest(range(1, 6)) AS s)),
        cells AS (SELECT part, A, B, C, D, E, good, toxic, count(*) AS n FROM marked GROUP BY ALL),
        along AS (SELECT part, o, s, f, n, good, toxic, CASE f {fails} END AS fails, {number} AS number,
            (A AND strpos(o, 'A') < s) OR (B AND strpos(o, 'B') < s) OR (C AND strpos(o, 'C') < s) OR (D AND strpos(o, 'D') < s) OR (E AND strpos(o, 'E') < s) AS gone FROM cells, steps),
        counted AS (SELECT part, o, s, f, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND number = 1), 0)::BIGINT AS unique_fails,
            coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost FROM along GROUP BY part, o, s, f)
        SELECT part, o AS filter_order, s::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""


def vector_codes_sql() -> str:
    """The rounds one after the other, each part against each entry of its codebook."""
    parts, entries, last = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    cut = f"v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})]"
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = ""
    for k in range(last + 1):
        rounds += f"""
        a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT vec_id, p, e, {apart} AS d FROM parts JOIN b{k} USING (p)) GROUP BY vec_id, p),"""
        if k < last:
            rounds += f"""
        m{k} AS (SELECT p, e, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS c FROM (SELECT p, e, j, sum(y)::BIGINT AS s, count(*) AS n FROM
            (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM parts JOIN a{k} USING (vec_id, p)) GROUP BY p, e, j) GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e)),"""
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        places AS (SELECT unnest(range({parts})) AS p),
        parts AS MATERIALIZED (SELECT vec_id, p, {cut} AS x FROM kept, places),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {cut} AS c FROM (SELECT * FROM kept ORDER BY vec_id LIMIT {entries}), places), {rounds}
        coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} JOIN kept USING (vec_id) GROUP BY vec_id, label),
        book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b{last})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded, book"""


ORACLES = {"op2_pii": personal_data(), "op3_exact_dedup": EXACT_DEDUP, "op6_url_filter": url_verdicts(), "op11_vector_codes": vector_codes_sql(), "op13_filter_audit": filter_audit_sql()}
