"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from riskspark.llm.secret_scan import BASE_RULES, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as SQL has them, of version 1: DuckDB has no possessive matches. They differ on key bodies and on logins of over 64 characters; access and hex have the least length apart.
_SQL_PATTERNS = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "pem": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "url_login": r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"}


def _rule(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, k, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: length(g))), 0) AS s, length(found[k]) AS n "
        f"FROM (SELECT doc_id, found, sizes, gaps, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS found, regexp_extract_all(text, {p}, {group}) AS sizes, string_split_regex(text, {p}) AS gaps FROM documents WHERE text IS NOT NULL)) WHERE length(sizes[k]) >= {least}"
    )


def secrets() -> str:
    """Spans of all rules; where each match starts follows from the texts between matches."""
    spans = " UNION ALL ".join(_rule(i, r.kind, _SQL_PATTERNS.get(r.kind, r.pattern), r.group, r.least) for i, r in enumerate(RULES))
    text = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, rank)"
    base = f"rank < {len(BASE_RULES)}"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE_RULES)
    return (
        f"WITH spans AS ({spans}), per AS (SELECT doc_id, {counts}, {text} FILTER ({base}) AS base, {text} AS spans FROM spans GROUP BY doc_id) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN per USING (doc_id)"
    )


def components(n: int = 3, percent: int = 90) -> str:
    """Links by counting shared shingles of each pair, and the smallest document that links reach."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + {n - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}) UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {n - 1}),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


def repeats(window: int = 20) -> str:
    """Words covered by a window that is not the first of its kind."""
    return f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + {window - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w WHERE len(ws) >= {window})),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM later),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def ranked(top: int = 50) -> str:
    """Scores of every document for every item, summed term by term."""
    terms = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM n, s),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""


def phrases(threshold: int = 10, most: int = 3, covered: int = 50, top: int = 2000) -> str:
    """Counts of all phrases, the least score of their cuts, and the phrases that longer ones do not cover."""
    sizes = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})" for n in range(1, most + 1))
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, size, phrase, count(*) AS f FROM ({sizes}) GROUP BY 1, 2, 3 HAVING count(*) >= {threshold}),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
cuts AS (SELECT lang, size, phrase, a, ws, k, array_to_string(list_slice(ws, 1, k), ' ') AS x, array_to_string(list_slice(ws, k + 1, size), ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.phrase = x JOIN f AS r ON r.lang = cuts.lang AND r.phrase = y),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT lang, ws, a, size, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY 1, 2),
ranked AS (SELECT least.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least LEFT JOIN within USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {covered} * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}"""
