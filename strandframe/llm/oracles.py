"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from strandframe.llm import secrets


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def linked_secrets(reach: int = secrets.REACH) -> str:
    """Gaps and matches by the same expressions give positions; windows over each document's spans link weak ones."""
    tests = {
        "assign": (secrets.ASSIGN, 2, "length(v) >= 6", "true"),
        "access": (secrets.ACCESS, 0, "length(v) >= 20", "true"),
        "hex": (secrets.HEX, 0, "true", "true"),
        "secret": (secrets.KEY, 0, "length(v) = 40 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')", "has_access"),
        "login": (secrets.LOGIN, 2, "length(v) >= 3", "has_assign"),
        "endpoint": (secrets.ENDPOINT, 0, "true", "has_access OR has_assign"),
    }
    found = " UNION ALL ".join(
        f"SELECT row, {i} AS kind, unnest(range(len(regexp_extract_all(t, {_text(p)})))) AS i, unnest(regexp_extract_all(t, {_text(p)})) AS w, "
        f"unnest(regexp_extract_all(t, {_text(p)}, {g})) AS v, unnest(string_split_regex(t, {_text(p)})[1:len(regexp_extract_all(t, {_text(p)}))]) AS gap FROM d WHERE ({where}) AND regexp_matches(t, {_text(p)})"
        for i, (p, g, _, where) in enumerate(tests.values())
    )
    good = " OR ".join(f"(kind = {i} AND {test})" for i, (_, _, test, _) in enumerate(tests.values()))
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(tests)) + " END"
    before, after = "(PARTITION BY row ORDER BY start, kind ROWS UNBOUNDED PRECEDING)", "(PARTITION BY row ORDER BY start, kind ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = lambda k: f"coalesce(start - max(CASE WHEN kind = {k} THEN stop END) OVER {before} <= {reach}, false) OR coalesce(min(CASE WHEN kind = {k} THEN start END) OVER {after} - stop <= {reach}, false)"
    weak = " OR ".join(f"(kind = {secrets.KINDS.index(k)} AND NOT covered AND ({' OR '.join(f'near{n}' for n in needs)}))" for k, needs in secrets.NEEDS.items())
    joined = lambda where: f"coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){where}, '')"
    base = f"kind < {secrets.BASE}"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.KINDS[: secrets.BASE]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), {_text(secrets.ACCESS)}) AS has_access, regexp_matches(coalesce(text, ''), {_text(secrets.ASSIGN)}) AS has_assign FROM documents),
     f AS ({found}),
     p AS (SELECT row, kind, v, length(w) AS n, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS stop FROM f),
     s AS (SELECT row, kind, {name} AS name, stop - n AS start, stop FROM p WHERE {good}),
     x AS (SELECT *, {near(0)} AS near0, {near(1)} AS near1,
                  coalesce(max(CASE WHEN {base} THEN stop END) OVER {before} > start, false) OR coalesce(min(CASE WHEN {base} THEN start END) OVER {after} < stop, false) AS covered FROM s),
     k AS (SELECT * FROM x WHERE {base} OR {weak})
SELECT d.doc_id, {counts}, sha256({joined(f" FILTER ({base})")}) AS base_sha256, {joined(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN k ON d.row = k.row GROUP BY d.row, d.doc_id"""


def exact_top_k(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    """Products of integers below 2^53 are exact as doubles."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


ORACLES = {"op4_linked_secrets": linked_secrets(), "op6_norm_pruned_top_k": exact_top_k()}
