"""SQL for the rows of queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def linked_sets(size: int, percent: int, columns: str) -> str:
    """Sets of word shingles by document, and components by links of ``percent`` of the union."""
    text = _LOWER.format("text")
    return f"""WITH RECURSIVE worded AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 shingled AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(list_slice(w, k, k + {size} - 1), ' ') FOR k IN range(1, len(w) - {size} + 2)]) END AS s FROM worded),
 flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM shingled),
 met AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS shared FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT u, v FROM met WHERE 100 * shared >= {percent} * (nu + nv - shared)),
 edges AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
 reached AS (SELECT DISTINCT u AS node, u AS seen FROM edges UNION SELECT r.node, e.v FROM reached r JOIN edges e ON r.seen = e.u),
 least AS (SELECT node, min(seen) AS component FROM reached GROUP BY node),
 alike AS (SELECT min(doc_id) AS class_id, list_sort(s) AS key FROM shingled WHERE len(s) > 0 GROUP BY list_sort(s)),
 labelled AS (SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id
  FROM shingled LEFT JOIN least ON node = doc_id LEFT JOIN alike ON key = list_sort(s) AND len(s) > 0)
 SELECT doc_id, n_shingles, component_id, {columns} FROM labelled"""


def contamination(window: int = 10) -> str:
    """Words of documents inside any occurrence of a window of a benchmark item."""
    words = "regexp_extract_all(coalesce({0}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("text"))
    return f"""WITH docs AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
 items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
 cut AS (SELECT item, w, least(len(w), {window}) AS size FROM items WHERE len(w) > 0),
 windows AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM cut)),
 sizes AS (SELECT DISTINCT size FROM windows),
 places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size),
 hits AS MATERIALIZED (SELECT doc_id, k, p.size, item FROM (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS words FROM places) p JOIN windows USING (size, words)),
 hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
 found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def product_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of Lloyd's algorithm over whole numbers, for each part of a vector."""
    steps = ["""vectors AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, len(embedding) AS d,
  [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"places AS MATERIALIZED (SELECT r, (k - 1) // (d // {parts}) AS p, (k - 1) % (d // {parts}) AS q, x[k] AS x FROM (SELECT r, d, x, unnest(range(1, d + 1)) AS k FROM vectors))",
             f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, q, x AS c FROM places WHERE r <= {entries})"]
    for t in range(rounds + 1):
        steps.append(f"near{t} AS MATERIALIZED (SELECT r, p, min((d2, e)) AS best FROM (SELECT r, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d2 FROM places JOIN book{t} USING (p, q) GROUP BY r, p, e) GROUP BY r, p)")
        if t < rounds:
            steps.append(f"""book{t + 1} AS MATERIALIZED (SELECT p, e, q, coalesce(new, c) AS c FROM book{t} LEFT JOIN (
  SELECT p, best[2] AS e, q, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS new FROM places JOIN near{t} USING (r, p) GROUP BY ALL) USING (p, e, q))""")
    return f"""WITH {", ".join(steps)},
 coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
 labelled AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM coded JOIN vectors USING (r))
 SELECT *, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, q)) FROM book{rounds}) AS codebooks_sha256 FROM labelled"""
