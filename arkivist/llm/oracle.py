"""The queries that SQL can express, for DuckDB.  Where it has no checksum, tokenizer, model
or tiling (the other operators and the pipeline), tests hold them against brute force."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
    win AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 20], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS s FROM w)),
    late AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS o FROM win) WHERE o > 1),
    cov AS (SELECT DISTINCT doc_id, s + i AS p FROM (SELECT doc_id, s, unnest(range(0, 20)) AS i FROM late)),
    pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
    kept AS (SELECT pos.doc_id, count(cov.p) AS gone, string_agg(word, ' ' ORDER BY pos.p) FILTER (cov.p IS NULL) AS rest FROM pos LEFT JOIN cov USING (doc_id, p) GROUP BY pos.doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    a AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
    b AS (SELECT *, len(regexp_extract_all(line, {_WORDS})) AS n FROM a),
    c AS (SELECT doc_id, line, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM b WHERE n > 0),
    e AS (SELECT x.doc_id, x.pos, y.pos AS z FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.pos >= x.pos AND y.upto - x.upto + x.n >= 20),
    d AS (SELECT doc_id, list(line ORDER BY pos) AS ls FROM c GROUP BY doc_id),
    k AS (SELECT e.doc_id, pos, z, md5(array_to_string(ls[pos + 1 : z + 1], chr(10))) AS k FROM e JOIN d USING (doc_id)),
    late AS (SELECT doc_id, pos, z FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS o FROM k) WHERE o > 1),
    cov AS (SELECT DISTINCT doc_id, unnest(range(pos, z + 1)) AS pos FROM late),
    gone AS (SELECT c.doc_id, c.i FROM c JOIN cov USING (doc_id, pos)),
    kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.i) AS rest FROM a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
    SELECT l.doc_id, (SELECT count(*) FROM c WHERE c.doc_id = l.doc_id) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = l.doc_id) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM l LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
    reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2, "op9_line_dedup": OP9, "op10_jaccard_join": OP10}
