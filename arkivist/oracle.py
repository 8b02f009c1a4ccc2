"""The registered queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from arkivist.queries import HOST, NOW, PART_HOST


def _docs(name: str = "docs", missing: int = 0) -> str:
    sha = f"CASE WHEN doc_id % {missing} <> 0 THEN sha256(text) END" if missing else "sha256(text)"
    return f"""{name} AS (SELECT source AS hostname, '/mnt/' || lang AS mount_point, doc_id AS mtime, 'linux' AS os,
        'd' || (doc_id % 7) || '/' || (doc_id % 5) || '/doc' || doc_id AS path_norm, 1000 + doc_id % 50 AS scanned_at,
        {sha} AS sha512, strlen(text)::BIGINT AS size, lang AS volume, text FROM documents)"""


_PENDING = "SELECT * FROM docs WHERE sha512 IS NULL AND size IN (SELECT size FROM docs GROUP BY size HAVING count(*) > 1)"

_WALK = """walk AS (SELECT hostname, mount_point, mtime, os, path_norm || CASE WHEN mtime % 11 = 0 THEN '.new' ELSE '' END AS path_norm, 2000::BIGINT AS scanned_at,
        CASE WHEN mtime % 5 = 0 THEN size + 1 ELSE size END AS size, volume FROM docs),
    old AS (SELECT hostname, volume, path_norm || CASE WHEN mtime % 13 = 0 THEN '.old' ELSE '' END AS path_norm, mtime, scanned_at, CASE WHEN mtime % 4 <> 0 THEN sha512 END AS sha512, size FROM docs)"""

_KEEPS = "w.size = o.size AND w.mtime = o.mtime"

_EVENTS = """ev AS (SELECT 'h' || (user_id % 3) AS hostname, 'v' || (user_id % 2) AS volume, event_type || '/u' || user_id AS path_norm, '/m' || (event_id % 9) AS mount_point,
        event_id AS seq, (floor(value * 100)::BIGINT % 50) AS scanned_at, CASE WHEN event_id % 4 <> 0 THEN sha256(props) END AS sha, strlen(props)::BIGINT AS size FROM events),
    st AS (SELECT *, sha IS NOT NULL AND coalesce(scanned_at >= max(scanned_at) OVER pr, true) AS acc FROM ev
        WINDOW pr AS (PARTITION BY hostname, volume, path_norm ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    bf AS (SELECT *, row_number() OVER (PARTITION BY hostname, volume, path_norm ORDER BY seq) AS n,
        coalesce(last_value(CASE WHEN acc THEN sha END IGNORE NULLS) OVER pr, first_value(sha IGNORE NULLS) OVER pr) AS before FROM st
        WINDOW pr AS (PARTITION BY hostname, volume, path_norm ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""



def _trees(pre: str = "", later: bool = False) -> str:
    """CTEs files, dirs and nodes (with a prefix) of the parts' trees."""
    content = "CASE WHEN p_size % 10 = 0 THEN p_name ELSE 'part ' || ((g * 10 + s * 2 + f) // 3) END"
    if later:
        content = f"CASE WHEN p_size = 7 THEN 'new ' || p_partkey ELSE {content} END"
    return f"""{pre}parts AS (SELECT p_partkey, p_name, p_size, p_partkey % 100 AS r, p_partkey // 100 AS g, (p_partkey % 100 // 10) % 5 AS s, p_partkey % 100 // 50 AS f
        FROM part {"WHERE p_size <> 8" if later else ""}),
    {pre}own AS (SELECT 'Brand#' || (11 + r % 5) AS hostname, CASE WHEN r % 5 = 4 THEN 'x' ELSE 'v' END || ((r // 5) % 2) AS volume, 't' || (g % 4) AS t, 'g' || g AS a, 's' || s AS k, 'f' || f AS f,
        p_size, p_partkey, {content} AS content FROM {pre}parts),
    {pre}sized AS (SELECT *, t || '/' || a || '/' || k || '/' || f AS path, (length(content) + CASE WHEN p_size = 49 THEN p_partkey * 1000 ELSE 0 END)::BIGINT AS size,
        CASE WHEN p_size < 48 THEN sha256(content) END AS sha512 FROM {pre}own),
    {pre}files AS (SELECT *, coalesce('F:' || sha512, CASE WHEN count(*) OVER (PARTITION BY size) > 1 THEN 'X:' ELSE 'U:' END || hostname || ':' || volume || ':' || path) AS sig FROM {pre}sized),
    {pre}d3 AS (SELECT hostname, volume, t, a, k, 'D:' || sha256(string_agg(f || chr(0) || sig || chr(0), '' ORDER BY f)) AS sig, sum(size)::BIGINT AS size, count(*) AS n FROM {pre}files GROUP BY ALL),
    {pre}d2 AS (SELECT hostname, volume, t, a, 'D:' || sha256(string_agg(k || chr(0) || sig || chr(0), '' ORDER BY k)) AS sig, sum(size)::BIGINT AS size, sum(n)::BIGINT AS n FROM {pre}d3 GROUP BY ALL),
    {pre}d1 AS (SELECT hostname, volume, t, 'D:' || sha256(string_agg(a || chr(0) || sig || chr(0), '' ORDER BY a)) AS sig, sum(size)::BIGINT AS size, sum(n)::BIGINT AS n FROM {pre}d2 GROUP BY ALL),
    {pre}d0 AS (SELECT hostname, volume, 'D:' || sha256(string_agg(t || chr(0) || sig || chr(0), '' ORDER BY t)) AS sig, sum(size)::BIGINT AS size, sum(n)::BIGINT AS n FROM {pre}d1 GROUP BY ALL),
    {pre}dirs AS (SELECT hostname, volume, t || '/' || a || '/' || k AS path, sig, size, n, '1' || t || chr(0) || '1' || a || chr(0) || '1' || k || chr(0) || '2' AS ok FROM {pre}d3
        UNION ALL SELECT hostname, volume, t || '/' || a, sig, size, n, '1' || t || chr(0) || '1' || a || chr(0) || '2' FROM {pre}d2
        UNION ALL SELECT hostname, volume, t, sig, size, n, '1' || t || chr(0) || '2' FROM {pre}d1 UNION ALL SELECT hostname, volume, '', sig, size, n, '2' FROM {pre}d0),
    {pre}nodes AS (SELECT hostname, volume, path, 'dir' AS kind, sig, size, n, ok FROM {pre}dirs
        UNION ALL SELECT hostname, volume, path, 'file', sig, size, 1, '1' || t || chr(0) || '1' || a || chr(0) || '1' || k || chr(0) || '0' || f FROM {pre}files)"""


_TREES = _trees()

_KEY = "hostname || ':' || volume || ':' || CASE WHEN path = '' THEN '<root>' ELSE path END"

_COVER = (
    _TREES
    + f""",
    numbered AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY sig ORDER BY hostname, volume, ok) AS member_idx, count(*) OVER (PARTITION BY sig) AS copies FROM nodes),
    ranks AS (SELECT sig, kind AS gkind, size AS size_each, n AS file_count_each, row_number() OVER (ORDER BY CASE WHEN path = '' THEN 0 ELSE length(path) - length(replace(path, '/', '')) + 1 END,
        size DESC, hostname, volume, ok) AS rank FROM numbered WHERE member_idx = 1 AND copies > 1),
    members AS (SELECT m.*, gkind, size_each, file_count_each, rank FROM numbered m JOIN ranks USING (sig)),
    covering AS (SELECT DISTINCT m.hostname, m.volume, m.path, m.kind FROM members m JOIN members t ON t.kind = 'dir' AND t.hostname = m.hostname AND t.volume = m.volume AND t.rank < m.rank
        AND m.path <> '' AND (t.path = '' OR starts_with(m.path, t.path || '/'))),
    flagged AS (SELECT m.*, c.kind IS NOT NULL AS covered FROM members m LEFT JOIN covering c ON c.hostname = m.hostname AND c.volume = m.volume AND c.path = m.path AND c.kind = m.kind),
    shown AS (SELECT *, NOT bool_and(covered) OVER (PARTITION BY sig) AS reported FROM flagged),
    rep AS (SELECT * FROM shown WHERE reported)"""
)


def _plan(rule: str, host: str) -> str:
    """CTEs that end in del: what a rule deletes on a host."""
    name, _, value = rule.partition("=")
    if rule in ("first", "shortest-path"):
        order = "member_idx" if rule == "first" else "length(path), member_idx"
        keep = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY {order}) AS o FROM rep) WHERE o = 1"
    else:
        column = "hostname" if name == "host" else name
        keep = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sig) AS o FROM rep WHERE {column} = '{value}') WHERE o = 1"
    return _COVER + f""",
    keep AS ({keep}),
    del AS (SELECT r.*, k.key AS keep_key, k.hostname AS kh, k.volume AS kv, k.path AS kp FROM rep r JOIN keep k USING (sig) WHERE r.member_idx <> k.member_idx AND r.hostname = '{host}')"""


def _plan_rows(rule: str, host: str = PART_HOST) -> str:
    return f"WITH {_plan(rule, host)} SELECT sig, gkind AS kind, member_idx, hostname, volume, path, keep_key FROM del"


_GONE = """gone AS (SELECT DISTINCT f.* FROM files f JOIN del d ON d.hostname = f.hostname AND d.volume = f.volume
        AND ((d.gkind = 'file' AND f.path = d.path) OR (d.gkind = 'dir' AND (d.path = '' OR f.path = d.path OR starts_with(f.path, d.path || '/')))))"""


def _relative(top: str, path: str) -> str:
    return f"CASE WHEN {top} = '' THEN {path} ELSE substr({path}, length({top}) + 2) END"


def _bytes(b: str) -> str:
    out = f"CASE WHEN {b} < 1024 THEN {b}::BIGINT || ' B'"
    for i, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        text = f"printf('%.2f {unit}', {b} / {1024**i}.0::DOUBLE)"
        out += f" ELSE {text} END" if unit == "PB" else f" WHEN {b} < {1024 ** (i + 1)} THEN {text}"
    return out


def oracle_sql() -> dict[str, str]:
    url = r"regexp_replace(url, '^[a-z]+://', '')"
    raw = rf"CASE WHEN page_id % 2 = 0 THEN './' || replace({url}, '/', '\') || '\' ELSE './/Photos/' || {url} || '//' END"
    clean = r"regexp_replace(regexp_replace(replace(raw, '\', '/'), '/+', '/', 'g'), '^\./', '')"
    docs, holes3 = _docs(), _docs(missing=3)
    # The log's appends (n) in order; a tombstone takes away what a key had before it.
    replayed = f"""WITH {docs}, log AS (SELECT 1 AS n, hostname, volume, path_norm, mtime, size, scanned_at, NULL AS sha FROM docs
        UNION ALL SELECT 2, hostname, volume, path_norm, mtime, size, scanned_at - mtime % 3, CASE WHEN mtime % 4 <> 0 THEN sha512 END FROM docs
        UNION ALL SELECT 3, hostname, volume, path_norm, mtime, size + 1, scanned_at, CASE WHEN mtime % 5 = 0 THEN sha256(path_norm) END FROM docs
        UNION ALL SELECT 5, hostname, volume, path_norm, mtime, size, scanned_at, sha512 FROM docs WHERE mtime % 34 = 0),
        live AS (SELECT * FROM log WHERE n = 5 OR mtime % 17 <> 0),
        st AS (SELECT *, sha IS NOT NULL AND coalesce(scanned_at >= max(scanned_at) OVER (PARTITION BY hostname, volume, path_norm ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS acc FROM live)
        SELECT hostname, volume, path_norm, arg_max(size, (scanned_at, n)) AS size, coalesce(arg_max(sha, n) FILTER (acc), arg_min(sha, n) FILTER (sha IS NOT NULL)) AS sha512, max(scanned_at) AS scanned_at FROM st GROUP BY ALL"""
    return {
        "normalize_paths": f"""WITH p AS (SELECT page_id, (['linux', 'darwin', 'MSWin32'])[page_id % 3 + 1] AS os, {raw} AS raw FROM pages),
            q AS (SELECT page_id, os, {clean} AS c FROM p), r AS (SELECT page_id, os, CASE WHEN c = '/' THEN c ELSE regexp_replace(c, '/$', '') END AS c FROM q)
            SELECT page_id, os, CASE WHEN os <> 'linux' THEN lower(c) ELSE c END AS path_norm FROM r""",
        "path_depth_ancestors": f"""WITH {docs} SELECT hostname, path_norm, len(string_split(path_norm, '/'))::BIGINT AS depth, string_split(path_norm, '/')[-1] AS name,
            array_to_string(list_transform([2, 1, 0], lambda i: array_to_string(string_split(path_norm, '/')[1:i], '/')), '|') AS ancestors,
            hostname || ':' || volume || ':' || path_norm AS key FROM docs""",
        "format_values": f"""WITH o AS (SELECT o_orderkey, (floor(o_totalprice)::BIGINT * o_orderkey) % 99999999999 AS n FROM orders), p AS (SELECT *, n % 500000 AS s FROM o)
            SELECT o_orderkey, {_bytes("n")} AS bytes_text, CASE WHEN s < 60 THEN s || 's' WHEN s >= 3600 THEN (s // 3600) || 'h' || printf('%02d', (s % 3600) // 60) || 'm'
            ELSE ((s % 3600) // 60) || 'm' || printf('%02d', s % 60) || 's' END AS duration_text FROM p""",
        "size_histogram": f"WITH {docs} SELECT size, count(*) AS n FROM docs GROUP BY size",
        "size_collisions": f"WITH {docs} SELECT hostname, volume, path_norm, size FROM docs WHERE size IN (SELECT size FROM docs GROUP BY size HAVING count(*) > 1)",
        "missing_hash_warning": f"""WITH {holes3}, p AS ({_PENDING}) SELECT (SELECT count(*) FROM p) AS n_missing,
            (SELECT coalesce(string_agg(key, ',' ORDER BY hostname, volume, path_norm), '') FROM (SELECT *, hostname || ':' || volume || ':' || path_norm AS key FROM p ORDER BY hostname, volume, path_norm LIMIT 5)) AS examples""",
        "catalog_load": f"""WITH {docs}, v AS (SELECT hostname, volume, min(mount_point) AS mount_point, max(scanned_at) AS volume_scanned_at FROM docs GROUP BY ALL)
            SELECT d.hostname, d.volume, path_norm, size, sha512, v.mount_point, volume_scanned_at FROM docs d JOIN v USING (hostname, volume)""",
        "scan_decisions": f"""WITH {docs}, {_WALK} SELECT w.hostname, w.volume, w.path_norm, w.size, CASE WHEN {_KEEPS} THEN o.sha512 END AS sha512, coalesce({_KEEPS}, false) AS unchanged,
            (CASE WHEN {_KEEPS} THEN o.sha512 END) IS NULL AS needs_hash FROM walk w LEFT JOIN old o USING (hostname, volume, path_norm)""",
        "scan_upsert": f"""WITH {docs}, {_WALK} SELECT hostname, volume, path_norm, coalesce(w.size, o.size) AS size, coalesce(w.mtime, o.mtime) AS mtime,
            coalesce(CASE WHEN {_KEEPS} THEN o.sha512 END, o.sha512) AS sha512, coalesce(w.scanned_at, o.scanned_at) AS scanned_at FROM walk w FULL JOIN old o USING (hostname, volume, path_norm)""",
        "quick_scan_hash": f"WITH {_docs(missing=2)} SELECT hostname, volume, path_norm, size, sha256(text) AS sha512 FROM ({_PENDING})",
        "file_dup_groups": f"""WITH {docs}, n AS (SELECT *, row_number() OVER (PARTITION BY sha512 ORDER BY hostname, volume, string_split(path_norm, '/')) AS i, count(*) OVER (PARTITION BY sha512) AS c FROM docs)
            SELECT 'F:' || sha512 AS sig, c AS copies, size, hostname || ':' || volume || ':' || path_norm AS first_key FROM n WHERE i = 1 AND c > 1 AND size >= 50""",
        "keep_candidates": f"""WITH {_docs(missing=5)}, n AS (SELECT *, row_number() OVER (PARTITION BY sha512 ORDER BY hostname, volume, string_split(path_norm, '/')) AS member_idx, count(*) OVER (PARTITION BY sha512) AS copies
            FROM docs WHERE sha512 IS NOT NULL)
            SELECT sha512, copies, hostname, volume, path_norm AS path, member_idx, CASE WHEN member_idx = 1 THEN 'KEEP-CANDIDATE:' ELSE 'DUPLICATE:' END AS tag FROM n WHERE copies > 1""",
        "dir_totals": f"""WITH {docs}, up AS (SELECT hostname, volume, size, unnest(list_transform([2, 1, 0], lambda i: array_to_string(string_split(path_norm, '/')[1:i], '/'))) AS path FROM docs)
            SELECT hostname, volume, path, sum(size)::BIGINT AS size, count(*) AS n_files FROM up GROUP BY ALL""",
        "dir_signatures": f"WITH {_TREES} SELECT hostname, volume, path, sig FROM dirs",
        "dir_dup_groups": f"""WITH {_TREES}, n AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY hostname, volume, ok) AS i, count(*) OVER (PARTITION BY sig) AS c FROM dirs)
            SELECT sig, c AS copies, size, n AS n_files, {_KEY} AS first_key FROM n WHERE i = 1 AND c > 1""",
        "coverage_report": f"WITH {_COVER} SELECT sig, gkind AS kind, size_each, file_count_each, member_idx, key, covered AS covered_by_ancestor FROM rep",
        "merge_catalogs": f"""WITH {_EVENTS}, g AS (SELECT hostname, volume, path_norm, max(scanned_at) AS top, arg_max(size, (scanned_at, seq)) AS size, arg_max(seq, (scanned_at, seq)) AS mtime,
            coalesce(arg_max(seq, seq) FILTER (acc), arg_min(seq, seq) FILTER (sha IS NOT NULL)) AS pick FROM st GROUP BY ALL)
            SELECT g.hostname, g.volume, g.path_norm, g.path_norm AS path, g.size, g.mtime, e.sha AS sha512, g.top AS scanned_at, coalesce(e.scanned_at < g.top, false) AS sha_from_older_scan
            FROM g LEFT JOIN ev e ON e.seq = g.pick""",
        "merge_counters": f"WITH {_EVENTS} SELECT count(*) AS total, count(*) FILTER (n > 1) AS conflicts, count(*) FILTER (before IS NOT NULL AND sha IS NOT NULL AND before <> sha) AS hash_disagreements FROM bf",
        "merge_volumes": f"WITH {_EVENTS} SELECT hostname, volume, arg_min(mount_point, seq) AS mount_point, 'linux' AS os, {NOW}::BIGINT AS scanned_at FROM ev GROUP BY hostname, volume",
        "hash_disagreements": f"WITH {_EVENTS} SELECT hostname, volume, path_norm, before AS known_sha512, sha AS sha512 FROM bf WHERE before <> sha",
        "rehash_worklist": f"WITH {holes3} SELECT hostname, mount_point, path_norm AS path, path_norm, size, volume FROM ({_PENDING})",
        "rehash_list_apply": f"""WITH {holes3}, p AS ({_PENDING}) SELECT d.hostname, d.volume, d.path_norm, coalesce(d.sha512, CASE WHEN p.mtime IS NOT NULL AND d.hostname = '{HOST}' AND d.volume = 'en' THEN sha256(d.text) END) AS sha512
            FROM docs d LEFT JOIN p ON p.mtime = d.mtime""",
        "prune_plan_first": _plan_rows("first"),
        "prune_plan_host": _plan_rows(f"host={PART_HOST}", "Brand#14"),
        "prune_plan_volume": _plan_rows("volume=x1"),
        "prune_plan_shortest": _plan_rows("shortest-path"),
        "prune_group_states": f"""WITH {_plan("volume=x0", PART_HOST)} SELECT sig, CASE WHEN NOT bool_or(hostname = '{PART_HOST}') THEN 'no_local' WHEN sig NOT IN (SELECT sig FROM keep) THEN 'skipped' ELSE 'planned' END AS state
            FROM rep GROUP BY sig""",
        "prune_file_level": f"""WITH {_plan("first", PART_HOST)}, x AS (SELECT d.sig, d.kh, d.kv, d.kp, f.hostname, f.volume, f.path, f.size, f.sha512, {_relative("d.path", "f.path")} AS rel
                FROM del d JOIN files f ON f.hostname = d.hostname AND f.volume = d.volume AND (d.path = '' OR starts_with(f.path, d.path || '/')) WHERE d.gkind = 'dir')
            SELECT x.sig, x.hostname, x.volume, x.path AS path_norm, x.size, kh AS keep_hostname, kv AS keep_volume, f.path AS keep_path
            FROM x JOIN files f ON f.hostname = kh AND f.volume = kv AND f.path = CASE WHEN kp = '' THEN rel ELSE kp || '/' || rel END AND f.sha512 = x.sha512""",
        "subtree_info": f"""WITH {docs}, t AS (SELECT DISTINCT hostname, volume, 'd' || (mtime % 8) AS path FROM docs)
            SELECT t.hostname, t.volume, t.path, count(d.path_norm) AS n_files, coalesce(sum(d.size), 0)::BIGINT AS bytes
            FROM t LEFT JOIN docs d ON d.hostname = t.hostname AND d.volume = t.volume AND (d.path_norm = t.path OR starts_with(d.path_norm, t.path || '/')) GROUP BY ALL""",
        "prune_apply_catalog": f"""WITH {_plan("first", PART_HOST)}, {_GONE} SELECT f.hostname, f.volume, f.path AS path_norm, f.size, f.sha512 FROM files f ANTI JOIN gone g ON g.hostname = f.hostname AND g.volume = f.volume AND g.path = f.path""",
        "survivor_check": f"""WITH {_plan("shortest-path", PART_HOST)}, {_GONE}, n AS (SELECT sha512, count(*) AS n_deleted FROM gone GROUP BY sha512), t AS (SELECT sha512, count(*) AS n_all FROM files GROUP BY sha512)
            SELECT sha512, n_all, n_deleted, n_all > n_deleted AS survives FROM n JOIN t USING (sha512)""",
        "plan_totals": f"WITH {_plan('first', PART_HOST)}, {_GONE} SELECT count(*) AS n_files, coalesce(sum(size), 0)::BIGINT AS bytes FROM gone",
        "format_report": f"""WITH {_COVER}, l AS (SELECT *, {_bytes("size_each")} AS bt FROM rep)
            SELECT sig, 0::BIGINT AS line_no, upper(gkind) || '  ' || bt || CASE WHEN gkind = 'dir' THEN '  (' || file_count_each || ' files each)' ELSE '' END || '  ' || copies || ' copies' AS line FROM l WHERE member_idx = 1
            UNION ALL SELECT sig, member_idx, '  ' || CASE WHEN member_idx = 1 THEN 'KEEP-CANDIDATE:' ELSE 'DUPLICATE:     ' END || ' ' || key || CASE WHEN covered THEN '   (covered by ancestor dup)' ELSE '' END FROM l""",
        "plan_json": f"""WITH {_COVER} SELECT sig, to_json({{'file_count_each': file_count_each, 'kind': gkind, 'members': list({{'covered_by_ancestor': covered, 'file_id': NULL::BIGINT, 'hostname': hostname, 'key': key,
                'orig_path': CASE WHEN kind = 'file' THEN path END, 'path': path, 'sha512': CASE WHEN kind = 'file' THEN substr(sig, 3) END, 'volume': volume}} ORDER BY member_idx), 'sig': sig, 'size_each': size_each}})::VARCHAR AS value
            FROM rep GROUP BY sig, file_count_each, gkind, size_each""",
        "jsonl_roundtrip": f"WITH {holes3} SELECT hostname, mount_point, mtime, os, path_norm AS path, path_norm, scanned_at, sha512, size, volume FROM docs",
        "hashlog_replay": replayed,
        "file_hash_scan": "SELECT 'd' || (doc_id % 7) || '/doc' || doc_id AS path, strlen(text)::BIGINT AS size, sha256(text) AS sha512, 'hashed' AS hash_status FROM documents WHERE strlen(text) > 0",
        "prune_stale_plan": f"""WITH {_COVER}, {_trees("later_", True)} SELECT r.sig, r.gkind AS kind, r.hostname, r.volume, r.path, CASE WHEN l.sig IS NULL THEN 'missing' WHEN l.sig = r.sig AND l.size = r.size_each THEN 'current' ELSE 'changed' END AS state
            FROM rep r LEFT JOIN later_nodes l ON l.hostname = r.hostname AND l.volume = r.volume AND l.path = r.path AND l.kind = r.kind""",
        "lineitem_upsert": """WITH l AS (SELECT 'h' AS hostname, 'v' || (l_orderkey % 16) AS volume, l_orderkey || '/' || l_linenumber AS path_norm, l_quantity::BIGINT AS size, epoch(l_shipdate)::BIGINT AS t,
                CASE WHEN l_returnflag <> 'N' THEN sha256(l_partkey::VARCHAR) END AS sha, row_number() OVER (ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
            s AS (SELECT *, sha IS NOT NULL AND coalesce(t >= max(t) OVER (PARTITION BY path_norm ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS acc FROM l)
            SELECT hostname, volume, path_norm, arg_max(size, (t, seq)) AS size, coalesce(arg_max(sha, seq) FILTER (acc), arg_min(sha, seq) FILTER (sha IS NOT NULL)) AS sha512, max(t) AS scanned_at FROM s GROUP BY ALL""",
        "stream_size_collisions": f"WITH {docs} SELECT hostname, volume, path_norm, size FROM docs WHERE size IN (SELECT size FROM docs GROUP BY size HAVING count(*) > 1)",
        "stream_hashlog_merge": replayed,
        "store_roundtrip": f"""WITH {docs}, {_WALK}, o AS (SELECT hostname, volume, path_norm, size, scanned_at, CASE WHEN mtime % 3 <> 0 THEN sha512 END AS sha512 FROM docs)
            SELECT hostname, volume, path_norm, coalesce(w.size, o.size) AS size, o.sha512, coalesce(w.scanned_at, o.scanned_at) AS scanned_at FROM walk w FULL JOIN o USING (hostname, volume, path_norm)""",
    }
