"""DuckDB SQL for the catalog queries, written apart from the Spark code, over the same tables."""

from __future__ import annotations

_FILES = """files AS (SELECT doc_id + 1 AS book_id, 'TXT' AS format, source || '/' || doc_id || '.txt' AS path, CASE WHEN text IS NULL THEN 'Missing' ELSE 'Present' END AS status,
    octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM documents)"""
_BOOKS = """books AS (SELECT p_partkey + 1 AS book_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE '  ' || replace(p_name, ' ', '   ') || ' ' END AS title,
    p_brand AS publisher, p_brand AS b, p_type AS t FROM part)"""
_LINKS = """links AS (SELECT book_id * 2 + pos AS link_id, book_id, CASE WHEN book_id % 97 = 0 AND pos = 1 THEN '?' ELSE a END AS author_id FROM (
    SELECT p_partkey + 1 AS book_id, 0 AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS a FROM part UNION ALL
    SELECT p_partkey + 1, 1, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END FROM part)),
    authors AS (SELECT author_id, author_id AS name, CASE WHEN author_id = 'Brand#1' THEN '' ELSE author_id END AS sort FROM (SELECT p_brand AS author_id FROM part UNION SELECT p_type FROM part))"""


def _canonical(x: str) -> str:
    """ASCII rule only: the tables' names are plain."""
    punctuation = r"""[!"#%&''()*,\-./:;?@\[\\\]_{}]"""
    return rf"nullif(regexp_replace(regexp_replace(trim(regexp_replace(upper({x}), '\s+', ' ', 'g')), ' ({punctuation})', '\1', 'g'), '({punctuation}) ', '\1', 'g'), '')"


_IDENTITY = f"""keyed AS (SELECT book_id, list_sort(list_distinct(list({_canonical('name')}))) AS ks, count(*) = count(name) AS whole FROM links LEFT JOIN authors USING (author_id) GROUP BY book_id),
    identity AS (SELECT book_id, {_canonical('title')} AS title_key, ks FROM books JOIN keyed USING (book_id) WHERE whole AND {_canonical('title')} IS NOT NULL)"""
_GROUP_ID = """'exact-metadata:v1|title|' || strlen(title_key) || ':' || title_key || '|authors|' || len(ks) || '|' || array_to_string(list_transform(ks, lambda a: strlen(a) || ':' || a), '|')"""
_IDS = """keys AS (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier), t AS (SELECT k, lpad(k::VARCHAR, 9, '0') AS x FROM keys),
    ids AS (SELECT k AS book_id, 'isbn' AS type, x || (k % 10) AS value FROM t UNION ALL SELECT k, 'ISBN13', '978' || x || '-' || (k % 7) FROM t UNION ALL SELECT k, ' amazon ', 'b' || x FROM t
    UNION ALL SELECT k, 'WorldCat', 'ocm' || x FROM t UNION ALL SELECT k, 'doi', CASE WHEN k % 2 = 0 THEN 'doi:10.1/a' ELSE '10.1 /b' END || x FROM t UNION ALL SELECT k, 'other', CASE WHEN k % 3 = 0 THEN ' ' ELSE x END FROM t)"""
_MEMBERS = """members AS (SELECT o_custkey AS group_id, o_orderkey AS book_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS publisher, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS series,
    CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 3)::INT END AS series_index, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate)::INT END AS year, (year(o_orderdate) % 2 + 2000)::INT AS short_year,
    CASE o_orderkey % 4 WHEN 0 THEN ['eng'] WHEN 1 THEN ['eng', 'deu'] WHEN 2 THEN ['fra'] ELSE []::VARCHAR[] END AS languages,
    CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE 'Book ' || (o_orderkey % 2) || CASE WHEN o_orderkey % 10 = 0 THEN ' (Second Edition)' ELSE '' END END AS title, o_orderpriority AS author_sort, o_orderkey % 2 = 0 AS has_cover FROM orders)"""
_CAND = """c AS (SELECT l_orderkey AS group_id, CASE l_returnflag WHEN 'A' THEN 'EPUB' WHEN 'N' THEN 'PDF' ELSE 'MOBI' END AS format, l_orderkey * 100 + l_linenumber AS book_id, 'a/b' || l_linenumber AS path, l_quantity::INT AS score,
    CASE WHEN l_suppkey % 13 <> 0 THEN sha256((l_suppkey % 3)::VARCHAR) END AS sha256, CASE WHEN l_suppkey % 13 = 0 THEN 'Missing' ELSE 'Present' END AS status FROM lineitem)"""
_SELECT = _CAND + """, g AS (SELECT group_id, format, count(*) AS declared, count(*) FILTER (status = 'Present') AS present, count(DISTINCT sha256) FILTER (status = 'Present') = 1 AND count(*) FILTER (status = 'Present' AND sha256 IS NULL) = 0 AS same,
    min_by(path, book_id) FILTER (status = 'Present') AS lp, min(book_id) FILTER (status = 'Present') AS lb, list(score ORDER BY score DESC) FILTER (status = 'Present') AS s,
    list(book_id ORDER BY score DESC, book_id) FILTER (status = 'Present') AS bb, list(path ORDER BY score DESC, book_id) FILTER (status = 'Present') AS bp FROM c GROUP BY ALL),
    r AS (SELECT *, CASE WHEN present = 0 THEN 'FORMAT.NO_AVAILABLE_SOURCE' WHEN present = 1 THEN 'FORMAT.ONLY_AVAILABLE_SOURCE' WHEN same THEN 'FORMAT.EXACT_BINARY_EQUIVALENT' WHEN format <> 'EPUB' THEN 'FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT'
    WHEN s[1] - s[2] >= 10 THEN 'EPUB.MATERIAL_QUALITY_ADVANTAGE' ELSE 'EPUB.SCORES_TOO_CLOSE' END AS reason FROM g),
    sel AS (SELECT group_id, format, declared, present, CASE WHEN present = 0 THEN 'Unavailable' WHEN reason IN ('FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT', 'EPUB.SCORES_TOO_CLOSE') THEN 'UnresolvedConflict' ELSE 'Selected' END AS resolution, reason,
    CASE WHEN reason = 'EPUB.MATERIAL_QUALITY_ADVANTAGE' THEN bb[1] WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'FORMAT.EXACT_BINARY_EQUIVALENT') THEN lb END AS source_id,
    CASE WHEN reason = 'EPUB.MATERIAL_QUALITY_ADVANTAGE' THEN bp[1] WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'FORMAT.EXACT_BINARY_EQUIVALENT') THEN lp END AS source_path,
    CASE WHEN reason = 'FORMAT.EXACT_BINARY_EQUIVALENT' THEN 'Safe' WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'EPUB.MATERIAL_QUALITY_ADVANTAGE') THEN 'Strong' END AS strength FROM r)"""
_PLAN = _SELECT + """, tg AS (SELECT group_id, min(book_id) AS target_id FROM c GROUP BY 1), j AS (SELECT c.*, target_id, source_id FROM c JOIN tg USING (group_id) JOIN sel USING (group_id, format) WHERE resolution = 'Selected'),
    k AS (SELECT group_id, format, min(sha256) AS ks FROM j WHERE book_id = source_id GROUP BY ALL),
    plan AS (SELECT group_id, 'Retention' AS kind, book_id, format, CASE WHEN book_id = target_id THEN 'RetainInTarget' ELSE 'RetainFromOtherRecord' END AS reason FROM j WHERE book_id = source_id
    UNION ALL SELECT group_id, 'FormatRemoval', book_id, format, CASE WHEN book_id = source_id THEN 'RemovedWithSourceRecordAfterRetention' WHEN sha256 = ks THEN 'ByteIdenticalAlternative' ELSE 'ReviewedNonIdenticalReplacement' END FROM j JOIN k USING (group_id, format) WHERE NOT (book_id = source_id AND book_id = target_id)
    UNION ALL SELECT DISTINCT group_id, 'RecordRemoval', book_id, NULL, 'NotTarget' FROM j WHERE book_id <> target_id
    UNION ALL SELECT group_id, 'Backup', book_id, format, 'Format' FROM j UNION ALL SELECT DISTINCT group_id, 'Backup', book_id, NULL, 'Metadata' FROM j)"""
_JOURNAL = """e AS (SELECT user_id AS execution_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'TerminalSummary' WHEN 'click' THEN 'MutationStarted' ELSE upper(event_type[1]) || event_type[2:] END AS kind, sha256(event_id::VARCHAR) AS h FROM events),
    seen AS (SELECT execution_id, event_id, kind, row_number() OVER w AS sequence, coalesce(lag(h) OVER w, repeat('0', 64)) AS previous_hash,
    coalesce(max((kind = 'TerminalSummary')::INT) OVER (PARTITION BY execution_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_terminal FROM e WINDOW w AS (PARTITION BY execution_id ORDER BY ts, event_id))"""


def _known(value: str, code: str, source: str = "members") -> str:
    return f"""SELECT group_id, book_id, '{code}' AS code FROM {source} JOIN (SELECT group_id, count(*) AS d, count(*) FILTER (n >= 2) AS held, max(v) FILTER (n >= 2) AS agreed FROM
        (SELECT group_id, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) GROUP BY 1) USING (group_id)
        WHERE d > 1 AND CASE WHEN held = 1 THEN {value} IS NOT NULL AND {value} <> agreed ELSE true END"""


def _disjoint(values: str, code: str, source: str) -> str:
    return f"""SELECT group_id, book_id, '{code}' AS code FROM {source} JOIN (SELECT group_id, count(*) FILTER (n >= 2) AS held, max_by(v, CASE WHEN n >= 2 THEN n ELSE 0 END) AS agreed,
        bool_or(apart) AS apart FROM (SELECT a.group_id, a.v, a.n, EXISTS (SELECT 1 FROM sets b WHERE b.group_id = a.group_id AND NOT list_has_any(a.v, b.v)) AS apart FROM sets a) GROUP BY 1) USING (group_id)
        WHERE apart AND CASE WHEN held = 1 THEN len({values}) > 0 AND NOT list_has_any({values}, agreed) ELSE true END"""


_SERIES = _known("series", "METADATA.SERIES_CONFLICT") + """ UNION ALL SELECT group_id, book_id, 'METADATA.SERIES_INDEX_CONFLICT' FROM members JOIN (SELECT group_id, series, count(*) AS d, count(*) FILTER (n >= 2) AS held, max(series_index) FILTER (n >= 2) AS agreed
    FROM (SELECT group_id, series, series_index, count(*) AS n FROM members WHERE series IS NOT NULL AND series_index IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (group_id, series)
    WHERE series_index IS NOT NULL AND d > 1 AND CASE WHEN held = 1 THEN series_index <> agreed ELSE true END"""
_USABLE = "coalesce(trim({0}) <> '' AND upper(trim({0})) NOT IN ('UNKNOWN', 'UNKNOWN AUTHOR', 'UNTITLED', 'N/A', 'NONE', '-', '?'), false)"
_VECTOR = f"""vec AS (SELECT group_id, book_id, {_USABLE.format('title')} AS core, book_id % 8 <> 0 AS integrity, ({_USABLE.format('author_sort')}::INT + (book_id % 3 = 0)::INT + (len(languages) > 0)::INT + (year IS NOT NULL)::INT + (publisher IS NOT NULL)::INT
    + (series IS NOT NULL AND series_index IS NOT NULL)::INT + has_cover::INT)::INT AS completeness, (book_id % 3 = 0)::INT AS strong_ids FROM members)"""


def _ten(x: str) -> str:
    digit = f"CASE WHEN substr({x}, 1 + i::INT, 1) = 'X' THEN 10 ELSE ascii(substr({x}, 1 + i::INT, 1)) - 48 END"
    return f"list_sum(list_transform(range(0, 10), lambda i: (10 - i) * ({digit}))) % 11 = 0"


def _isbn(v: str, shape: str) -> str:
    x = f"upper(regexp_replace({v}, '[^0-9Xx]', '', 'g'))"
    thirteen = f"(10 - list_sum(list_transform(range(0, 12), lambda i: (ascii(substr({x}, 1 + i::INT, 1)) - 48) * CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END)) % 10) % 10 = ascii(substr({x}, 13, 1)) - 48"
    return f"CASE WHEN regexp_full_match({x}, '{shape}') THEN CASE WHEN {_ten(x)} THEN {x} END WHEN regexp_full_match({x}, '[0-9]{{13}}') THEN CASE WHEN {thirteen} THEN {x} END END"


_STRICT = _isbn("value", "[0-9]{9}[0-9X]")
_DOI = "upper(trim(regexp_replace(trim(value), '^(https://doi\\.org/|http://doi\\.org/|doi:)', '', 'i')))"
_OCLC = "regexp_replace(upper(trim(value)), '^(OCLC|OCM|OCN|ON)[: ]*', '')"
_KIND = "CASE WHEN upper(trim(type)) IN ('ISBN', 'ISBN10', 'ISBN13') THEN 'ISBN' WHEN upper(trim(type)) = 'DOI' THEN 'DOI' WHEN upper(trim(type)) IN ('ASIN', 'AMAZON') THEN 'ASIN' WHEN upper(trim(type)) IN ('OCLC', 'WORLD-CAT', 'WORLDCAT') THEN 'OCLC' END"
_STRONG = f"""CASE {_KIND} WHEN 'ISBN' THEN 'ISBN:' || {_STRICT} WHEN 'DOI' THEN CASE WHEN {_DOI} LIKE '10.%/%' AND NOT regexp_matches({_DOI}, '\\s') THEN 'DOI:' || {_DOI} END
    WHEN 'ASIN' THEN CASE WHEN regexp_full_match(upper(trim(value)), '[A-Z0-9]{{10}}') THEN 'ASIN:' || upper(trim(value)) END WHEN 'OCLC' THEN CASE WHEN regexp_full_match({_OCLC}, '[0-9]+') THEN 'OCLC:' || coalesce(nullif(ltrim({_OCLC}, '0'), ''), '0') END END"""


def _f16(x: str) -> str:
    return f"length(coalesce({x}, '')) || ':' || coalesce({x}, '') || ';'"


def _f8(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N;' ELSE 'V' || strlen({x}) || ':' || {x} || ';' END"


_FRAME = ["o_orderkey::VARCHAR", "o_orderstatus", "strftime(o_orderdate, '%Y-%m-%d')", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"]
_BEFORE = "before AS (SELECT o_orderkey AS book_id, o_custkey AS group_id, o_orderpriority AS title, o_orderstatus AS publisher, round(o_totalprice, 2)::DECIMAL(18,2) AS size FROM orders)"
_DIFF = _BEFORE + """, after AS (SELECT book_id, group_id, CASE WHEN book_id % 50 = 2 THEN 'changed' ELSE title END AS title, CASE WHEN book_id % 50 <> 3 THEN publisher END AS publisher, size FROM before WHERE book_id % 50 <> 1),
    diff AS (SELECT coalesce(b.group_id, a.group_id) AS group_id, book_id, CASE WHEN a.group_id IS NULL THEN 'Missing' WHEN b.group_id IS NULL THEN 'New' ELSE 'Changed' END AS change,
    CASE WHEN a.group_id IS NULL OR b.group_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.title IS DISTINCT FROM b.title THEN 'title' END, CASE WHEN a.publisher IS DISTINCT FROM b.publisher THEN 'publisher' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END) END AS fields
    FROM before b FULL JOIN after a USING (book_id) WHERE a.group_id IS NULL OR b.group_id IS NULL OR a.title IS DISTINCT FROM b.title OR a.publisher IS DISTINCT FROM b.publisher OR a.size IS DISTINCT FROM b.size)"""
_OPS = _PLAN + """, ops AS (SELECT group_id, 0 AS p, 'Precondition' AS phase, 'verify:metadata' AS operation, '' AS k, 0 AS b FROM tg WHERE group_id IN (SELECT group_id FROM plan)
    UNION ALL SELECT group_id, CASE WHEN reason = 'RetainInTarget' THEN 1 ELSE 2 END, CASE WHEN reason = 'RetainInTarget' THEN 'Precondition' ELSE 'Constructive' END, CASE WHEN reason = 'RetainInTarget' THEN 'verify:format:' ELSE 'construct:format:' END || format, format, 0 FROM plan WHERE kind = 'Retention'
    UNION ALL SELECT group_id, 3, 'Destructive', 'destroy:record:' || book_id, '', book_id FROM plan WHERE kind = 'RecordRemoval'),
    graph AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY p, k, b) - 1 AS ordinal, operation, phase, p FROM ops)"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_READ = f"""read AS (SELECT page_id, {_HOST} AS host, coalesce(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', ' ', 'gis'), '<style\\b.*?</style\\s*>', ' ', 'gis'), '<nav\\b.*?</nav\\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')), 0)::INT AS readable FROM pages)"""
_RAW = """regexp_extract_all(coalesce(html, ''), '(?i)\\b(?:src|href|poster)\\s*=\\s*["'']([^"''<>]*)["'']', 1)"""
_REFS = f"""raw AS (SELECT page_id, {_HOST} AS host, unnest({_RAW}) AS r, generate_subscripts({_RAW}, 1) - 1 AS position FROM pages),
    refs AS (SELECT page_id, host, position::INT AS position, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') OR r LIKE '//%' THEN 'remote' WHEN length(regexp_replace(r, '[?#].*$', '')) % 2 = 1 THEN 'broken' ELSE 'local' END AS kind,
    CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') OR r LIKE '//%' THEN 'scheme:' || lower(regexp_extract(r, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || ';host:' || lower(regexp_extract(r, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) ELSE regexp_replace(r, '[?#].*$', '') END AS target FROM raw)"""
_SCORED = _READ + ", " + _REFS + """, h AS (SELECT host, count(*) AS spine, sum(readable) AS chars, count(*) FILTER (readable < 3000) AS empty, min(page_id) AS fp FROM read GROUP BY 1),
    hb AS (SELECT h.*, coalesce(n, 0) AS broken FROM h LEFT JOIN (SELECT host, count(*) AS n FROM refs WHERE kind = 'broken' GROUP BY 1) USING (host)),
    sc AS (SELECT host, fp % 29 = 1 AS bad, 50 + 4 + 4 + CASE WHEN trim(host) <> '' THEN 3 ELSE -4 END + CASE WHEN fp % 4 = 1 THEN -4 ELSE 3 END + 2 + CASE fp % 4 WHEN 2 THEN -1 WHEN 3 THEN 0 ELSE 1 END + CASE WHEN fp % 4 = 1 THEN 1 ELSE 0 END
    + CASE WHEN fp % 4 <> 2 THEN 4 ELSE -6 END + CASE fp % 4 WHEN 2 THEN 0 WHEN 3 THEN -3 ELSE 2 END + CASE WHEN fp % 4 <> 0 THEN 4 ELSE -6 END + CASE WHEN spine > 0 THEN 5 ELSE -20 END + CASE WHEN chars >= 5000 THEN 5 WHEN chars >= 500 THEN -8 ELSE -15 END
    + CASE WHEN fp % 4 = 0 THEN -5 ELSE 4 END + CASE WHEN broken = 0 THEN 4 ELSE greatest(-10, -2 * broken) END + CASE WHEN empty = 0 THEN 2 ELSE greatest(-10, -2 * empty) END + 2 AS total FROM hb)"""

ORACLE_SQL: dict[str, str] = {
    "G1_exact_binary_groups": f"""WITH {_FILES} SELECT 'sha256:' || sha256 || ':' || size AS group_id, size, sha256, count(*) AS member_count, count(DISTINCT book_id) AS book_count, count(DISTINCT book_id) > 1 AS spans_records
        FROM (SELECT DISTINCT * FROM files WHERE sha256 IS NOT NULL) GROUP BY size, sha256 HAVING count(*) >= 2""",
    "G2_O2_binary_group_members": f"""WITH {_FILES}, n AS (SELECT *, count(*) OVER (PARTITION BY size, sha256) AS n FROM (SELECT DISTINCT * FROM files WHERE sha256 IS NOT NULL)) SELECT 'sha256:' || sha256 || ':' || size AS group_id, book_id, format, path FROM n WHERE n >= 2""",
    "O1_binary_group_ranks": f"""WITH {_FILES} SELECT 'sha256:' || sha256 || ':' || size AS group_id, row_number() OVER (PARTITION BY size ORDER BY sha256)::INT AS rank_in_size FROM (SELECT size, sha256 FROM files WHERE sha256 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT book_id) >= 2)""",
    "F2_F3_eligible_identities": f"WITH {_BOOKS}, {_LINKS}, {_IDENTITY} SELECT book_id, title_key, array_to_string(ks, '|') AS author_keys FROM identity",
    "G3_metadata_groups": f"WITH {_BOOKS}, {_LINKS}, {_IDENTITY} SELECT {_GROUP_ID} AS group_id, title_key, array_to_string(ks, '|') AS author_keys, count(*) AS member_count FROM identity GROUP BY title_key, ks HAVING count(*) >= 2",
    "J7_P7_group_members": f"WITH {_BOOKS}, {_LINKS}, {_IDENTITY}, gg AS (SELECT title_key, ks, list(book_id) AS l FROM identity GROUP BY title_key, ks HAVING count(*) >= 2), g AS (SELECT title_key, ks, unnest(l) AS book_id FROM gg) SELECT {_GROUP_ID} AS group_id, book_id, title, publisher FROM g JOIN books USING (book_id)",
    "J9_all_candidates_in_one_group": f"WITH {_CAND} SELECT group_id, format, count(*) AS n, count(DISTINCT sha256) = 1 AND count(sha256) = count(*) AS all_equal FROM c GROUP BY ALL",
    "J10_binary_evidence": f"""WITH {_FILES}, g AS (SELECT size, sha256 FROM files WHERE sha256 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT book_id) >= 2)
        SELECT 'sha256:' || sha256 || ':' || size AS group_id, bool_and(book_id % 17 <> 0) AS consistent FROM g JOIN files USING (size, sha256) GROUP BY size, sha256""",
    "S3_schema_validation": "SELECT * FROM (VALUES ('orders', 'o_series'), ('part', 'p_isbn'), ('series', NULL)) t(table_name, column_name)",
    "S4_library_id": "SELECT count(*) AS n, true AS well_formed, count(*) = 1 AS single FROM region",
    "S5_book_violations": f"""WITH {_BOOKS}, b AS (SELECT CASE WHEN book_id % 100 = 1 THEN 1 WHEN book_id % 100 = 2 THEN book_id - 100000 ELSE book_id END AS book_id, CASE WHEN book_id % 50 <> 3 THEN title END AS title FROM books), n AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM b)
        SELECT book_id, 'INVALID_ID' AS reason FROM n WHERE book_id <= 0 UNION ALL SELECT book_id, 'BLANK_TITLE' FROM n WHERE title IS NULL OR trim(title) = '' UNION ALL SELECT book_id, 'DUPLICATE_ID' FROM n WHERE n > 1""",
    "S7_identifier_split": f"WITH {_IDS} SELECT type, count(*) AS n, 'usable' AS kind FROM ids WHERE trim(value) <> '' GROUP BY 1 UNION ALL SELECT 'CATALOG_VALUE_INVALID', count(*), 'issue' FROM ids WHERE trim(value) = '' HAVING count(*) > 0",
    "S8_format_violations": f"WITH {_CAND}, f AS (SELECT group_id AS book_id, upper(CASE WHEN score > 48 THEN '' ELSE format END) AS format FROM c) SELECT book_id, format FROM f GROUP BY ALL HAVING count(*) > 1 OR trim(format) = ''",
    "S9_single_links": "SELECT o_custkey AS book_id, count(*) AS links FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) > 1",
    "S10_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "part", "supplier")),
    "S11_managed_paths": "SELECT doc_id, CASE WHEN doc_id % 9 IN (0, 8) THEN 'x/' || source || '/Doc ' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 9 NOT IN (0, 8) THEN 'MANAGED_PATH_INVALID' END AS code FROM documents",
    "S12_P2_file_status": """SELECT doc_id AS sequence, source || '/' || doc_id AS path, CASE doc_id % 10 WHEN 0 THEN 'Missing' WHEN 1 THEN 'ChangedDuringHashing' WHEN 2 THEN 'Inaccessible' ELSE 'Present' END AS status, CASE WHEN doc_id % 10 > 2 THEN sha256(text) END AS sha256,
        CASE doc_id % 10 WHEN 0 THEN 'FORMAT_FILE_MISSING' WHEN 1 THEN 'FORMAT_FILE_CHANGED_DURING_HASHING' WHEN 2 THEN 'FORMAT_FILE_INACCESSIBLE' END AS code FROM documents""",
    "J1_author_references": f"WITH {_LINKS} SELECT book_id, link_id, author_id, name, sort, CASE WHEN name IS NULL THEN 'AUTHOR_REFERENCE_MISSING' WHEN trim(sort) = '' THEN 'CATALOG_VALUE_INVALID' END AS code FROM links LEFT JOIN authors USING (author_id)",
    "J2_J3_publication_links": "SELECT c_custkey AS book_id, n_name AS publisher, CASE WHEN n_name IS NULL THEN 'CATALOG_VALUE_INVALID' END AS code FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey",
    "J4_ordered_authors": f"WITH {_LINKS} SELECT book_id, string_agg(author_id, ' & ' ORDER BY link_id) AS authors FROM links GROUP BY 1",
    "J5_orphans": "SELECT l_orderkey AS book_id, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 <> 0)",
    "J6_W5_hash_sequence": f"WITH {_FILES} SELECT book_id, format, path, row_number() OVER (ORDER BY book_id, format, path) - 1 AS sequence FROM files",
    "X13_optional_values": """SELECT o_orderkey AS book_id, CASE WHEN o_orderkey % 13 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS published, CASE WHEN o_orderkey % 13 > 1 THEN year(o_orderdate)::INT END AS stored_year, CASE WHEN o_orderkey % 17 > 2 THEN (o_orderkey % 9) + 0.5::DOUBLE END AS series_index,
        CASE WHEN o_orderkey % 19 > 1 THEN o_orderkey % 2 = 1 ELSE false END AS has_cover, concat_ws(',', CASE WHEN o_orderkey % 13 = 0 THEN 'pubdate' END, CASE WHEN o_orderkey % 17 < 2 THEN 'series_index' END, CASE WHEN o_orderkey % 19 < 2 THEN 'has_cover' END) AS invalid FROM orders""",
    "U1_U2_O4_findings": """WITH f AS (SELECT l_orderkey AS book_id, l_returnflag AS format, NULL::VARCHAR AS path, l_linestatus AS code, l_linenumber + l_suppkey * 100 AS ordinal, l_partkey::VARCHAR AS evidence FROM lineitem UNION ALL SELECT o_orderkey, 'A', NULL, 'F', 0, 'order' FROM orders WHERE o_orderkey % 3 = 0)
        SELECT book_id, format, path, code, ordinal, evidence FROM f QUALIFY row_number() OVER (PARTITION BY book_id, format, path, code ORDER BY ordinal, evidence) = 1""",
    "X1_normalised_names": f"""WITH t AS (SELECT p_partkey, ' ' || replace(p_name, ' ', '  -  ') || ' ( ' || p_type || ' ) ; ' AS x FROM part) SELECT p_partkey, {_canonical('x')} AS canonical, upper(trim(x)) AS light FROM t""",
    "X3_X7_G10_strong_identifiers": f"WITH {_IDS} SELECT book_id, trim(type) AS type, {_KIND} AS kind, {_STRONG} AS strong, {_isbn('value', '[0-9X]{10}')} AS loose_isbn FROM ids",
    "G10_strong_identifier_counts": f"WITH {_IDS} SELECT book_id, count({_STRONG}) AS strong FROM ids GROUP BY 1",
    "X8_language_signature": f"WITH {_MEMBERS} SELECT book_id, nullif(array_to_string(list_sort(list_distinct(list_transform(languages, lambda v: upper(v)))), '|'), '') AS signature FROM members",
    "X9_edition_signature": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ABRIDGED|UNABRIDGED' WHEN 1 THEN 'SECOND EDITION' WHEN 2 THEN '3RD EDITION|REVISED' WHEN 3 THEN 'ANNIVERSARY EDITION|ILLUSTRATED' END AS edition FROM part""",
    "X10_X11_group_ids": "SELECT p_partkey, 'exact-metadata:v1|title|' || strlen(p_name) || ':' || p_name || '|authors|2|' || strlen(p_brand) || ':' || p_brand || '|' || strlen(p_type) || ':' || p_type AS metadata_id, 'sha256:' || sha256(p_name) || ':' || p_size AS binary_id FROM part",
    "X12_X14_F9_paths_and_clips": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/../' ELSE 'a/' END || page_id AS path, page_id % 3 <> 0 AS safe, url NOT LIKE '%:%' AND url <> '' AND url NOT LIKE '/%' AS url_safe, sha256(substr(trim(html), 1, 512)) AS clip FROM pages",
    "X15_H2_framed_rows": f"SELECT o_orderkey, sha256({' || '.join(_f16(x) for x in _FRAME)}) AS utf16, sha256({' || '.join(_f8(x) for x in _FRAME)}) AS utf8 FROM orders",
    "H5_unaffected_state": f"WITH {_BEFORE} SELECT group_id, sha256(string_agg({_f8('book_id::VARCHAR')} || {_f8('title')} || {_f8('publisher')}, '' ORDER BY book_id)) AS digest FROM before WHERE group_id % 10 <> 0 GROUP BY 1",
    "F1_F4_epub_targets": f"WITH {_CAND} SELECT group_id, book_id, path FROM c WHERE format = 'EPUB' AND sha256 IS NOT NULL",
    "F5_group_search": f"WITH {_BOOKS} SELECT book_id FROM books WHERE contains(upper(title), 'RING')",
    "F6_F7_review_filters": "SELECT event_type, count(*) FILTER (value > 5) AS active, count(*) FILTER (NOT value > 5) AS deferred FROM events WHERE event_type <> 'view' GROUP BY 1",
    "F8_usable_values": f"WITH {_MEMBERS} SELECT book_id, {_USABLE.format('title')} AS usable, {_USABLE.format('publisher')} AS publisher_usable FROM members",
    "F10_P10_candidate_split": f"WITH {_CAND} SELECT group_id, count(*) FILTER (status = 'Present') AS present, count(*) FILTER (status <> 'Present') AS unavailable FROM c GROUP BY 1",
    "P5_P6_book_rows": f"WITH {_FILES} SELECT book_id, format('{{:,}}', size) || ' bytes' AS size_text, format || ' (' || status || ')' AS file_text FROM files",
    "P8_member_rows": f"WITH {_MEMBERS} SELECT book_id, coalesce(series || coalesce(' #' || series_index, ''), '') AS series_text, array_to_string(languages, ', ') AS language_text FROM members",
    "G6_mode_consensus": f"""WITH {_MEMBERS}, n AS (SELECT group_id, publisher, count(*) AS n FROM members WHERE publisher IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), m AS (SELECT group_id, publisher, n, max(n) OVER (PARTITION BY group_id) AS top FROM n),
        b AS (SELECT group_id, CASE WHEN count(*) = 1 THEN min(publisher) END AS consensus FROM m WHERE n = top GROUP BY 1) SELECT DISTINCT group_id, consensus FROM members LEFT JOIN b USING (group_id)""",
    "G7_G8_agreement": f"""WITH {_MEMBERS}, {', '.join(f'''n{v} AS (SELECT group_id, {v}, count(*) AS n FROM members WHERE {v} IS NOT NULL GROUP BY ALL), m{v} AS (SELECT *, max(n) OVER (PARTITION BY group_id) AS top, count(*) OVER (PARTITION BY group_id) AS d FROM n{v}),
        a{v} AS (SELECT group_id, coalesce(CASE WHEN count(*) FILTER (n = top AND n >= 2) = 1 THEN min({v}) FILTER (n = top AND n >= 2) END, CASE WHEN max(d) = 1 THEN min({v}) END) AS agreed FROM m{v} GROUP BY 1)''' for v in ('publisher', 'series'))}
        SELECT group_id, book_id, (coalesce(publisher = apublisher.agreed, false)::INT + coalesce(series = aseries.agreed, false)::INT)::INT AS consistency FROM members LEFT JOIN apublisher USING (group_id) LEFT JOIN aseries USING (group_id)""",
    "C1_language_conflicts": f"WITH {_MEMBERS}, sets AS (SELECT group_id, list_sort(languages) AS v, count(*) AS n FROM members WHERE len(languages) > 0 GROUP BY ALL) {_disjoint('languages', 'METADATA.LANGUAGE_CONFLICT', 'members')}",
    "C2_series_conflicts": f"WITH {_MEMBERS} {_SERIES}",
    "C3_J12_identifier_conflicts": f"WITH {_IDS}, m AS (SELECT book_id % 200 AS group_id, book_id, ['V' || (book_id % 3)] AS strong FROM ids WHERE type = 'WorldCat'), sets AS (SELECT group_id, strong AS v, count(*) AS n FROM m GROUP BY ALL) {_disjoint('strong', 'IDENTIFIER.STRONG_CONFLICT', 'm')}",
    "C4_C5_edition_conflicts": f"""WITH {_MEMBERS}, ed AS (SELECT group_id, book_id, coalesce(CASE WHEN title LIKE '%Second Edition%' THEN 'SECOND EDITION' END, CASE WHEN book_id % 4 = 0 THEN 'REVISED' END) AS edition FROM members) {_known('edition', 'METADATA.EDITION_WORDING_CONFLICT', 'ed')}""",
    "C6_G9_year_conflicts": f"""WITH {_MEMBERS}, s AS (SELECT group_id, max(year) - min(year) AS gap FROM members GROUP BY 1 HAVING max(year) > min(year)), wide AS (SELECT m.* FROM members m JOIN s USING (group_id) WHERE gap >= 2), apart AS ({_known('year', 'Y', 'wide')})
        SELECT group_id, CASE WHEN gap >= 2 THEN 'ManualReview' ELSE 'Advisory' END AS severity, gap::INT AS gap, (SELECT count(*) FROM apart a WHERE a.group_id = s.group_id) AS separated FROM s""",
    "C7_cohorts": f"""WITH {_MEMBERS}, gone AS ({_known('series', 'S')}), m AS (SELECT group_id, book_id, NOT (book_id % 2 = 0 AND book_id IN (SELECT book_id FROM gone)) AS stays FROM members), n AS (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY group_id) AS size FROM m)
        SELECT group_id, book_id, stays AND size >= 2 AS in_cohort, CASE WHEN size < 2 THEN 'RetainedSeparate' WHEN stays THEN 'Cohort' ELSE 'Separated' END AS outcome FROM n""",
    "C8_metadata_vector": f"WITH {_MEMBERS}, {_VECTOR} SELECT * FROM vec",
    "C9_metadata_warnings": f"""WITH {_MEMBERS} SELECT group_id, book_id, 'METADATA.PLACEHOLDER_VALUE' AS code FROM members WHERE NOT {_USABLE.format('title')} UNION ALL SELECT group_id, NULL, 'METADATA.LANGUAGE_INCOMPLETE' FROM members GROUP BY group_id HAVING count(*) FILTER (len(languages) > 0) BETWEEN 1 AND count(*) - 1""",
    "C10_U4_availability": f"""WITH {_CAND}, s AS (SELECT group_id % 3000 AS g, group_id AS b, list_sort(list(DISTINCT format)) AS f FROM c GROUP BY ALL), p AS (SELECT x.g, bool_or(NOT list_has_any(x.f, y.f) OR len(list_filter(x.f, lambda v: NOT list_contains(y.f, v))) + len(list_filter(y.f, lambda v: NOT list_contains(x.f, v))) >= 2) AS w
        FROM s x JOIN s y ON x.g = y.g AND x.b < y.b GROUP BY 1) SELECT DISTINCT s.g AS group_id, coalesce(w, false) AS warns FROM s LEFT JOIN p ON s.g = p.g""",
    "W1_W2_metadata_source": f"""WITH {_MEMBERS}, {_VECTOR}, r AS (SELECT *, row_number() OVER w AS n, lead(book_id) OVER w AS runner_up, lead((core, integrity, completeness, strong_ids)) OVER w AS nx FROM vec WINDOW w AS (PARTITION BY group_id ORDER BY core DESC, integrity DESC, completeness DESC, strong_ids DESC, book_id))
        SELECT group_id, book_id, runner_up, runner_up IS NOT NULL AND nx = (core, integrity, completeness, strong_ids) AS tied, CASE WHEN runner_up IS NOT NULL AND nx = (core, integrity, completeness, strong_ids) THEN 'Safe' ELSE 'Strong' END AS strength FROM r WHERE n = 1""",
    "W1_W2_G7_G8_whole_source": f"""WITH {_MEMBERS}, {_VECTOR}, sg AS (SELECT group_id, book_id, publisher AS s1, nullif(array_to_string(list_sort(languages), '|'), '') AS s2, year::VARCHAR AS s3, series AS s4 FROM members), {', '.join(f'''w{i} AS (SELECT group_id, s{i} AS v, count(*) AS n FROM sg WHERE s{i} IS NOT NULL GROUP BY group_id, s{i}), t{i} AS (SELECT group_id, max(n) AS top, count(*) AS d FROM w{i} GROUP BY 1),
        a{i} AS (SELECT group_id, CASE WHEN top >= 2 AND count(*) FILTER (n = top) = 1 THEN min(v) FILTER (n = top) END AS c, CASE WHEN d = 1 THEN min(v) END AS o FROM w{i} JOIN t{i} USING (group_id) GROUP BY group_id, top, d)''' for i in (1, 2, 3, 4))},
        k AS (SELECT sg.group_id, sg.book_id, {' + '.join(f'coalesce(s{i} <> a{i}.c, false)::INT' for i in (1, 2, 3, 4))} AS bad, {' + '.join(f'coalesce(s{i} = coalesce(a{i}.c, a{i}.o), false)::INT' for i in (1, 2, 3, 4))} AS good FROM sg {' '.join(f'LEFT JOIN a{i} ON a{i}.group_id = sg.group_id' for i in (1, 2, 3, 4))}),
        r AS (SELECT *, row_number() OVER w AS n, lead(book_id) OVER w AS runner_up, lead((core, integrity, bad, completeness, good, strong_ids)) OVER w AS nx FROM vec JOIN k USING (group_id, book_id) WINDOW w AS (PARTITION BY group_id ORDER BY core DESC, integrity DESC, bad, completeness DESC, good DESC, strong_ids DESC, book_id)),
        f AS (SELECT *, runner_up IS NOT NULL AND nx = (core, integrity, bad, completeness, good, strong_ids) AS tied FROM r WHERE n = 1 AND core) SELECT group_id, book_id, runner_up, tied, CASE WHEN tied THEN 'Safe' ELSE 'Strong' END AS strength FROM f""",
    "C11_C12_W3_format_selection": f"WITH {_SELECT} SELECT * FROM sel",
    "C11_C12_W3_assessed_selection": f"""WITH {_CAND}, li AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS book_id, l_orderkey * 31 + l_linenumber * 7 AS k FROM lineitem WHERE l_returnflag = 'A' AND (l_orderkey * 31 + l_linenumber * 7) % 17 <> 0),
        x AS (SELECT c.*, k IS NOT NULL AND format = 'EPUB' AS assessed, k % 5 < 2 OR k % 11 = 0 AS bad, k % 5 < 2 AS decisively, CASE WHEN k % 3 = 0 THEN -6 ELSE 4 END AS nav, CASE WHEN k % 8 = 0 THEN -4 WHEN k % 4 = 0 THEN -2 ELSE 0 END AS chap, k % 4 = 0 AS fault FROM c LEFT JOIN li USING (book_id)),
        ms AS (SELECT group_id, max(book_id) AS m FROM c GROUP BY 1), p AS (SELECT x.*, m, assessed AND NOT bad AS done, row_number() OVER (PARTITION BY group_id, format ORDER BY (assessed AND NOT bad) DESC, score DESC, book_id) AS place FROM x JOIN ms USING (group_id) WHERE status = 'Present'),
        b AS (SELECT * FROM p WHERE done AND place = 1),
        v AS (SELECT b.group_id, b.format, bool_and(coalesce(b.score - r.score >= 10 AND (b.nav - r.nav >= 4 OR b.chap - r.chap >= 4) AND NOT (b.fault AND NOT r.fault), false)) AS wins FROM b JOIN p r ON r.group_id = b.group_id AND r.format = b.format AND r.place > 1 GROUP BY ALL),
        n AS (SELECT group_id, format, count(*) AS declared, count(*) FILTER (status = 'Present') AS present FROM c GROUP BY ALL),
        q AS (SELECT group_id, format, count(DISTINCT sha256) = 1 AND count(sha256) = count(*) AS same, count(*) FILTER (done) AS nd, count(*) FILTER (assessed AND bad AND decisively) AS nr, first(book_id ORDER BY book_id <> m, book_id) AS lb, first(path ORDER BY book_id <> m, book_id) AS lp FROM p GROUP BY ALL),
        z AS (SELECT n.*, lb, lp, b.book_id AS bb, b.path AS bp, CASE WHEN n.present = 0 THEN 'FORMAT.NO_AVAILABLE_SOURCE' WHEN n.present = 1 THEN 'FORMAT.ONLY_AVAILABLE_SOURCE' WHEN same THEN 'FORMAT.EXACT_BINARY_EQUIVALENT' WHEN n.format <> 'EPUB' THEN 'FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT'
        WHEN nd = 1 AND nr = n.present - 1 THEN 'EPUB.VALID_OVER_DISQUALIFIED' WHEN nd = n.present AND wins THEN 'EPUB.MATERIAL_QUALITY_ADVANTAGE' ELSE 'EPUB.SCORES_TOO_CLOSE' END AS reason FROM n LEFT JOIN q USING (group_id, format) LEFT JOIN b USING (group_id, format) LEFT JOIN v USING (group_id, format))
        SELECT group_id, format, declared, present, CASE WHEN present = 0 THEN 'Unavailable' WHEN reason IN ('FORMAT.UNASSESSED_NONIDENTICAL_CONFLICT', 'EPUB.SCORES_TOO_CLOSE') THEN 'UnresolvedConflict' ELSE 'Selected' END AS resolution, reason,
        CASE WHEN reason IN ('EPUB.VALID_OVER_DISQUALIFIED', 'EPUB.MATERIAL_QUALITY_ADVANTAGE') THEN bb WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'FORMAT.EXACT_BINARY_EQUIVALENT') THEN lb END AS source_id,
        CASE WHEN reason IN ('EPUB.VALID_OVER_DISQUALIFIED', 'EPUB.MATERIAL_QUALITY_ADVANTAGE') THEN bp WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'FORMAT.EXACT_BINARY_EQUIVALENT') THEN lp END AS source_path,
        CASE WHEN reason = 'FORMAT.EXACT_BINARY_EQUIVALENT' THEN 'Safe' WHEN reason IN ('FORMAT.ONLY_AVAILABLE_SOURCE', 'EPUB.VALID_OVER_DISQUALIFIED', 'EPUB.MATERIAL_QUALITY_ADVANTAGE') THEN 'Strong' END AS strength FROM z""",
    "C13_G5_decisive_advantage": f"""WITH {_CAND}, ep AS (SELECT * FROM c WHERE format = 'EPUB'), s AS (SELECT book_id, i, sum((score * (i + 3)) % 11 - 5) AS p FROM ep, (SELECT unnest(range(3)) AS i) GROUP BY ALL), b AS (SELECT group_id, min(book_id) AS best FROM ep GROUP BY 1)
        SELECT best, ep.book_id AS other, bool_or(x.p - y.p >= 4) AND NOT bool_or(x.p < 0 AND y.p >= 0) AS advantage FROM ep JOIN b USING (group_id) JOIN s x ON x.book_id = best JOIN s y ON y.book_id = ep.book_id AND y.i = x.i WHERE ep.book_id <> best GROUP BY ALL""",
    "C14_redundant_records": f"""WITH {_SELECT} SELECT c.group_id, c.book_id FROM c JOIN sel USING (group_id, format) WHERE c.book_id NOT IN (SELECT min(book_id) FROM c GROUP BY group_id) GROUP BY ALL
        HAVING bool_and(coalesce(status = 'Present' AND resolution = 'Selected' AND source_id <> book_id AND reason = 'FORMAT.EXACT_BINARY_EQUIVALENT', false))""",
    "C15_confidence": f"""WITH {_SELECT}, f AS (SELECT group_id, bool_or(resolution <> 'Selected') AS o, bool_and(coalesce(strength = 'Safe', false)) AS safe, bool_or(coalesce(strength = 'Strong', false)) AS strong, bool_or(reason = 'FORMAT.ONLY_AVAILABLE_SOURCE') AS ol FROM sel GROUP BY 1),
        w AS (SELECT group_id, bool_or(book_id % 2 = 0) AS grave FROM c WHERE score = 50 GROUP BY 1)
        SELECT group_id, CASE WHEN o OR group_id % 13 = 0 OR coalesce(grave, false) THEN 'ManualReviewRequired' WHEN grave IS NOT NULL THEN 'Low' WHEN safe THEN 'Deterministic' WHEN strong THEN CASE WHEN ol THEN 'Medium' ELSE 'High' END ELSE 'Medium' END AS confidence FROM f LEFT JOIN w USING (group_id)""",
    "C17_U3_overrides": f"""WITH {_SELECT} SELECT group_id, format, CASE group_id % 5 WHEN 0 THEN 'SelectedByUser' WHEN 1 THEN 'UnresolvedConflict' WHEN 2 THEN 'ExplicitlyExcludedByUser' ELSE resolution END AS resolution, CASE group_id % 5 WHEN 0 THEN group_id * 100 + 1 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE source_id END AS source_id,
        CASE WHEN group_id % 5 = 3 THEN 'OVERRIDE.SOURCE_OUTSIDE_GROUP' END AS error FROM sel""",
    "C18_reconcile": "SELECT c_custkey AS group_id, CASE WHEN c_custkey % 3 = 0 THEN 'Reset' WHEN c_custkey % 7 = c_custkey % 5 THEN 'Current' ELSE 'Stale' END AS freshness FROM customer",
    "C19_eligibility": f"""WITH {_SELECT}, g2 AS (SELECT DISTINCT group_id FROM c), x AS (
        SELECT group_id, CASE group_id % 6 WHEN 0 THEN 'PLAN.REVIEW_REQUIRED' WHEN 1 THEN 'PLAN.REVIEW_DEFERRED' WHEN 2 THEN 'PLAN.RECORDS_KEEP_SEPARATE' ELSE 'PLAN.NOT_DUPLICATES' END AS code FROM g2 WHERE group_id % 6 < 4
        UNION SELECT group_id, 'PLAN.RECOMMENDATION_STALE' FROM g2 WHERE group_id % 7 = 0 UNION SELECT group_id, 'PLAN.TARGET_INVALID' FROM g2 WHERE group_id % 11 = 0 UNION SELECT group_id, 'PLAN.RECORDS_KEEP_SEPARATE' FROM g2 WHERE group_id % 13 = 0)
        SELECT group_id, code, NULL::BIGINT AS book_id, NULL::VARCHAR AS format FROM x UNION ALL SELECT group_id, CASE resolution WHEN 'Unavailable' THEN 'PLAN.SOURCE_FILE_UNAVAILABLE' ELSE 'PLAN.FORMAT_UNRESOLVED' END, NULL, format FROM sel WHERE resolution <> 'Selected'
        UNION ALL SELECT group_id, 'PLAN.SOURCE_FILE_UNAVAILABLE', book_id, format FROM c WHERE status <> 'Present' UNION ALL SELECT group_id, 'PLAN.SOURCE_HASH_REQUIRED', book_id, format FROM c WHERE sha256 IS NULL""",
    "C20_C21_plan_instructions": f"WITH {_PLAN} SELECT * FROM plan",
    "C22_U7_plan_coverage": f"""WITH {_PLAN}, q AS (SELECT * FROM plan WHERE NOT (kind = 'FormatRemoval' AND book_id % 7 = 0)), d AS (SELECT group_id, book_id, format, count(*) FILTER (kind = 'Retention') AS kept, count(*) FILTER (kind = 'FormatRemoval') AS gone, bool_or(reason = 'RemovedWithSourceRecordAfterRetention') AS moved FROM q WHERE kind IN ('Retention', 'FormatRemoval') GROUP BY ALL)
        SELECT c.group_id, c.book_id, c.format FROM c LEFT JOIN d USING (group_id, book_id, format) WHERE (c.group_id, c.format) IN (SELECT group_id, format FROM q WHERE format IS NOT NULL) AND NOT coalesce(kept + gone = 1 OR (kept = 1 AND gone = 1 AND moved), false)""",
    "C22_declared_coverage": f"""WITH {_PLAN}, q AS (SELECT * FROM plan WHERE NOT coalesce(format = 'MOBI' AND group_id % 5 = 0, false)), d AS (SELECT group_id, book_id, format, count(*) FILTER (kind = 'Retention') AS kept, count(*) FILTER (kind = 'FormatRemoval') AS gone, bool_or(reason = 'RemovedWithSourceRecordAfterRetention') AS moved FROM q WHERE kind IN ('Retention', 'FormatRemoval') GROUP BY ALL)
        SELECT c.group_id, c.book_id, c.format FROM c LEFT JOIN d USING (group_id, book_id, format) WHERE c.group_id IN (SELECT group_id FROM q) AND NOT coalesce(kept + gone = 1 OR (kept = 1 AND gone = 1 AND moved), false)""",
    "C23_required_issues": f"""WITH {_PLAN}, pg AS (SELECT DISTINCT group_id FROM plan) SELECT group_id, 'Information' AS severity, unnest(['PLAN.BACKUP_REQUIRED', 'PLAN.NO_FILES_MODIFIED', 'PLAN.REVIEW_BOUND', 'PLAN.VERIFICATION_REQUIRED']) AS code, 1::BIGINT AS n FROM pg
        UNION ALL SELECT group_id, 'Warning', 'PLAN.NON_IDENTICAL_REPLACEMENT', count(*) FROM plan WHERE reason = 'ReviewedNonIdenticalReplacement' GROUP BY 1 UNION ALL SELECT group_id, 'Information', 'PLAN.COVER_PRESENT', count(*) FROM c WHERE book_id % 5 = 0 AND group_id IN (FROM pg) GROUP BY 1""",
    "C24_J15_staleness": f"WITH {_DIFF} SELECT group_id, count(*) AS changes, 'PLAN.STALE' AS code FROM diff GROUP BY 1",
    "J15_C29_state_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "C25_W7_plan_lifecycle": """WITH r AS (SELECT user_id AS plan_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events), n AS (SELECT ['Draft', 'Valid', 'Approved', 'Stale'] AS a),
        s AS (SELECT plan_id, revision, a[(revision - 1) % 4 + 1] AS from_state, CASE WHEN event_type = 'error' THEN 'Revoked' ELSE a[revision % 4 + 1] END AS to_state FROM r, n),
        t AS (SELECT *, lag(to_state) OVER (PARTITION BY plan_id ORDER BY revision) AS prior FROM s) SELECT plan_id, revision, from_state, to_state FROM t WHERE NOT ((from_state, to_state) IN (('Draft', 'Valid'), ('Draft', 'Blocked'), ('Valid', 'Approved'), ('Valid', 'Stale'), ('Valid', 'Blocked'), ('Approved', 'Stale'), ('Approved', 'Revoked')) AND coalesce(from_state = prior, revision = 1))""",
    "C26_operation_graph": f"WITH {_OPS} SELECT group_id, ordinal::INT AS ordinal, operation, phase, CASE WHEN p = 3 THEN ordinal WHEN operation = 'verify:metadata' THEN 0 ELSE 1 END::BIGINT AS dependencies FROM graph",
    "C27_graph_violations": f"WITH {_OPS} SELECT group_id FROM graph GROUP BY 1 HAVING (group_id % 9 = 0 AND count(*) FILTER (p = 3) > 0) OR count(*) <> count(DISTINCT operation)",
    "H3_plan_digest": f"WITH {_PLAN} SELECT group_id, sha256(string_agg({_f8('kind')} || {_f8('book_id::VARCHAR')} || {_f8('format')} || {_f8('reason')}, '' ORDER BY kind, book_id, format NULLS FIRST, reason)) AS digest FROM plan GROUP BY 1",
    "G13_latest_plan": "SELECT o_custkey AS plan_id, max(o_orderkey) AS revision, max_by(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1",
    "G12_backup_size": "SELECT l_orderkey AS group_id, (3 * sum(l_partkey) + 67108864)::BIGINT AS needed FROM lineitem GROUP BY 1",
    "G11_G17_G18_summary": f"WITH {_CAND} SELECT count(*) AS files, count(DISTINCT group_id) AS groups, count(*) FILTER (status = 'Missing') AS missing, bool_or(score > 49) AS any_top, bool_and(score > 0) AS all_scored FROM c",
    "W6_W8_journal_predecessors": f"WITH {_JOURNAL} SELECT * FROM seen",
    "C32_journal_reconciliation": f"""WITH {_JOURNAL} SELECT execution_id, NOT v OR (m AND NOT (v AND t AND execution_id % 2 = 0)) AS recovery_required FROM (SELECT execution_id, bool_and(NOT after_terminal OR execution_id % 3 = 0) AS v, bool_or(kind = 'MutationStarted') AS m, bool_or(kind = 'TerminalSummary') AS t FROM seen GROUP BY 1)""",
    "C28_execution_lifecycle": """WITH r AS (SELECT user_id AS execution_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM events), n AS (SELECT ['Created', 'AcquiringLease', 'PreflightValidating', 'ReadyForBackup', 'BackingUp', 'BackupVerified'] AS a),
        s AS (SELECT execution_id, revision, a[(revision - 1) % 6 + 1] AS from_state, CASE WHEN event_type = 'click' THEN 'Completed' ELSE a[revision % 6 + 1] END AS to_state, event_type FROM r, n), t AS (SELECT *, lag(to_state) OVER (PARTITION BY execution_id ORDER BY revision) AS prior FROM s)
        SELECT execution_id, revision, from_state, to_state FROM t WHERE event_type = 'click' OR from_state = 'BackupVerified' OR NOT coalesce(from_state = prior, revision = 1)""",
    "C31_C34_backup_gaps": f"WITH {_PLAN} SELECT group_id, book_id, reason AS kind, format FROM plan WHERE kind = 'Backup' AND book_id % 10 = 3",
    "W9_circular_neighbours": """SELECT n_regionkey, n_nationkey, coalesce(lead(n_nationkey) OVER w, min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS "next", coalesce(lag(n_nationkey) OVER w, max(n_nationkey) OVER (PARTITION BY n_regionkey)) AS "previous" FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
    "E6_G14_readable_characters": f"WITH {_READ} SELECT page_id, host, readable, readable < 100 AS is_empty FROM read",
    "E7_E8_references": f"WITH {_REFS} SELECT * FROM refs",
    "E10_encryption": "SELECT user_id, CASE WHEN bool_and(event_type IN ('view', 'signup', 'error', 'click')) THEN 'FontObfuscation' ELSE 'Encrypted' END AS state FROM events GROUP BY 1",
    "G4_W4_scores": f"WITH {_SCORED} SELECT host, CASE WHEN bad THEN 'Disqualified' ELSE 'Completed' END AS status, CASE WHEN NOT bad THEN greatest(0, least(100, total)) END::INT AS score FROM sc",
    "G16_repeated_references": f"""WITH {_REFS}, n AS (SELECT host, kind, target, row_number() OVER (PARTITION BY host, kind, target ORDER BY page_id, position) AS n FROM refs) SELECT host, kind || ':' || target || '#' || n AS mark FROM n WHERE n > 1""",
    "J13_code_linkage": f"WITH {_SELECT} SELECT DISTINCT group_id, reason AS code FROM sel WHERE group_id % 3 = 0 AND reason = 'EPUB.SCORES_TOO_CLOSE'",
    "J14_U6_candidate_graph": f"""WITH {_CAND}, k AS (SELECT group_id, book_id, format, path, bool_or(score <> 7) AS d, bool_or(score <> 9) AS e FROM c GROUP BY ALL) SELECT group_id, count(*) FILTER (d AND NOT e) AS only_declared, count(*) FILTER (e AND NOT d) AS only_candidates FROM k GROUP BY 1 HAVING count(*) FILTER (d <> e) > 0""",
    "J16_presentation_lookup": f"WITH {_BOOKS} SELECT l_partkey + 1 AS book_id, count(*) AS uses, any_value(trim(title)) AS title FROM lineitem LEFT JOIN (SELECT * FROM books WHERE book_id % 6 <> 0) ON book_id = l_partkey + 1 GROUP BY 1",
    "C16_unsupported_shells": "SELECT DISTINCT o_custkey AS group_id, 'INPUT.INCOMPLETE' AS code FROM orders WHERE o_orderkey % 31 = 0",
    "C30_preflight": """WITH k AS (SELECT c_custkey AS k FROM customer) SELECT k AS plan_id, 'EXECUTION.APPROVAL_INVALID' AS code FROM k WHERE k % 2 <> 0 UNION ALL SELECT k, 'EXECUTION.PLAN_TAMPERED' FROM k WHERE k % 7 = 0 UNION ALL SELECT k, 'EXECUTION.PLAN_STALE' FROM k WHERE k % 3 = 0
        UNION ALL SELECT k, 'EXECUTION.PLAN_UNSAFE' FROM k WHERE k % 4 = 3 UNION ALL SELECT k, 'EXECUTION.SOURCE_UNAVAILABLE' FROM k WHERE k % 11 = 0""",
    "P12_execution_effects": f"""WITH {_PLAN}, tf AS (SELECT DISTINCT c.group_id, format FROM c JOIN tg ON c.group_id = tg.group_id AND book_id = target_id)
        SELECT p.group_id, CASE WHEN tf.format IS NULL THEN 'Add format' ELSE 'Replace format' END AS effect, book_id, p.format FROM plan p LEFT JOIN tf ON tf.group_id = p.group_id AND tf.format = p.format WHERE kind = 'Retention' AND reason = 'RetainFromOtherRecord'
        UNION ALL SELECT group_id, CASE WHEN kind = 'FormatRemoval' THEN 'Remove format' ELSE 'Remove record' END, book_id, format FROM plan WHERE kind IN ('FormatRemoval', 'RecordRemoval')""",
    "P1_P13_expected_records": f"WITH {_CAND}, f AS (SELECT group_id, count(*) AS n, max(format) AS m FROM c GROUP BY 1) SELECT o_orderkey AS book_id, o_orderpriority AS title, coalesce(o_orderstatus, '') AS publisher, coalesce(n, 0) AS formats, m AS last_format FROM orders LEFT JOIN f ON group_id = o_orderkey",
    "P3_findings_of_issues": f"WITH {_LINKS}, {_IDS}, x AS (SELECT 'AUTHOR_REFERENCE_MISSING' AS code FROM links LEFT JOIN authors USING (author_id) WHERE name IS NULL UNION ALL SELECT 'CATALOG_VALUE_INVALID' FROM ids WHERE trim(value) = '') SELECT code, 'Warning' AS severity, count(*) AS n FROM x GROUP BY 1",
    "U10_U9_lineage": """WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS a FROM events GROUP BY 1) SELECT user_id, user_id % 3 <> 0 OR (len(a) >= 3 AND a[3] = 'other') AS continues, user_id % 3 <> 0 OR (len(a) >= 3 AND a[3] = 'other') AS same_start FROM e""",
    "H4_graph_digest": f"WITH {_OPS}, o AS (SELECT *, (CASE WHEN p = 3 THEN ordinal WHEN operation = 'verify:metadata' THEN 0 ELSE 1 END)::VARCHAR AS n FROM graph) SELECT group_id, sha256(string_agg({_f16('operation')} || {_f16('phase')} || {_f16('n')}, '' ORDER BY ordinal, operation)) AS digest FROM o GROUP BY 1",
}
ORACLE_SQL["C3_strong_identifier_conflicts"] = " UNION ALL ".join(f"""SELECT *, '{t}' AS type FROM (WITH x AS ({ORACLE_SQL['X3_X7_G10_strong_identifiers']}), m AS (SELECT book_id % 200 AS group_id, book_id, coalesce(list_sort(list(DISTINCT strong) FILTER (starts_with(strong, '{t}:'))), []) AS strong FROM x GROUP BY ALL),
    sets AS (SELECT group_id, strong AS v, count(*) AS n FROM m WHERE len(strong) > 0 GROUP BY ALL) {_disjoint('strong', 'IDENTIFIER.STRONG_CONFLICT', 'm')})""" for t in ("ISBN", "DOI", "ASIN", "OCLC"))
ORACLE_SQL["C7_whole_cohorts"] = f"""WITH {_MEMBERS}, gone AS (SELECT book_id FROM ({ORACLE_SQL['C1_language_conflicts']}) UNION SELECT book_id FROM ({ORACLE_SQL['C2_series_conflicts']})
    UNION SELECT book_id FROM (WITH ed AS (SELECT group_id, book_id, CASE WHEN title LIKE '%Second Edition%' THEN 'SECOND EDITION' END AS edition FROM members) {_known('edition', 'E', 'ed')})
    UNION SELECT book_id FROM (WITH s AS (SELECT group_id FROM members GROUP BY 1 HAVING max(year) - min(year) >= 2), wide AS (SELECT m.* FROM members m JOIN s USING (group_id)) {_known('year', 'Y', 'wide')})),
    m AS (SELECT group_id, book_id, book_id NOT IN (SELECT book_id FROM gone) AS stays FROM members), n AS (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY group_id) AS size FROM m)
    SELECT group_id, book_id, stays AND size >= 2 AS in_cohort, CASE WHEN size < 2 THEN 'RetainedSeparate' WHEN stays THEN 'Cohort' ELSE 'Separated' END AS outcome FROM n"""

# assessments as evidence, orders, overrides and backups
_HEAD = """h AS (SELECT l_orderkey * 100 + l_linenumber AS book_id, l_orderkey * 31 + l_linenumber * 7 AS k, 'a/b' || l_linenumber AS path, min(CASE WHEN l_suppkey % 13 <> 0 THEN sha256((l_suppkey % 3)::VARCHAR) END) AS first_sha FROM lineitem WHERE l_returnflag = 'A' AND (l_orderkey * 31 + l_linenumber * 7) % 17 <> 0 GROUP BY ALL),
    heads AS (SELECT book_id, 'EPUB' AS format, path, CASE WHEN k % 5 < 2 OR k % 11 = 0 THEN 'Disqualified' ELSE 'Completed' END AS assessment, CASE WHEN NOT (k % 5 < 2 OR k % 11 = 0) THEN k % 101 END AS points, CASE WHEN k % 19 = 0 THEN '1.1' ELSE '1.0' END AS analyzer, '1.0' AS model, CASE WHEN k % 23 = 0 THEN 'old' ELSE first_sha END AS seen FROM h),
    j AS (SELECT c.*, assessment, points, analyzer, model, seen FROM c LEFT JOIN heads ON heads.book_id = c.book_id AND heads.path = c.path WHERE c.format = 'EPUB')"""
ORACLE_SQL["J8_candidate_assessments"] = f"WITH {_CAND}, {_HEAD} SELECT group_id, book_id, format, replace(path, '/', chr(92)) AS path, status, assessment, points AS score, analyzer, model FROM j"
ORACLE_SQL["J11_assessment_evidence"] = f"""WITH {_CAND}, {_HEAD}, w AS (SELECT book_id, CASE WHEN book_id % 31 = 0 THEN 'PDF' ELSE format END AS format, CASE WHEN book_id % 37 = 0 THEN 'gone/x' ELSE path END AS path FROM heads)
    SELECT book_id, format, path, CASE WHEN book_id % 29 = 0 THEN 'Repeated' WHEN format = 'PDF' THEN 'NotEpub' ELSE 'Undeclared' END AS fault FROM w WHERE book_id % 29 = 0 OR format <> 'EPUB' OR NOT EXISTS (FROM c WHERE c.book_id = w.book_id AND c.path = w.path AND c.format = 'EPUB')"""
ORACLE_SQL["C12_assessment_currency"] = f"""WITH {_CAND}, {_HEAD}, g AS (SELECT group_id, count(*) FILTER (assessment IS NULL OR seen IS DISTINCT FROM sha256) AS bad, count(DISTINCT analyzer) AS kinds FROM j WHERE status = 'Present' GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT sha256) > 1)
    SELECT group_id, 'ASSESSMENT.STALE_OR_INCOMPARABLE' AS code, CASE WHEN bad > 0 THEN 'Fingerprint' ELSE 'Version' END AS cause FROM g WHERE bad > 0 OR kinds > 1"""
ORACLE_SQL["O9_decision_evidence"] = f"""WITH {_CAND}, {_HEAD}, r AS (SELECT DISTINCT group_id // 64 AS group_id, book_id, assessment, points, analyzer, model FROM j),
    n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY book_id) AS p, count(*) OVER (PARTITION BY group_id) AS total FROM r),
    k AS (SELECT book_id, k FROM h), f AS (SELECT book_id, 'EPUB.NAVIGATION' AS rule, CASE WHEN k % 3 = 0 THEN 'Warning' ELSE 'Positive' END AS severity, CASE WHEN k % 3 = 0 THEN -6 ELSE 4 END AS points FROM k
    UNION ALL SELECT book_id, 'EPUB.CHAPTER.EMPTY', 'Error', -2 FROM k WHERE k % 4 = 0 UNION ALL SELECT book_id, 'EPUB.CHAPTER.EMPTY', 'Error', -2 FROM k WHERE k % 8 = 0 UNION ALL SELECT book_id, 'EPUB.OPEN', 'Disqualifying', 0 FROM k WHERE k % 5 < 2),
    t AS (SELECT book_id, string_agg(rule || ':' || severity || ':' || points, ',' ORDER BY rule || ':' || severity || ':' || points) AS findings, array_to_string(list(rule || ': adjusts by ' || points ORDER BY rule, 'adjusts by ' || points)[:4], ' | ') AS explanations FROM f GROUP BY 1)
    SELECT group_id, n.book_id, coalesce(assessment, 'missing') AS status, CASE WHEN assessment IS NOT NULL THEN coalesce(n.points::VARCHAR, 'not-scored') END AS score, analyzer, model, findings, explanations, greatest(total - 12, 0) AS omitted FROM n LEFT JOIN t ON t.book_id = n.book_id WHERE p <= 12"""
ORACLE_SQL["E12_absent_files"] = """SELECT s AS status, CASE WHEN s IS NULL THEN 'Unreadable' ELSE ['CannotOpen', 'UnsafeArchive', 'Unreadable', 'ChangedDuringInspection'][i] END AS problem, count(*) AS n
    FROM (SELECT l_linenumber % 6 AS i, ['Present', 'Missing', 'InvalidPath', 'Inaccessible', 'ChangedDuringHashing'][l_linenumber % 6 + 1] AS s FROM lineitem) GROUP BY ALL"""
ORACLE_SQL["O3_metadata_group_order"] = f"WITH {_BOOKS}, {_LINKS}, {_IDENTITY}, g AS (SELECT {_GROUP_ID} AS group_id, title_key, ks FROM identity GROUP BY title_key, ks HAVING count(*) >= 2) SELECT group_id, title_key, row_number() OVER (PARTITION BY title_key ORDER BY ks, group_id) AS ordinal FROM g"
ORACLE_SQL["O6_statement_order"] = f"""WITH {_SELECT}, said AS (SELECT group_id, CASE WHEN reason LIKE 'EPUB.%' THEN 'Assessment' ELSE 'Format' END AS subject, format, source_id AS book_id, reason AS code, resolution AS explanation FROM sel
    UNION ALL SELECT DISTINCT group_id, 'Record', NULL, book_id, 'RECORD.LARGE', score::VARCHAR FROM c WHERE score > 40)
    SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE subject WHEN 'Format' THEN 3 WHEN 'Record' THEN 4 ELSE 5 END, format NULLS FIRST, coalesce(book_id, 0), code, explanation) AS ordinal FROM said"""
ORACLE_SQL["O7_issue_order"] = f"""WITH i AS (SELECT group_id, severity, NULL::BIGINT AS book_id, NULL::VARCHAR AS format, code, n::VARCHAR AS explanation FROM ({ORACLE_SQL['C23_required_issues']})
    UNION ALL SELECT * FROM (WITH {_CAND} SELECT DISTINCT group_id, 'BlockingError', book_id, format, 'PLAN.SOURCE_FILE_UNAVAILABLE', '' FROM c WHERE status = 'Missing'))
    SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY severity = 'Information', severity = 'Warning', coalesce(book_id, 0), format NULLS FIRST, code, explanation) AS ordinal FROM i"""
ORACLE_SQL["O10_backup_order"] = f"""WITH {_PLAN}, b AS (SELECT DISTINCT group_id, CASE reason WHEN 'Format' THEN 'FormatFile' ELSE 'RecordMetadataSnapshot' END AS kind, book_id, format, concat_ws(':', reason, book_id, format) AS id FROM plan WHERE kind = 'Backup')
    SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY kind DESC, coalesce(book_id, 0), format NULLS FIRST, id) AS ordinal FROM b"""
ORACLE_SQL["C9_invalid_identifiers"] = f"WITH x AS ({ORACLE_SQL['X3_X7_G10_strong_identifiers']}) SELECT DISTINCT book_id, 'IDENTIFIER.STRONG_INVALID' AS code FROM x WHERE kind IS NOT NULL AND strong IS NULL"
ORACLE_SQL["C10_without_formats"] = "SELECT p_size::BIGINT AS group_id, p_partkey AS book_id, 'FORMAT.NO_DECLARED_FORMATS' AS code FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)"
_REVIEW = """o AS (SELECT o_custkey AS g, o_orderkey AS b, o_orderstatus AS f, o_orderkey % 9 <> 0 AS there, o_orderkey % 37 = 0 AS gen FROM orders), e AS (SELECT g, min(b) AS lo, max(b) AS hi FROM o GROUP BY 1),
    sel AS (SELECT g, f, min(b) AS s FROM o WHERE there GROUP BY ALL),
    v AS (SELECT g, lo, ['Unreviewed', 'Accepted', 'ManuallyAdjusted', 'Deferred', 'KeepSeparate', 'NotDuplicates', 'Odd'][g % 7 + 1] AS req, g % 11 <> 0 AS live, CASE g % 5 WHEN 1 THEN hi WHEN 2 THEN 0 END AS src, g % 7 IN (4, 5) AS apart FROM e),
    fo AS (SELECT g, f, CASE WHEN g % 16 = 1 THEN 'Other' ELSE ['SelectSource', 'MarkUnresolved', 'ExcludeFinalFormat'][g % 3 + 1] END AS act, CASE WHEN g % 16 <> 1 AND g % 3 = 0 THEN CASE WHEN g % 10 < 7 THEN s ELSE -1 END WHEN g % 13 = 0 THEN 5 END AS s, true AS known FROM sel WHERE g % 4 = 1
    UNION ALL SELECT g, CASE WHEN g % 29 = 3 THEN ' ' ELSE 'ZIP' END, 'MarkUnresolved', NULL, false FROM e WHERE g % 29 = 3 OR g % 31 = 4),
    keep AS (SELECT g, b FROM o WHERE gen OR b % 23 = 0 UNION SELECT g, -7 FROM e WHERE g % 41 = 0),
    e1 AS (SELECT g, 'REVIEW_STATUS_INVALID' AS code, NULL::VARCHAR AS about FROM v WHERE req = 'Odd' UNION ALL SELECT g, 'STALE_OVERRIDE', NULL FROM v WHERE NOT live UNION ALL SELECT g, 'METADATA_SOURCE_NOT_MEMBER', '0' FROM v WHERE live AND src = 0
    UNION ALL SELECT g, 'RETAINED_RECORD_NOT_MEMBER', '-7' FROM v WHERE live AND g % 41 = 0
    UNION ALL SELECT g, CASE WHEN trim(f) = '' THEN 'FORMAT_REQUIRED' WHEN act = 'Other' THEN 'FORMAT_ACTION_INVALID' WHEN NOT known THEN 'FORMAT_NOT_REPRESENTED' WHEN act = 'SelectSource' THEN 'FORMAT_SOURCE_UNAVAILABLE' ELSE 'FORMAT_ACTION_SOURCE_CONFLICT' END, f FROM fo JOIN v USING (g)
        WHERE live AND (trim(f) = '' OR act = 'Other' OR NOT known OR (act = 'SelectSource' AND s = -1) OR (act <> 'SelectSource' AND s IS NOT NULL))
    UNION ALL SELECT g, 'RETAINED_METADATA_CONFLICT', coalesce(src, lo)::VARCHAR FROM v WHERE live AND NOT apart AND (g, coalesce(src, lo)) IN (SELECT (g, b) FROM keep)),
    e2 AS (SELECT sel.g, 'RETAINED_FORMAT_CONFLICT' AS code, sel.f AS about FROM sel JOIN v USING (g) LEFT JOIN fo ON fo.g = sel.g AND fo.f = sel.f WHERE live AND NOT apart AND sel.g NOT IN (SELECT g FROM e1) AND (sel.g, CASE WHEN act IS NULL THEN sel.s WHEN act = 'SelectSource' THEN fo.s END) IN (SELECT (g, b) FROM keep)),
    ok AS (SELECT *, (src IS NOT NULL AND src <> lo) OR g IN (SELECT g FROM fo) OR g IN (SELECT g FROM o WHERE b % 23 = 0 AND NOT gen) AS changed FROM v WHERE g NOT IN (SELECT g FROM e1) AND g NOT IN (SELECT g FROM e2))"""
ORACLE_SQL["C17_override_errors"] = f"WITH {_REVIEW} SELECT g AS group_id, code, about FROM (FROM e1 UNION ALL FROM e2 UNION ALL SELECT g, 'ACCEPTED_REQUIRES_GENERATED_SELECTION', NULL FROM ok WHERE req = 'Accepted' AND changed)"
ORACLE_SQL["C17_reviewed_recommendations"] = f"""WITH {_REVIEW}, q AS (SELECT *, NOT apart AND g IN (SELECT g FROM o WHERE NOT gen AND b % 23 <> 0) AS effective FROM ok WHERE NOT (req = 'Accepted' AND changed))
    SELECT g AS group_id, CASE WHEN req IN ('KeepSeparate', 'NotDuplicates', 'Deferred') THEN req WHEN changed THEN 'ManuallyAdjusted' WHEN req = 'Accepted' THEN req ELSE 'Unreviewed' END AS status, CASE WHEN effective THEN coalesce(src, lo) END AS source_id, effective FROM q"""
ORACLE_SQL["C31_confirmations"] = "SELECT user_id AS group_id, 'EXECUTION.BACKUP_CONFIRMATION_MISSING' AS code, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1 HAVING n <> 1"
ORACLE_SQL["C34_backup_files"] = """WITH r AS (SELECT DISTINCT o_orderkey AS k FROM orders), w AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
    x AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS c, bool_and(l_partkey = p AND (l_orderkey + l_linenumber) % 23 <> 0) AS same FROM lineitem JOIN w ON k = l_orderkey AND n = l_linenumber WHERE (l_orderkey + l_linenumber) % 19 <> 0 GROUP BY ALL),
    cv AS (SELECT k, k % 2 = 0 AS has, (k % 2 = 0 AND k % 7 <> 0) OR k % 13 = 0 AS stored FROM r)
    SELECT k AS book_id, NULL AS format, 'EXECUTION.BACKUP_METADATA_MISSING' AS code FROM r WHERE k % 17 = 0 AND k % 41 <> 0
    UNION ALL SELECT k, NULL, 'EXECUTION.BACKUP_METADATA_INVALID' FROM r WHERE k % 17 <> 0 AND (k % 29 = 0 OR k % 41 = 0)
    UNION ALL SELECT k, NULL, 'EXECUTION.BACKUP_COVER_MISSING' FROM cv WHERE has AND NOT stored UNION ALL SELECT k, NULL, 'EXECUTION.BACKUP_COVER_INVALID' FROM cv WHERE stored AND (NOT has OR k % 31 = 0)
    UNION ALL SELECT k, NULL, 'EXECUTION.UNMODELED_EXTRA_DATA' FROM r WHERE k % 43 = 0
    UNION ALL SELECT w.k, 'F' || w.n, CASE WHEN x.c IS NULL THEN 'EXECUTION.BACKUP_EXPORTED_FORMAT_MISSING' ELSE 'EXECUTION.BACKUP_EXPORTED_FORMAT_INVALID' END FROM w JOIN r USING (k) LEFT JOIN x ON x.k = w.k AND x.n = w.n WHERE x.c IS NULL OR x.c > 1 OR NOT x.same"""
