"""DuckDB SQL for the queries that SQL can express over the whole tables."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": rf"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM docs WHERE len(w) >= 20),
        keyed AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM starts),
        ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM keyed),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM ranked WHERE r > 1),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
        keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h FROM p),
        b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest FROM d),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM f""",
    "op6_minhash": rf"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM docs),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
        ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
        comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN comp USING (doc_id)""",
}
