"""The queries that SQL can express, for DuckDB."""

SQL_CHECKS = {
    "op1_warc_archives": r"""
        WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        hashed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS digest FROM rows),
        ranked AS (
            SELECT *, first_value(page_id) OVER same AS head, row_number() OVER same AS place
            FROM hashed WINDOW same AS (PARTITION BY digest ORDER BY page_id DESC NULLS LAST)
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(digest, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
            CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN place > 1 THEN head END AS refers_to
        FROM ranked
    """,
    "op8_norm_buckets": r"""
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.vec, v.vec)::BIGINT AS score
            FROM vectors q JOIN vectors v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op9_chat_examples": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), numbered AS (
            SELECT *,
                row_number() OVER own AS place,
                count(*) OVER (PARTITION BY conv_id) AS turns,
                12 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
                    + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS chars
            FROM rows WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
        ), summed AS (
            SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM numbered
        )
        SELECT conv_id, max(turns)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (sum(upto) FILTER (role = 'assistant' OR place = turns))::BIGINT AS formatted_chars
        FROM summed GROUP BY conv_id
    """,
    "op11_importance_draw": r"""
        WITH crc_table AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
        ), texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, true AS own FROM documents
            UNION ALL
            SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false FROM benchmark
        ), numbered AS (SELECT *, row_number() OVER () AS place FROM texts),
        runs AS (
            SELECT place, own, unnest(list_concat(words,
                list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
                list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature
            FROM numbered
        ), counted AS (SELECT place, own, feature, count(*) AS n FROM runs GROUP BY ALL),
        hexed AS (SELECT feature, hex(encode(feature)) AS digits FROM (SELECT DISTINCT feature FROM counted)),
        hashed AS (
            SELECT feature, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(1, len(digits), 2), lambda i: ('0x' || digits[i:i + 1])::BIGINT)),
                lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM hexed, crc_table
        ), tally AS (
            SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t
            FROM counted JOIN hashed USING (feature) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM tally) + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM tally) + 10000)::DOUBLE)))::BIGINT AS gain FROM tally
        ), summed AS (
            SELECT place, sum(n) AS n_features, sum(n * gain) AS weight
            FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE own GROUP BY place
        ), scored AS (
            SELECT doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT
                    + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM numbered LEFT JOIN summed USING (place) WHERE own
        ), placed AS (
            SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place_,
                count(*) FILTER (WHERE fit) OVER () AS eligible FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place_ <= 5 * eligible // 100 THEN place_ END AS rank FROM placed
    """,
    "op13_filter_audit": r"""
        WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
        ),
        marks AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
            FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ),
        texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        failed AS (
            SELECT doc_id, part, concat(
                CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END) AS fails
            FROM texts
        ),
        cells AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails
        ),
        seen AS (
            SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter, n, good, toxic, fails,
                fails = '' OR NOT regexp_matches(fails, '[' || filter_order[1:step - 1] || '-]') AS alive,
                contains(fails, filter_order[step]) AS hit
            FROM cells, orders, range(1, 6) AS r(step)
        ),
        steps AS (
            SELECT part, filter_order, step, letter,
                coalesce(sum(n) FILTER (WHERE alive AND NOT hit), 0) AS kept,
                coalesce(sum(n) FILTER (WHERE alive AND hit), 0) AS removed,
                coalesce(sum(n) FILTER (WHERE NOT alive AND hit), 0) AS redundant,
                coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
                coalesce(sum(good) FILTER (WHERE alive AND hit), 0) AS good_lost,
                coalesce(sum(toxic) FILTER (WHERE alive AND hit), 0) AS toxic_lost
            FROM seen GROUP BY ALL
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
            unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
        FROM steps
    """,
}
