"""For each registered query the same answer in SQL, as DuckDB runs it.

The SQL spells the semantics, the input formulas and all fixed values again,
from the same tables, without using anything of the Spark side.
"""

from __future__ import annotations

# Fixed values, spelled again so that an error in the operators shows.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
STOP_WORDS = (
    "is the a an and or but in on at to for of with by from as are was be been being have has had do does did will would could"
    " should may might shall which that this these those it its enough still just our we us they their"
).split()
NO_RESULTS = "No search results available."
NO_DOCUMENTS = "No supporting documents uploaded."
PADDING_BEFORE, PADDING_AFTER = "\u00a0 \t", "\u2003\n"
CONFIDENCES = ["82", "150", "-10", '"85"', '"85.5"', "85.9", "true", "null", "[1]", '"bad"', "-0.5", None]
GENERIC = [
    "What are the top revenue drivers and how have they trended over time?",
    "Where are the biggest gaps between current performance and market opportunity?",
    "Which customer segments show the highest growth potential?",
    "What seasonal patterns exist and how should inventory strategy reflect them?",
    "Which product lines warrant dedicated investment based on growth trajectory?",
]
# Event types stand for columns: click for total_revenue, view for year, purchase for region, error for vehicle_platform.
RULES = [
    ("bool_or(event_type = 'click') AND bool_or(event_type = 'view')", "Which year showed the strongest revenue growth and what drove it?"),
    ("bool_or(event_type = 'purchase')", "Which regions are underperforming relative to their market potential?"),
    ("bool_or(event_type = 'error')", "Which product categories have the highest revenue per transaction?"),
    ("bool_or(event_type NOT IN ('click', 'view', 'purchase', 'error'))", "What impact do industry events have on sales volume and category mix?"),
]

NL = "chr(10)"
WS = "'" + WHITESPACE + "'"
WS_RUN = r"[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"


def _numpy(value: str, digits: int = 2) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({value})::DOUBLE * {scale}, 0)::DOUBLE / {scale})"


def _python(value: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', ({value})::DOUBLE) AS DOUBLE)"


def _strip(value: str) -> str:
    return f"trim({value}, {WS})"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SALES = """sales AS (
  SELECT r_name AS region, p_type AS build_category, p_brand AS vehicle_platform, c_mktsegment AS customer_segment,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
         CAST(month(o_orderdate) AS INTEGER) AS month,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS total_revenue
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN part ON l_partkey = p_partkey)"""
REVENUE = "coalesce(CAST(sum(total_revenue) AS DOUBLE), 0.0)"


def _revenue_by(key: str, tail: str = "") -> str:
    return f"""WITH {SALES} SELECT CAST({key} AS VARCHAR) AS key, {_numpy(REVENUE)} AS revenue
        FROM sales WHERE {key} IS NOT NULL GROUP BY {key} {tail}"""


GROWTH = f"""WITH {SALES}, sums AS (
    SELECT build_category AS g, year AS y, {_numpy(REVENUE)} AS revenue FROM sales
    WHERE build_category IS NOT NULL AND year IS NOT NULL GROUP BY ALL),
  filled AS (
    SELECT gs.g, ys.y, coalesce(sums.revenue, 0.0) AS revenue
    FROM (SELECT DISTINCT g FROM sums) gs CROSS JOIN (SELECT DISTINCT y FROM sums) ys
         LEFT JOIN sums ON sums.g = gs.g AND sums.y = ys.y),
  paired AS (SELECT *, lag(revenue) OVER (PARTITION BY g ORDER BY y) AS before FROM filled)
  SELECT g AS "group", y AS year, revenue,
         CASE WHEN before > 0 THEN {_numpy('(revenue - before) / before * 100.0', 1)} END AS yoy_pct FROM paired"""

SERIES = "CASE WHEN build_category = 'PROMO' THEN 'segment' ELSE 'rest' END"


def _label(value: str) -> str:
    return f"CASE WHEN {value} >= 1000000 THEN printf('$%.1fM', {value} / 1000000.0) ELSE printf('$%.0fK', {value} / 1000.0) END"


def _findings() -> str:
    sums = "WITH {0} SELECT CAST({1} AS VARCHAR) AS key, {2} AS value FROM sales WHERE {1} IS NOT NULL GROUP BY {1}"
    parts = [("revenue_by_build_category", "build_category"), ("revenue_by_region", "region"), ("revenue_by_year", "year")]
    rows = [f"SELECT '{part}' AS part, key, NULL AS series, revenue AS value, NULL::DOUBLE AS pct FROM ({_revenue_by(key)})" for part, key in parts]
    top = _revenue_by("vehicle_platform", f"ORDER BY {REVENUE} DESC, vehicle_platform LIMIT 5")
    rows.append(f"SELECT 'top_vehicles', key, NULL, revenue, NULL FROM ({top})")
    rows.append(f"SELECT 'growth_rates', \"group\", year::VARCHAR, revenue, yoy_pct FROM ({GROWTH})")
    for part, key in parts:
        rows.append(f"SELECT 'charts.{part}', key, 'revenue', value, NULL FROM ({sums.format(SALES, key, REVENUE)})")
    rows.append(f"""SELECT 'charts.baja_growth_trend', key, series, value, NULL FROM (WITH {SALES}
        SELECT year::VARCHAR AS key, {SERIES} AS series, {REVENUE} AS value FROM sales WHERE year IS NOT NULL GROUP BY ALL)""")
    return " UNION ALL ".join(rows)


FINDINGS = _findings()

# --- profiling -------------------------------------------------------------

GAPPY = """gappy AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN o_totalprice >= 100000.0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"""
_COLUMNS = {
    "o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64",
    "o_orderdate": "datetime64[ns]", "o_orderpriority": "object",
}
PROFILE_COLUMNS = f"WITH {GAPPY} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", {i} AS position, '{dtype}' AS dtype, count(*) - count({name}) AS null_count,
    {_python(f'(count(*) - count({name}))::DOUBLE / count(*)::DOUBLE * 100.0', 2)} AS null_pct,
    count(DISTINCT {name}) AS unique_count FROM gappy"""
    for i, (name, dtype) in enumerate(_COLUMNS.items())
)
_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {_numpy(f'avg({c}::DOUBLE)')} AS mean, {_numpy(f'stddev_samp({c}::DOUBLE)')} AS std,
    {_numpy(f'min({c})')} AS min, {_numpy(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {_numpy(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50,
    {_numpy(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75, {_numpy(f'max({c})')} AS max FROM {source}"""
        for c in columns
    )


def _top(columns: tuple[str, ...], source: str) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, {c} AS value,
    count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in columns
    ) + ") WHERE rank <= 5"


PROFILE_NUMERIC = _numeric(_NUMERIC, "lineitem")
TOP_VALUES = _top(("p_name", "p_brand", "p_type"), "part")


def _stamp(value: str) -> str:
    return f"""CASE WHEN date_trunc('second', {value}) = {value} THEN strftime({value}, '%Y-%m-%d %H:%M:%S')
        ELSE strftime({value}, '%Y-%m-%d %H:%M:%S.%f') END"""


DATE_RANGE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {_stamp('lo')} AS min, {_stamp('hi')} AS max FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM {t})"""
    for c, t in (("ts", "events"), ("l_shipdate", "lineitem"))
)
_HEALTH_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_HEALTH_PCT = " + ".join(
    f"CAST({_python(f'(n - {c}_filled)::DOUBLE / n::DOUBLE * 100.0', 2)} AS DECIMAL(9,2))" for c in _HEALTH_COLUMNS
)
_HEALTH_LIST = ", ".join(_HEALTH_COLUMNS)


def _health(source: str) -> str:
    return f"""WITH {GAPPY}, t AS ({source}),
  counts AS (SELECT count(*) AS n, {', '.join(f'count({c}) AS {c}_filled' for c in _HEALTH_COLUMNS)},
             (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d FROM t),
  scores AS (SELECT greatest(0.0, 100.0 - ({_HEALTH_PCT})::DOUBLE / {len(_HEALTH_COLUMNS)})::DOUBLE AS completeness_score,
             least(100.0, n::DOUBLE / 100.0 * 10.0)::DOUBLE AS row_score,
             greatest(0.0, 100.0 - (n - d)::DOUBLE / n::DOUBLE * 100.0 * 2.0)::DOUBLE AS duplicate_score FROM counts)
  SELECT *, CAST(floor((completeness_score + row_score + duplicate_score) / 3.0) AS INTEGER) AS data_health_score FROM scores"""


HEALTH = _health(f"SELECT {_HEALTH_LIST} FROM gappy UNION ALL SELECT {_HEALTH_LIST} FROM gappy WHERE o_orderkey % 10 = 0")


def _fields(part: str, source: str, keys: list[str], numbers: list[str], words: list[str]) -> str:
    """Rows (part, field, number, text) of a table."""
    label = " || '.' || ".join([*(f'"{k}"::VARCHAR' for k in keys), "'{}'"])
    rows = [(label.format(n), f'"{n}"::DOUBLE', "NULL::VARCHAR") for n in numbers] + [(label.format(w), "NULL::DOUBLE", f'"{w}"') for w in words]
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {f} AS field, {n} AS number, {w} AS text FROM ({source})" for f, n, w in rows)


_STAMPED = f"""SELECT 'o_orderdate' AS "column", {_stamp('lo')} AS min, {_stamp('hi')} AS max
  FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)"""
PROFILE_TABLE = f"WITH {GAPPY} " + " UNION ALL ".join(
    [
        _fields("shape", "SELECT count(*) AS rows, 6 AS columns FROM gappy", [], ["rows", "columns"], []),
        _fields("columns", PROFILE_COLUMNS, ["column"], ["position", "null_count", "null_pct", "unique_count"], ["dtype"]),
        _fields("numeric_summary", _numeric(["o_orderkey", "o_custkey", "o_totalprice"], "gappy"), ["column"],
                ["count", "mean", "std", "min", "p25", "p50", "p75", "max"], []),
        _fields("categorical_summary", _top(("o_orderstatus", "o_orderpriority"), "gappy"), ["column", "rank"], ["n"], ["value"]),
        _fields("date_range", _STAMPED, ["column"], [], ["min", "max"]),
        _fields("data_health_score", _health(f"SELECT {_HEALTH_LIST} FROM gappy"), [],
                ["completeness_score", "row_score", "duplicate_score", "data_health_score"], []),
    ]
)

PROFILE_INCREMENTAL = f"""WITH {GAPPY}, found AS ({PROFILE_COLUMNS.removeprefix(f"WITH {GAPPY} ")}),
  numbers AS ({_numeric(["o_orderkey", "o_custkey", "o_totalprice"], "gappy")})
  SELECT "column", position, dtype, null_count, null_pct, TRUE AS unique_fits, count, mean, std, min, max,
    CASE WHEN count IS NOT NULL THEN TRUE END AS quantiles_fit FROM found LEFT JOIN numbers USING ("column")"""

# --- search ----------------------------------------------------------------

_STOPS = "[" + ", ".join(_text(w) for w in STOP_WORDS) + "]"


def _keywords(value: str, word: str) -> str:
    return f"""array_to_string(list_slice(list_filter(regexp_split_to_array(translate(lower({value}), '?,', ''), '{WS_RUN}'),
        lambda {word}: length({word}) > 2 AND NOT list_contains({_STOPS}, {word})), 1, 8), ' ')"""


SEARCH_QUERIES = f"""WITH runs AS (SELECT conv_id, turn, ' ' || text AS question, string_split(text, '. ') AS findings FROM conversations),
  keyed AS (SELECT *, substring({_strip('question')}, 1, 120) AS p, {_keywords('question', 'w')} AS k,
    list_transform(list_filter(list_slice(findings, 1, 3),
      lambda f: contains(lower(f), 'heron') OR contains(lower(f), 'tion') OR contains(lower(f), 'sch')),
      lambda g: {_keywords('g', 'v')}) AS anchored FROM runs),
  listed AS (SELECT conv_id, turn, list_filter([p, CASE WHEN k <> '' AND k <> p THEN k END,
    list_filter(anchored, lambda q: q <> '' AND q <> p AND q <> k)[1]], lambda x: x IS NOT NULL) AS queries FROM keyed)
  SELECT conv_id, turn, CAST(generate_subscripts(queries, 1) - 1 AS INTEGER) AS query_idx, unnest(queries) AS query FROM listed"""

_FULL = """'{"title": "T", "content": ' || h || ', "url": ' || u || '}'"""
_OTHER = """'{"snippet": ' || h || ', "link": ' || u || '}'"""
_NULLS = """'{"title": null, "content": null, "snippet": ' || h || ', "url": null, "link": ' || u || '}'"""


def _present(item: str, key: str, default: str) -> str:
    return f"CASE WHEN json_exists({item}, '$.{key}') THEN json_extract_string({item}, '$.{key}') ELSE {default} END"


NORMALIZE = f"""WITH pages2 AS (SELECT page_id, html, to_json(html)::VARCHAR AS h, to_json(url)::VARCHAR AS u FROM pages),
  answers AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '[' || {_FULL} || ', 7, ' || h || ', null, ' || {_OTHER} || ']'
    WHEN 1 THEN '[' || {_NULLS} || ']' WHEN 2 THEN h WHEN 3 THEN html WHEN 4 THEN '[]' ELSE {_FULL} END AS raw FROM pages2),
  kinds AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw::JSON) END AS kind FROM answers),
  items AS (SELECT page_id, unnest(from_json(raw::JSON, '["JSON"]')) AS item,
            generate_subscripts(from_json(raw::JSON, '["JSON"]'), 1) AS pos FROM kinds WHERE kind = 'ARRAY'),
  listed AS (SELECT page_id, pos, item, json_type(item) AS kind FROM items WHERE json_type(item) IN ('OBJECT', 'VARCHAR'))
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS result_idx,
    CASE WHEN kind = 'OBJECT' THEN {_present('item', 'title', "''")} ELSE '' END AS title,
    CASE WHEN kind = 'OBJECT' THEN {_present('item', 'content', _present('item', 'snippet', "''"))}
         ELSE json_extract_string(item, '$') END AS content,
    CASE WHEN kind = 'OBJECT' THEN {_present('item', 'url', _present('item', 'link', "''"))} ELSE '' END AS url FROM listed
  UNION ALL
  SELECT page_id, 0, '', CASE WHEN kind = 'VARCHAR' THEN json_extract_string(raw::JSON, '$') ELSE raw END, ''
  FROM kinds WHERE kind IS NULL OR kind <> 'ARRAY'"""

RESULTS = """found AS (
    SELECT page_id // 10 AS run_id, 0 AS query_idx, CAST(page_id % 10 AS INTEGER) AS result_idx,
           'Page ' || page_id AS title, html AS content, url FROM pages
    UNION ALL
    SELECT page_id // 10, 1, CAST(9 - page_id % 10 AS INTEGER), CASE WHEN page_id % 5 <> 0 THEN 'Copy ' || page_id ELSE '' END,
           html, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END FROM pages),
  merged AS (SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY query_idx, result_idx) AS r FROM found) WHERE r = 1 OR url = '')"""
RESULT_BLOCK = f"""WITH {RESULTS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY query_idx, result_idx) AS r FROM merged),
  blocks AS (SELECT run_id, string_agg('[Result ' || r || ']' || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END || {NL}
      || substring(content, 1, 600) || {NL} || url, {NL} || {NL} ORDER BY r) AS block FROM ranked WHERE r <= 8 GROUP BY run_id),
  runs AS (SELECT page_id // 10 AS run_id FROM pages UNION SELECT item_id FROM benchmark)
  SELECT runs.run_id, coalesce(block, {_text(NO_RESULTS)}) AS block FROM runs LEFT JOIN blocks ON runs.run_id = blocks.run_id"""

OUTCOMES = """outcomes AS (SELECT page_id // 10 AS run_id, CAST(page_id % 10 AS INTEGER) AS query_idx, html, url,
    CASE WHEN page_id % 4 <> 0 THEN 'primary' WHEN page_id % 40 <> 0 AND page_id % 24 <> 0 THEN 'fallback' END AS provider FROM pages)"""
FALLBACK = f"""WITH {OUTCOMES}
  SELECT run_id, query_idx, provider, 0 AS result_idx, provider AS title, html AS content, url FROM outcomes
  WHERE run_id NOT IN (SELECT run_id FROM outcomes WHERE provider IS NULL)"""
FAILED = f"WITH {OUTCOMES} SELECT run_id, count(*) AS failed_queries FROM outcomes WHERE provider IS NULL GROUP BY run_id"

# --- chunks ----------------------------------------------------------------

SIZE, OVERLAP = 500, 50


def _split_level(level: int, separator: str) -> str:
    """Segments of one level cut at its separator: short pieces are packed, the rest goes one level down."""
    this, down, sep = f"segments{level}", f"segments{level + 1}", separator.replace("\n", f"' || {NL} || '")
    return f"""
  parts{level} AS (SELECT doc_id, st, string_split(tx, '{sep}') AS parts FROM {this} WHERE contains(tx, '{sep}')),
  split{level} AS (SELECT doc_id, st, i, CASE WHEN i = 1 THEN part ELSE '{sep}' || part END AS piece
    FROM (SELECT doc_id, st, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM parts{level})),
  pieces{level} AS (SELECT doc_id, st, piece, length(piece) >= {SIZE} AS long,
      st + coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
      count(*) FILTER (length(piece) >= {SIZE}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS longs
    FROM split{level} WHERE piece <> '' WINDOW w AS (PARTITION BY doc_id, st ORDER BY i)),
  {down} AS (SELECT doc_id, a AS st, piece AS tx FROM pieces{level} WHERE long
    UNION ALL SELECT doc_id, st, tx FROM {this} WHERE NOT contains(tx, '{sep}')),"""


_LEVELS = ["\n\n", "\n", ". ", " "]
_SHORT = " UNION ALL ".join(
    f"SELECT doc_id, {i}::BIGINT AS level, st, longs, a, a + length(piece) AS b FROM pieces{i} WHERE NOT long" for i in range(len(_LEVELS))
)
# A chunk starts at a piece and ends before the first piece that does not fit.
# The next one starts at the first piece within the overlap that leaves room
# for that piece, so a chunk follows from its first piece alone.
CHUNKS = f"""WITH RECURSIVE segments0 AS (SELECT doc_id, 0::BIGINT AS st, text AS tx FROM documents),
  {"".join(_split_level(i, s) for i, s in enumerate(_LEVELS))}
  short AS ({_SHORT} UNION ALL SELECT doc_id, {len(_LEVELS)}, st, 0, st + i, st + i + 1
    FROM (SELECT doc_id, st, unnest(range(length(tx))) AS i FROM segments{len(_LEVELS)})),
  numbered AS (SELECT doc_id, level, st, longs, a, b, row_number() OVER w AS n, max(b) OVER (PARTITION BY doc_id, level, st, longs) AS last,
      greatest(a - {OVERLAP}, b - {SIZE}) AS earliest FROM short WINDOW w AS (PARTITION BY doc_id, level, st, longs ORDER BY a)),
  restart AS (SELECT p.*, q.n AS again FROM numbered p ASOF JOIN numbered q
    ON p.doc_id = q.doc_id AND p.level = q.level AND p.st = q.st AND p.longs = q.longs AND p.earliest <= q.a),
  spans AS (SELECT p.doc_id, p.level, p.st, p.longs, p.n, p.a, coalesce(q.a, p.last) AS b, q.again FROM numbered p ASOF LEFT JOIN restart q
    ON p.doc_id = q.doc_id AND p.level = q.level AND p.st = q.st AND p.longs = q.longs AND p.a + {SIZE} < q.b),
  walk AS (SELECT * FROM spans WHERE n = 1
    UNION ALL SELECT spans.* FROM walk JOIN spans ON walk.doc_id = spans.doc_id AND walk.level = spans.level AND walk.st = spans.st
      AND walk.longs = spans.longs AND walk.again = spans.n),
  chunks AS (SELECT doc_id, a, {_strip('substring(text, a + 1, b - a)')} AS chunk FROM walk JOIN documents USING (doc_id)),
  kept AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_idx, chunk FROM chunks WHERE chunk <> '')"""

# --- retrieval -------------------------------------------------------------

VOWELS = "aeiouyhn"
EMBED_DOCUMENTS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS position, length(text) - length(replace(text, '{letter}', '')) AS value FROM documents"
    for i, letter in enumerate(VOWELS)
)


EMBED_CHUNKS = f"{CHUNKS} " + " UNION ALL ".join(
    f"""SELECT doc_id, chunk_idx, {i} AS position, CAST(length(chunk) - length(replace(chunk, '{letter}', '')) AS FLOAT) AS value FROM kept"""
    for i, letter in enumerate(VOWELS)
)


def _dot(left: str, right: str) -> str:
    return f"list_sum(list_transform(range(1, len({left}) + 1), lambda i: {left}[i]::DOUBLE * {right}[i]::DOUBLE))"


NEAREST = f"""asked AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 10 = 0),
  scored AS (SELECT query_id, vec_id, {_dot('q', 'embedding')} / (sqrt({_dot('q', 'q')}) * sqrt({_dot('embedding', 'embedding')})) AS score
             FROM asked CROSS JOIN embeddings),
  nearest AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM scored) WHERE rank <= 5),
  retrieved AS (SELECT query_id, rank, text AS content, score,
                CASE WHEN doc_id % 3 <> 0 THEN source ELSE 'unknown' END AS source
                FROM nearest LEFT JOIN documents ON vec_id = doc_id),
  blocks AS (SELECT query_id, string_agg('[Document ' || rank || ']' || {NL} || {_strip("coalesce(content, '')")},
             {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS block FROM retrieved GROUP BY query_id)"""
RUN_CONTEXT = f"""WITH {NEAREST}, contexts AS (
    SELECT query_id // 10 // 3 AS run_id, string_agg(block, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY query_id // 10 % 3) AS context
    FROM blocks WHERE query_id // 10 % 4 <> 0 AND block <> '' GROUP BY ALL)
  SELECT item_id AS run_id, coalesce(context, {_text(NO_DOCUMENTS)}) AS context
  FROM benchmark LEFT JOIN contexts ON item_id = run_id"""

# --- responses -------------------------------------------------------------

FENCED = f"""fenced AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ```json' || {NL} || text || {NL} || '```' || {NL}
    WHEN 1 THEN '```' || text || '```' WHEN 2 THEN '```markdown' || {NL} || text || {NL} || ' ' || {NL} || '```'
    WHEN 3 THEN ' ' || {NL} || text || ' ' || {NL} ELSE text END AS raw FROM documents)"""


def _unfenced(value: str) -> str:
    trimmed = _strip(value)
    body = f"regexp_replace(string_split({trimmed}, '```')[2], '^json', '')"
    return f"CASE WHEN starts_with({trimmed}, '```') THEN {_strip(body)} ELSE {trimmed} END"


_LINES = f"string_split({_strip('raw')}, {NL})"
STRIP_REPORT = f"""WITH {FENCED} SELECT doc_id, CASE WHEN starts_with({_strip('raw')}, '```')
    THEN {_strip(f"array_to_string(list_slice({_LINES}, 2, len({_LINES}) - 1), {NL})")} ELSE {_strip('raw')} END AS body FROM fenced"""

_SCORES = " ".join(f"""WHEN {i} THEN '"confidence_score": {v}, '""" for i, v in enumerate(CONFIDENCES) if v is not None)
RESPONSES = f"""quoted AS (SELECT doc_id, text, to_json(text)::VARCHAR AS t, to_json(lang)::VARCHAR AS l FROM documents),
  bodies AS (SELECT doc_id, text, t, '{{' || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '"executive_summary": null, '
      ELSE '"executive_summary": ' || t || ', ' END
    || CASE doc_id % {len(CONFIDENCES)} {_SCORES} ELSE '' END
    || CASE doc_id % 3 WHEN 0 THEN '' ELSE '"opportunities": [' || l || ', ' || t || '], ' END
    || '"recommendations": [{{"rank": ' || doc_id || ', "action": ' || l || ', "rationale": ' || t
    || ', "priority": "high", "timeframe": "long_term"}}, {{"action": ' || l || ', "rationale": null}}, {{"rank": "3", "priority": "low"}}]}}'
    AS body FROM quoted),
  answers AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'no json: ' || text WHEN doc_id % 10 = 8 THEN '[' || t || ']'
    WHEN doc_id % 2 = 0 THEN '```json' || {NL} || body || {NL} || '```' ELSE body END AS raw FROM bodies),
  stripped AS (SELECT doc_id, {_unfenced('raw')} AS body FROM answers),
  checked AS (SELECT doc_id, body, CASE WHEN NOT json_valid(body) THEN 'Invalid JSON'
    WHEN json_type(body::JSON) <> 'OBJECT' THEN 'Expected a JSON object, found ' || lower(json_type(body::JSON)) END AS error FROM stripped),
  valid AS (SELECT doc_id, body::JSON AS j FROM checked WHERE error IS NULL),
  recs AS (SELECT doc_id, unnest(from_json(json_extract(j, '$.recommendations'), '["JSON"]')) AS r,
           generate_subscripts(from_json(json_extract(j, '$.recommendations'), '["JSON"]'), 1) AS position FROM valid),
  filled AS (SELECT doc_id, CAST(position AS INTEGER) AS position,
    CASE WHEN json_exists(r, '$.rank') THEN TRY_CAST(json_extract_string(r, '$.rank') AS INTEGER) ELSE CAST(position AS INTEGER) END AS rank,
    {_present('r', 'action', "''")} AS action, {_present('r', 'rationale', "''")} AS rationale,
    {_present('r', 'priority', "'medium'")} AS priority, {_present('r', 'timeframe', "'short_term'")} AS timeframe FROM recs)"""
CONFIDENCE = f"""WITH {RESPONSES}, scores AS (SELECT doc_id, json_extract(j, '$.confidence_score') AS v,
    json_extract_string(j, '$.confidence_score') AS s, json_exists(j, '$.confidence_score') AS there FROM valid)
  SELECT doc_id, CAST(CASE WHEN NOT there THEN 50
    WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN greatest(0, least(100, trunc(s::DOUBLE)))
    WHEN json_type(v) = 'BOOLEAN' THEN CASE WHEN s = 'true' THEN 1 ELSE 0 END
    WHEN json_type(v) = 'VARCHAR' AND regexp_full_match(s, '[+-]?\\d+') THEN greatest(0, least(100, s::DOUBLE))
    ELSE 0 END AS INTEGER) AS confidence_score FROM scores"""
RECOMMENDATION_BLOCK = f"""WITH {RESPONSES} SELECT doc_id, string_agg(coalesce(rank::VARCHAR, '?') || '. **' || coalesce(action, '') || '** ['
    || upper(coalesce(priority, '')) || ' / ' || replace(coalesce(timeframe, ''), '_', ' ') || ']' || {NL} || '   ' || coalesce(rationale, ''),
    {NL} ORDER BY position) AS block FROM filled GROUP BY doc_id"""

_GENERIC = "[" + ", ".join(_text(q) for q in GENERIC) + "]"
SUGGESTED = f"""suggested AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS table_name,
    list_slice(list_concat(list_filter([{', '.join(f'CASE WHEN {check} THEN {_text(question)} END' for check, question in RULES)}], lambda x: x IS NOT NULL), {_GENERIC}), 1, 5) AS questions
    FROM events GROUP BY ALL)"""
VALID_QUESTIONS = f"""WITH {SUGGESTED}, quoted AS (SELECT conv_id, turn, text, to_json(text)::VARCHAR AS t FROM conversations),
  answers AS (SELECT conv_id, turn, CASE turn % 4
      WHEN 0 THEN '[' || t || ', "", null, 0, false, [], {{}}, 7, "b", true, 2.5, ' || t || ', "late"]'
      WHEN 1 THEN '```json' || {NL} || '[' || t || ']' || {NL} || '```' WHEN 2 THEN '{{"questions": ' || t || '}}' ELSE text END AS raw FROM quoted),
  stripped AS (SELECT conv_id, turn, {_unfenced('raw')} AS body FROM answers),
  parsed AS (SELECT conv_id, turn, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body::JSON) = 'ARRAY'
    THEN list_slice(list_transform(list_filter(from_json(body::JSON, '["JSON"]'),
      lambda x: coalesce(x::VARCHAR NOT IN ('""', 'null', '0', 'false', '[]', '{{}}'), false)),
      lambda y: CASE WHEN json_type(y) = 'BOOLEAN' THEN upper((y::VARCHAR)[1:1]) || (y::VARCHAR)[2:] ELSE json_extract_string(y, '$') END), 1, 5)
    END END AS questions FROM stripped),
  filled AS (SELECT conv_id, turn, coalesce(parsed.questions, suggested.questions, {_GENERIC}) AS questions
    FROM parsed LEFT JOIN suggested ON table_name = conv_id || '/' || strftime(DATE '2024-01-01' + (conv_id % 30)::INT, '%Y-%m-%d'))
  SELECT conv_id, turn, CAST(generate_subscripts(questions, 1) - 1 AS INTEGER) AS question_idx, unnest(questions) AS question FROM filled"""

# --- reports ---------------------------------------------------------------


def _marks(value: str) -> str:
    bold = rf"regexp_replace({value}, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g')"
    italic = rf"regexp_replace({bold}, '\*(.+?)\*', '<em>\1</em>', 'g')"
    return rf"regexp_replace({italic}, '`(.+?)`', '<code>\1</code>', 'g')"


_BREAKS = ["- ", "12. ", None, "### ", "* ", ""]
_BODY = " ".join(
    f"WHEN {i} THEN replace(text, {NL}, {NL} || {NL if b is None else _text(b)})" for i, b in enumerate(_BREAKS)
)
_NUMBERED = r"^\d+\.[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+"
MARKDOWN = f"""WITH reports AS (SELECT doc_id, '# ' || source || {NL} || {NL} || '## Notes' || {NL} || '- **' || lang || '** *is* `code`' || {NL}
    || '* **a** and **b**' || {NL} || '  1. step' || {NL} || '---' || {NL} || '- last' || {NL} || CASE doc_id % 6 {_BODY} END AS md FROM documents),
  raw_lines AS (SELECT doc_id, unnest(string_split(md, {NL})) AS l, generate_subscripts(string_split(md, {NL}), 1) AS i FROM reports),
  lines AS (SELECT doc_id, i, {_strip('l')} AS s FROM raw_lines),
  marked AS (SELECT *, starts_with(s, '- ') OR starts_with(s, '* ') AS item FROM lines),
  edged AS (SELECT *, coalesce(lag(item) OVER w, false) AS before, lead(item) OVER w IS NULL AS final FROM marked
            WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  html AS (SELECT doc_id, i,
    CASE WHEN item AND NOT before THEN '<ul>' || {NL} WHEN NOT item AND before THEN '</ul>' || {NL} ELSE '' END
    || CASE WHEN starts_with(s, '### ') THEN '<h3>' || {_marks('substring(s, 5)')} || '</h3>'
      WHEN starts_with(s, '## ') THEN '<h2>' || {_marks('substring(s, 4)')} || '</h2>'
      WHEN starts_with(s, '# ') THEN '<h1>' || {_marks('substring(s, 3)')} || '</h1>'
      WHEN item THEN '<li>' || {_marks('substring(s, 3)')} || '</li>'
      WHEN regexp_matches(s, '{_NUMBERED}') THEN '<p class=''numbered''>' || {_marks(f"regexp_replace(s, '{_NUMBERED}', '')")} || '</p>'
      WHEN s = '---' THEN '<hr>' WHEN s = '' THEN '' ELSE '<p>' || {_marks('s')} || '</p>' END
    || CASE WHEN final AND item THEN {NL} || '</ul>' ELSE '' END AS h FROM edged)
  SELECT doc_id, string_agg(h, {NL} ORDER BY i) AS html FROM html GROUP BY doc_id"""

STEP_STATUS = f"""WITH steps AS (SELECT user_id AS run_id, event_type AS node, arg_max(props, event_id) AS status,
    max(ts) FILTER (event_id % 2 = 0) AS started, max(ts) FILTER (event_id % 2 = 1) AS completed FROM events GROUP BY ALL)
  SELECT run_id, node, status, CASE WHEN completed >= started
    THEN {_python("date_diff('microsecond', started, completed) / 1000000.0::DOUBLE", 1)} END AS elapsed FROM steps"""

_DAY = "strftime(o_orderdate, '%Y-%m-%d 00:00:00')"

SQL_CHECKS: dict[str, str] = {
    "csv_roundtrip": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderstatus = 'F' AS is_done,
        strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'say "' || o_orderpriority || '",' || chr(10) || 'twice' AS remark FROM orders""",
    "csv_with_schema": "SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders",
    "csv_mixed_headers": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "stream_csv_clean": """SELECT o_orderkey AS order_key, o_orderstatus AS order_status, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS total_price,
        'say "' || o_orderpriority || '",' || chr(10) || 'twice' AS remark,
        CASE WHEN o_orderkey % 9 = 0 THEN 'Total Price' ELSE '' END AS rejects FROM orders""",
    "csv_split_quotes": """SELECT doc_id, text, '5" ' || lang || ',"' || chr(10) || '"' AS size, source FROM documents""",
    "stream_dedup": "SELECT DISTINCT o_orderstatus, o_orderpriority, o_orderdate::DATE AS o_orderdate FROM orders",
    "text_docs": f"SELECT lang, line, count(*) AS n FROM (SELECT lang, unnest(string_split(text, {NL})) AS line FROM documents) GROUP BY ALL",
    "text_parts": f"""SELECT lang, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars,
        CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), {NL}, '')) + 1) AS BIGINT) AS n_breaks FROM documents GROUP BY lang""",
    "result_payloads": f"""SELECT conv_id || '-' || turn AS run_id, replace(text, {NL}, '|') AS data_findings,
        CASE WHEN role = 'user' THEN text ELSE '' END AS data_summary, (turn * 7 % 101)::VARCHAR AS data_health_score,
        CASE WHEN role <> 'user' THEN replace(text, {NL}, '|') ELSE '' END AS market_findings,
        CASE WHEN role <> 'user' THEN text ELSE '' END AS market_summary,
        array_to_string(list_slice(string_split(text, {NL}), 1, 2), '|') AS recommendations,
        CASE WHEN role = 'user' THEN string_split(text, {NL})[1] ELSE '' END AS opportunities, role AS executive_summary,
        turn::VARCHAR AS confidence_score, '# ' || text AS report_markdown, '[]' AS errors FROM conversations""",
    "stream_revenue_by_dim": _revenue_by("region"),
    "clean_names": f"""SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderstatus AS order_status, o_totalprice AS total_price,
        {_stamp('o_orderdate')} AS placed_on, o_orderpriority AS o_orderpriority FROM orders""",
    "dedup_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem",
    "trim_strings": f"""SELECT conv_id, turn, role, {_strip(f"'{PADDING_BEFORE}' || text || '{PADDING_AFTER}'")} AS text FROM conversations""",
    "parse_dates": f"""SELECT o_orderkey, {_DAY} AS iso_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:00') AS date_and_time,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS update_stamp, CASE WHEN o_orderstatus <> 'P' THEN {_DAY} END AS date_with_gaps,
        CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed_date FROM orders""",
    "dupes_dropped": """SELECT count(*) AS row_count, count(DISTINCT (l_returnflag, l_linestatus, l_discount, l_tax)) AS distinct_count,
        count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_discount, l_tax)) AS dupes_dropped FROM lineitem""",
    "clean_orders": f"""SELECT DISTINCT o_orderkey AS order_key, o_orderstatus AS order_status, {_DAY} AS order_date,
        o_totalprice AS total_price FROM orders""",
    "profile_shape": "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem",
    "profile_columns": PROFILE_COLUMNS,
    "profile_numeric": PROFILE_NUMERIC,
    "profile_top_values": TOP_VALUES,
    "profile_date_range": DATE_RANGE,
    "health_score": HEALTH,
    "profile_table": PROFILE_TABLE,
    "profile_incremental": PROFILE_INCREMENTAL,
    "top_values_incremental": TOP_VALUES,
    "revenue_by_dimension_type": _revenue_by("build_category"),
    "revenue_by_dimension_region": _revenue_by("region"),
    "revenue_trend_year": _revenue_by("year"),
    "revenue_trend_quarter": _revenue_by("quarter"),
    "revenue_trend_month": _revenue_by("month"),
    "top_performers": _revenue_by("vehicle_platform", f"ORDER BY {REVENUE} DESC, vehicle_platform LIMIT 5"),
    "growth_rates": GROWTH,
    "chart_year": f"WITH {SALES} SELECT year::VARCHAR AS year, {REVENUE} AS revenue FROM sales WHERE year IS NOT NULL GROUP BY year",
    "chart_category": f"""WITH {SALES} SELECT build_category AS category, {REVENUE} AS revenue,
        contains(lower(build_category), 'promo') AS highlighted FROM sales WHERE build_category IS NOT NULL GROUP BY build_category""",
    "segment_vs_rest": f"""WITH {SALES} SELECT {SERIES} AS series, year::VARCHAR AS year, {REVENUE} AS revenue FROM sales
        WHERE year IS NOT NULL GROUP BY ALL""",
    "region_share": f"""WITH {SALES}, sums AS (SELECT region, {REVENUE} AS revenue FROM sales WHERE region IS NOT NULL GROUP BY region)
        SELECT region, revenue, {_python(f"revenue / (SELECT {REVENUE} FROM sales WHERE region IS NOT NULL) * 100.0", 1)} AS share_pct FROM sums""",
    "currency_labels": f"""SELECT o_orderkey, {_label('o_totalprice')} AS price_label, {_label('(o_totalprice * 10.0::DOUBLE)')} AS ten_times_label
        FROM orders""",
    "chart_data": f"""WITH {SALES}
        SELECT 'revenue_by_year' AS chart, 'revenue' AS series, year::VARCHAR AS x, {REVENUE} AS y FROM sales WHERE year IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'revenue_by_build_category', 'revenue', build_category, {REVENUE} FROM sales WHERE build_category IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'baja_growth_trend', {SERIES}, year::VARCHAR, {REVENUE} FROM sales WHERE year IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'revenue_by_region', 'revenue', region, {REVENUE} FROM sales WHERE region IS NOT NULL GROUP BY ALL""",
    "findings": FINDINGS,
    "keywords": f"SELECT doc_id, {_keywords('text', 'w')} AS keywords FROM documents",
    "search_queries": SEARCH_QUERIES,
    "normalize_results": NORMALIZE,
    "dedupe_results": f"WITH {RESULTS} SELECT * FROM merged",
    "result_block": RESULT_BLOCK,
    "fallback_merge": FALLBACK,
    "failed_runs": FAILED,
    "chunk_documents": f"{CHUNKS} SELECT * FROM kept",
    "corpus_chunks": f"{CHUNKS} SELECT kept.*, source AS source_file FROM kept JOIN documents USING (doc_id) WHERE lang <> 'de'",
    "corpus_errors": "SELECT doc_id, source FROM documents WHERE lang = 'de'",
    "embed_chunks": EMBED_CHUNKS,
    "embed_documents": EMBED_DOCUMENTS,
    "embed_incremental": EMBED_DOCUMENTS,
    "vector_dims": """SELECT count(embedding) AS vectors, count(*) - count(embedding) AS missing, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
        CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings""",
    "cosine_topk": f"WITH {NEAREST} SELECT query_id, rank, vec_id AS chunk_id FROM nearest",
    "cosine_topk_scored": f"WITH {NEAREST} SELECT query_id, rank, content, {_python('score', 4)} AS score, source FROM retrieved",
    "context_block": f"WITH {NEAREST} SELECT query_id, block FROM blocks",
    "run_context": RUN_CONTEXT,
    "prompt_table": f"""SELECT conv_id, turn, 'Question: {{role}} ' || text || {NL} || 'Role: ' || role || {NL} || 'Literal {{braces}}' || {NL}
        || CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS prompt FROM conversations""",
    "bullets": f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'None available.' ELSE '- ' || replace(text, {NL}, {NL} || '- ') END AS bullets
        FROM documents""",
    "strip_fences": f"WITH {FENCED} SELECT doc_id, {_unfenced('raw')} AS body FROM fenced",
    "strip_report_fence": STRIP_REPORT,
    "parse_responses": f"WITH {RESPONSES} SELECT doc_id, error FROM checked",
    "response_fields": f"""WITH {RESPONSES} SELECT doc_id, {_present('j', 'executive_summary', "''")} AS executive_summary,
        CASE WHEN json_exists(j, '$.opportunities') THEN array_to_string(from_json(json_extract(j, '$.opportunities'), '["VARCHAR"]'), '|')
        ELSE '' END AS opportunities, CAST(0 AS BIGINT) AS n_risks FROM valid""",
    "analyst_fields": f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'first|' || text ELSE '' END AS findings,
        CASE WHEN turn % 3 <> 0 THEN text ELSE '' END AS summary, text AS anomalies, '' AS data_quality_notes, '' AS recommended_deep_dives
        FROM conversations""",
    "research_fields": f"""SELECT conv_id, turn, CASE WHEN turn % 4 <> 1 THEN '' END AS market_summary, text || '|' || text AS market_findings,
        text AS supporting_data_alignment, '' AS market_gaps, CASE WHEN turn % 5 = 1 THEN 'q' ELSE '' END AS search_queries_used FROM conversations""",
    "insight_fields": f"""SELECT conv_id, turn, '' AS executive_summary, '' AS opportunities,
        CASE WHEN turn % 2 = 1 THEN text || '|late' ELSE '' END AS risks FROM conversations""",
    "recommendations": f"WITH {RESPONSES} SELECT * FROM filled",
    "recommendation_block": RECOMMENDATION_BLOCK,
    "clamp_confidence": CONFIDENCE,
    "valid_questions": VALID_QUESTIONS,
    "suggest_questions": f"""WITH {SUGGESTED} SELECT table_name, CAST(generate_subscripts(questions, 1) - 1 AS INTEGER) AS question_idx,
        unnest(questions) AS question FROM suggested""",
    "gauges": f"""WITH signals AS (SELECT doc_id, CAST(least(100, 15 * CASE WHEN length(text) > 20
          THEN len(list_filter(string_split(text, {NL}), lambda l: l <> '')) ELSE 0 END) AS INTEGER) AS market_signal FROM documents)
        SELECT doc_id, market_signal, CASE WHEN market_signal >= 75 THEN 'green' WHEN market_signal >= 40 THEN 'brass'
          WHEN market_signal > 0 THEN 'alert' ELSE 'dim' END AS band,
          CASE WHEN market_signal >= 75 THEN 'green' WHEN market_signal >= 40 THEN 'yellow' ELSE 'red' END AS terminal_band FROM signals""",
    "markdown_html": MARKDOWN,
    "fold_run_state": """SELECT user_id AS run_id, event_type AS field, max(event_id) AS seq, arg_max(props, event_id) AS value
        FROM events WHERE event_type <> 'error' GROUP BY ALL""",
    "fold_run_errors": "SELECT user_id AS run_id, event_id AS seq, props AS error FROM events WHERE event_type = 'error'",
    "step_status": STEP_STATUS,
    "stream_step_status": """SELECT user_id AS run_id, event_type AS node, max(event_id) AS seq, arg_max(props, event_id) AS status
        FROM events GROUP BY ALL""",
    "stream_run_end": """SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS run_id, 'ended' AS outcome,
        arg_max(props, event_id) AS status, count(*) AS events FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""",
}
