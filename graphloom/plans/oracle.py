"""The registered queries in DuckDB SQL, from the fixture tables alone.

Links, headings and symbols follow from how the workspace is derived, or are found again by regular
expressions; nothing of what Spark computed is read.
"""

from __future__ import annotations

from graphloom.operators.lookup import DUPLICATE_TERM, MESSAGES, STALE_HEADING
from graphloom.plans import derived
from graphloom.plans.derived import NL, PARTS, s

_quote = lambda x: "'" + x.replace("'", "''") + "'"
_text = lambda x: (" || " + NL + " || ").join(_quote(p) for p in x.split("\n"))
_WORDS = derived.WORDS.format("unnest(regexp_extract_all(text, '\\b[a-z]{5,}\\b'))")
_GLOSSARY = " UNION ALL ".join([*(f"SELECT {_quote(p)} AS path, {_text(t)} AS content" for p, t in derived.GLOSSARY), derived.ITEMS, derived.AGAIN, _WORDS])



def _symbols(table: str, path: str, key: str | None, rows: list[tuple], first: int = 0, where: str = "") -> str:
    """Selects of the symbols that each source of a table holds."""
    length = f"length({s(key)})" if key else "0"
    column = lambda c: f"{c[0]} + {c[1]} * {length}" if isinstance(c, tuple) else str(c)
    out = []
    for k, (name, kind, line, col, last, end, name_line, name_col) in enumerate(rows, first):
        qualified = "'" + name.replace("@", f"' || {s(key)} || '") + "'" if key else f"'{name}'"
        places = [line, column(col), last, column(end), name_line, column(name_col), name_line, f"{column(name_col)} + length(regexp_extract({qualified}, '[^:]*$'))"]
        names = ("start_line", "start_char", "end_line", "end_char", "name_line", "name_char", "name_end_line", "name_end_char")
        out.append(f"SELECT {path} AS file, {k} AS ordinal, {qualified} AS qualified, '{kind}' AS kind, " + ", ".join(f"cast({x} as int) AS {n}" for x, n in zip(places, names, strict=True)) + f" FROM {table} {where}")
    return " UNION ALL ".join(out)


_RUST = _symbols("part", derived.RUST_PATH, None, derived.RUST_SYMBOLS) + " UNION ALL " + _symbols("part", derived.RUST_PATH, None, [derived.RUST_AGAIN], len(derived.RUST_SYMBOLS), "WHERE p_partkey % 10 = 0")
_C = _symbols("supplier", derived.C_PATH, "s_suppkey", derived.C_SYMBOLS)

BASE = f"""
glossary AS ({_GLOSSARY}),
md AS ({PARTS['notes']} UNION ALL {PARTS['short_notes']} UNION ALL SELECT path, content FROM glossary),
source_files AS ({PARTS['rust']} UNION ALL {PARTS['c']}),
files AS (SELECT path, content FROM md UNION ALL SELECT path, content FROM source_files),
docs AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS stem FROM md),
stems AS (SELECT stem, CASE WHEN count(*) = 1 THEN min(path) END AS path, count(*) AS n_docs FROM docs GROUP BY stem),
body AS (SELECT path, regexp_replace(content, '^---\\n(?:[^\\n]*\\n)*?---\\n', '') AS b FROM md),
clean AS (SELECT path, regexp_replace(b, '(?s)```\\n.*?\\n```\\n', '', 'g') AS b FROM body),
links AS (
  SELECT path AS from_path, unnest(r) AS raw, unnest(range(len(r))) AS ordinal
  FROM (SELECT path, regexp_extract_all(b, '\\[\\[(.*?)\\]\\]', 1) AS r FROM clean) WHERE len(r) > 0
),
refs AS (
  SELECT from_path, ordinal, raw,
         CASE WHEN contains(raw, '@') THEN 'code' ELSE 'doc' END AS ref_kind,
         CASE WHEN NOT contains(raw, '@') THEN CASE WHEN contains(split_part(raw, '#', 1), '/') OR split_part(raw, '#', 1) LIKE '%.md' THEN 'path' ELSE 'name' END END AS target_kind,
         CASE WHEN NOT contains(raw, '@') THEN split_part(raw, '#', 1) END AS target,
         CASE WHEN NOT contains(raw, '@') AND contains(raw, '#') THEN split_part(raw, '#', 2) END AS heading,
         CASE WHEN contains(raw, '@') THEN split_part(raw, '@', 1) END AS file,
         CASE WHEN contains(raw, '@') THEN split_part(raw, '@', 2) END AS qualified
  FROM links
),
sections AS (
  SELECT path, unnest(h) AS heading, unnest(range(len(h))) AS ordinal
  FROM (SELECT path, regexp_extract_all(b, '(?:^|\\n)#{{1,6}} ([^\\n]+)', 1) AS h FROM clean) WHERE len(h) > 0
),
rust_symbols AS ({_RUST}),
c_symbols AS ({_C}),
symbols AS (
  SELECT row_number() OVER (ORDER BY rank, file, ordinal) - 1 AS symbol_id, *, name_line AS line, name_char AS col FROM
  (SELECT 0 AS rank, * FROM rust_symbols UNION ALL SELECT 1 AS rank, * FROM c_symbols)
),
symbol_index AS (SELECT file, qualified, count(*) AS n, min(symbol_id) AS one FROM symbols GROUP BY file, qualified),
resolved AS (
  SELECT r.*, d.doc_path, d.n_docs, i.n AS n_symbols, CASE WHEN i.n = 1 THEN i.one END AS symbol_id,
    CASE WHEN r.ref_kind = 'code' THEN CASE WHEN i.n IS NULL THEN 'CodeDangling' WHEN i.n = 1 THEN 'CodeResolved' ELSE 'CodeAmbiguous' END
         WHEN d.n_docs IS NULL THEN 'DocDangling' WHEN d.doc_path IS NULL THEN 'DocAmbiguous'
         WHEN r.heading IS NOT NULL AND h.heading IS NULL THEN 'DocHeadingDangling' ELSE 'DocResolved' END AS status
  FROM refs r
  LEFT JOIN (SELECT 'path' AS k, path AS t, path AS doc_path, 1 AS n_docs FROM docs UNION ALL SELECT 'name', stem, path, n_docs FROM stems) d ON d.k = r.target_kind AND d.t = r.target
  LEFT JOIN (SELECT DISTINCT path, heading FROM sections) h ON h.path = d.doc_path AND h.heading = r.heading
  LEFT JOIN symbol_index i ON i.file = r.file AND i.qualified = r.qualified
),
terms AS (
  SELECT regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS name, path,
         regexp_extract(regexp_replace(content, '^---\\n(?:[^\\n]*\\n)*?---\\n', ''), '^\\n*#*\\s*([^\\n]+)', 1) AS definition
  FROM glossary
),
said AS (
  SELECT path, unnest(regexp_extract_all(regexp_replace(b, '\\[\\[[^\\]]*\\]\\]', '[]', 'g'), '\\b(the of|[A-Za-z0-9_]+)\\b', 1)) AS name FROM body
),
mentions AS (
  SELECT said.path, said.name FROM said JOIN (SELECT name, min(path) AS own FROM terms GROUP BY name) t ON t.name = said.name WHERE said.path <> t.own
),
nodes AS (
  SELECT 'symbol:' || symbol_id AS id, 'symbol' AS kind, file || '@' || qualified AS label FROM symbols
  UNION ALL SELECT 'doc:' || path, 'doc', path FROM docs
  UNION ALL SELECT DISTINCT 'section:' || path || '#' || heading, 'section', heading FROM sections
  UNION ALL SELECT DISTINCT 'term:' || name, 'term', name FROM mentions
),
edges AS (
  SELECT 'contains' AS kind, 'doc:' || path AS "from", 'section:' || path || '#' || heading AS "to" FROM sections
  UNION ALL SELECT 'links', 'doc:' || from_path, 'doc:' || doc_path FROM resolved WHERE doc_path IS NOT NULL
  UNION ALL SELECT 'references', 'doc:' || from_path, 'symbol:' || symbol_id FROM resolved WHERE status = 'CodeResolved'
  UNION ALL SELECT DISTINCT 'mentions', 'doc:' || path, 'term:' || name FROM mentions
)
"""

_DOC_MESSAGE = " ".join(f"WHEN status = '{k}' THEN " + (f"'{v.split('%d')[0]}' || n_symbols || '{v.split('%d')[1]}'" if "%d" in v else f"'{v}'") for k, v in MESSAGES.items())
_TWICE = DUPLICATE_TERM.split("%s")
_CLASS = "CASE WHEN kind IN ('function', 'method') THEN 'FUNCTION' WHEN kind IN ('struct', 'enum', 'trait', 'type') THEN 'CLASS' WHEN kind IN ('const', 'static') THEN 'CONSTANT' WHEN kind = 'field' THEN 'FIELD' WHEN kind = 'macro' THEN 'KEYWORD' WHEN kind = 'variant' THEN 'ENUM_MEMBER' WHEN kind = 'module' THEN 'MODULE' ELSE 'VARIABLE' END"
_WORD = "CASE WHEN kind IN ('function', 'method') THEN 'fn' WHEN kind = 'macro' THEN 'macro!' WHEN kind = 'variable' THEN 'var' WHEN kind = 'module' THEN 'mod' ELSE kind END"
_DOC_HOVER = f"SELECT d.path, CASE WHEN x.h IS NULL THEN '**' || d.path || '**' ELSE '**' || d.path || '**' || {NL} || {NL} || x.h END AS hover FROM docs d LEFT JOIN (SELECT path, string_agg('- ' || heading, {NL} ORDER BY ordinal) AS h FROM (SELECT path, heading, min(ordinal) AS ordinal FROM sections GROUP BY path, heading) GROUP BY path) x ON x.path = d.path"
_CODE_HOVER = f"SELECT symbol_id, '**' || {_WORD} || '** `' || qualified || '`' || {NL} || {NL} || '`' || file || '`' AS hover FROM symbols"
#: Links with their places, as the notes are made, and the links that are asked for, by number.
_PLACED = f"SELECT r.*, p.line, p.start_char, p.end_char, p.start_utf16, p.end_utf16 FROM resolved r JOIN ({derived.LINK_PLACES}) p ON p.path = r.from_path AND p.ordinal = r.ordinal"
_ASKED = f"SELECT x.*, x.start_utf16 + 3 AS at_character FROM ({_PLACED}) x"
_FULL = "file, ordinal, replace(qualified, '::', '/') AS sym_path, qualified, kind, NULL::VARCHAR AS disambiguator, start_line, start_char, end_line, end_char, start_char AS start_utf16, end_char AS end_utf16, name_line, name_char, name_end_line, name_end_char, name_char AS name_utf16, name_end_char AS name_end_utf16"

BODIES = {
    "scan_files_by_ext": "SELECT regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext, count(*) AS n_files, sum(length(content))::BIGINT AS n_chars FROM files GROUP BY ext",
    "glossary_notes": "SELECT name, path, definition FROM terms",
    "parse_references": "SELECT from_path, ordinal::INT AS ordinal, ref_kind, target_kind, target, heading, file, qualified FROM refs",
    "extract_links": "SELECT from_path, ordinal::INT AS ordinal, raw FROM links",
    "extract_headings": "SELECT path, ordinal::INT AS ordinal, heading FROM sections",
    "resolve_links": "SELECT from_path, ordinal::INT AS ordinal, raw, status, doc_path, symbol_id FROM resolved",
    "resolution_summary": "SELECT status, count(*) AS n_links FROM resolved GROUP BY status",
    "doc_target_edges": "SELECT from_path, doc_path AS to_path, count(*) AS n_links FROM resolved WHERE doc_path IS NOT NULL GROUP BY ALL",
    "stem_index": "SELECT stem, path, n_docs FROM stems",
    "duplicate_terms": "SELECT name, count(*) AS n_notes FROM terms GROUP BY name HAVING count(*) > 1",
    "symbol_table": "SELECT symbol_id, file, qualified, kind, line::INT AS name_line, col::INT AS name_char FROM symbols",
    "resolve_code_refs": "SELECT from_path, file, qualified, status, coalesce(n_symbols, 0)::BIGINT AS n_candidates, symbol_id FROM resolved WHERE ref_kind = 'code'",
    "code_ref_counters": "SELECT count(*) FILTER (WHERE status = 'CodeResolved') AS code_refs_resolved, count(*) FILTER (WHERE ref_kind = 'code' AND status <> 'CodeResolved') AS code_refs_unresolved FROM resolved",
    "graph_nodes": "SELECT id, kind, label FROM nodes",
    "graph_edges": 'SELECT kind, "from" AS from_id, "to" AS to_id FROM edges',
    "graph_without_sections": "SELECT 'node' AS what, kind, count(*) AS n FROM nodes WHERE kind <> 'section' GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges WHERE kind <> 'contains' GROUP BY kind",
    "graph_stats": "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, count(*) FILTER (WHERE status = 'CodeResolved') AS code_refs_resolved, count(*) FILTER (WHERE ref_kind = 'code' AND status <> 'CodeResolved') AS code_refs_unresolved FROM resolved",
    "term_mentions": "SELECT path, name, count(*) AS n_mentions FROM mentions GROUP BY path, name",
    "mention_edges": "SELECT DISTINCT path, name FROM mentions",
    "diagnostics": f"SELECT from_path AS path, ordinal::INT AS ordinal, status, CASE {_DOC_MESSAGE} END AS message FROM resolved WHERE status NOT IN ('DocResolved', 'CodeResolved')",
    "glossary_diagnostics": f"SELECT t.path, t.name, length(split_part(g.content, {NL}, 1))::INT AS end_utf16, '{_TWICE[0]}' || t.name || '{_TWICE[1]}' AS message FROM terms t JOIN glossary g USING (path) WHERE t.name IN (SELECT name FROM terms GROUP BY name HAVING count(*) > 1)",
    "code_lens_counts": "SELECT s.file, s.qualified, s.line::INT AS line, s.col::INT AS \"character\", count(*) AS n_refs FROM resolved r JOIN symbols s ON r.symbol_id = s.symbol_id WHERE r.status = 'CodeResolved' GROUP BY s.symbol_id, s.file, s.qualified, s.line, s.col",
    "code_lens_of_a_file": "SELECT s.file, s.qualified, s.line::INT AS line, s.col::INT AS \"character\", count(*) AS n_refs FROM resolved r JOIN symbols s ON r.symbol_id = s.symbol_id WHERE r.status = 'CodeResolved' AND s.file = 'src/p7.rs' GROUP BY s.symbol_id, s.file, s.qualified, s.line, s.col",
    "uris_of_paths": f"SELECT path, '{derived.ROOT_URI}/' || replace(path, ' ', '%20') AS uri, path AS back FROM files",
    "index_sizes": " UNION ALL ".join(f"SELECT '{what}' AS what, count(*) AS n FROM {table}" for what, table in (("docs", "docs"), ("sections", "sections"), ("symbols", "symbols"), ("references", "refs"), ("terms", "terms"), ("mentions", "mentions"))),
    "node_targets": "SELECT 'doc:' || path AS id, path AS file, 0 AS line, 0 AS \"character\" FROM docs UNION ALL SELECT DISTINCT 'section:' || path || '#' || heading, path, 0, 0 FROM sections UNION ALL SELECT 'symbol:' || symbol_id, file, line::INT, col::INT FROM symbols",
    "symbol_info": "SELECT symbol_id, file, line::INT AS line, col::INT AS \"character\" FROM symbols",
    "doc_hover_headings": _DOC_HOVER,
    "completion_items": f"SELECT path AS label, 'FILE' AS kind, NULL::VARCHAR AS detail, path || ']]' AS new_text FROM docs UNION ALL SELECT stem, 'FILE', path, stem || ']]' FROM stems WHERE path IS NOT NULL UNION ALL SELECT file || '@' || qualified, {_CLASS}, NULL, file || '@' || qualified || ']]' FROM symbols",
    "document_links": "SELECT path, target, tooltip, count(*) AS n FROM (SELECT r.from_path AS path, coalesce(r.doc_path, s.file) AS target, NULL::VARCHAR AS tooltip FROM resolved r LEFT JOIN symbols s ON s.symbol_id = r.symbol_id UNION ALL SELECT m.path, t.path, m.name FROM mentions m JOIN (SELECT name, min(path) AS path FROM terms GROUP BY name) t ON t.name = m.name) GROUP BY path, target, tooltip",
    "display_filter": "SELECT kind, \"from\" AS from_id, \"to\" AS to_id FROM edges WHERE kind IN ('links', 'references')",
    "code_hover": _CODE_HOVER,
    "rust_symbols_full": f"SELECT {_FULL} FROM rust_symbols",
    "c_symbols_full": f"SELECT {_FULL} FROM c_symbols",
    "positions_utf16": f"SELECT path AS from_path, ordinal, line AS start_line, start_char, start_utf16, line AS end_line, end_char, end_utf16 FROM ({derived.LINK_PLACES})",
    "link_ranges": f"SELECT path, start_line, start_utf16, end_line, end_utf16, target, '{derived.ROOT_URI}/' || target AS target_uri FROM (SELECT x.from_path AS path, x.line AS start_line, x.start_utf16, x.line AS end_line, x.end_utf16, coalesce(x.doc_path, s.file) AS target FROM ({_PLACED}) x LEFT JOIN symbols s ON s.symbol_id = x.symbol_id)",
    "hovers": f"""SELECT x.from_path AS path, x.line, x.at_character AS "character", CASE WHEN x.status = 'DocHeadingDangling' THEN '{STALE_HEADING}' || {NL} || {NL} || d.hover ELSE coalesce(d.hover, c.hover) END AS hover, x.start_utf16, x.end_utf16
      FROM ({_ASKED}) x LEFT JOIN ({_DOC_HOVER}) d ON d.path = x.doc_path LEFT JOIN ({_CODE_HOVER}) c ON c.symbol_id = x.symbol_id WHERE x.status IN ('DocHeadingDangling', 'DocResolved', 'CodeResolved')
      UNION ALL SELECT {derived.NOTE_PATH}, {derived.FIRST_LINE} + 3, 7, '**the**' || {NL} || {NL} || (SELECT min_by(definition, path) FROM terms WHERE name = 'the'), 6, 9 FROM documents""",
    "definitions": f"""SELECT x.from_path AS path, x.line, x.at_character AS "character", coalesce(x.doc_path, s.file) AS file, '{derived.ROOT_URI}/' || coalesce(x.doc_path, s.file) AS uri,
      coalesce(s.name_line, 0) AS to_line, coalesce(s.name_char, 0) AS to_utf16, coalesce(s.name_end_line, 0) AS to_end_line, coalesce(s.name_end_char, 0) AS to_end_utf16
      FROM ({_ASKED}) x LEFT JOIN symbols s ON s.symbol_id = x.symbol_id WHERE coalesce(x.doc_path, s.file) IS NOT NULL""",
    "completions": f"""SELECT path, line, start_utf16 + 3 AS "character", start_utf16 + 2 AS replace_from FROM ({derived.LINK_PLACES})""",
    "open_buffer_diagnostics": f"SELECT {derived.NOTE_PATH} AS path, 1 AS start_line, 0 AS start_utf16, 1 AS end_line, 11 AS end_utf16, 'warning' AS severity, '{MESSAGES['DocDangling']}' AS message FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT {derived.NOTE_PATH}, 1, 12, 1, 16 + length({derived.LINKS[0]}), 'warning', '{MESSAGES['DocDangling']}' FROM documents WHERE doc_id % 10 = 0 AND {derived.LINKS[0]} NOT IN (SELECT path FROM docs)",
    "node_ids": """SELECT 'symbol' AS kind, NULL::VARCHAR AS path, NULL::VARCHAR AS heading, symbol_id, NULL::VARCHAR AS name FROM symbols UNION ALL SELECT 'doc', path, NULL, NULL, NULL FROM docs
      UNION ALL SELECT DISTINCT 'section', path, heading, NULL, NULL FROM sections UNION ALL SELECT DISTINCT 'term', NULL, NULL, NULL, name FROM mentions""",
    "graph_json": """SELECT (row_number() OVER w) - 1 AS ordinal, (sum(length(text)) OVER w - length(text))::BIGINT AS "at", text FROM (
      SELECT g, x, y, z, CASE WHEN g % 2 = 1 AND row_number() OVER (PARTITION BY g ORDER BY x, y, z) > 1 THEN ',' ELSE '' END || j AS text FROM (
        SELECT 0 AS g, '' AS x, '' AS y, '' AS z, '{"nodes":[' AS j UNION ALL SELECT 2, '', '', '', '],"edges":[' UNION ALL SELECT 4, '', '', '', ']}'
        UNION ALL SELECT 1, id, kind, label, '{"id":' || to_json(id) || ',"kind":' || to_json(kind) || ',"label":' || to_json(label) || '}' FROM nodes WHERE kind <> 'section'
        UNION ALL SELECT 3, kind, "from", "to", '{"kind":' || to_json(kind) || ',"from":' || to_json("from") || ',"to":' || to_json("to") || '}' FROM edges WHERE kind <> 'contains'
      )) WINDOW w AS (ORDER BY g, x, y, z, text DESC ROWS UNBOUNDED PRECEDING)""",
}
ORACLES = {name: f"WITH {BASE} {body}" for name, body in BODIES.items()}
ORACLES["refreshed_diagnostics"] = ORACLES["open_buffer_diagnostics"]
ORACLES["folder_changes"] = f"SELECT {derived.NOTE_PATH} AS path, CASE WHEN doc_id % 7 = 0 THEN 'made' WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'edited' END AS change FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND (doc_id % 13 = 0 OR doc_id % 11 = 0))"
ORACLES["debounce_sessions"] = """
SELECT user_id, count(*) FILTER (WHERE last) AS n_bursts, count(*) AS n_events FROM (
  SELECT user_id, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - ts > INTERVAL 1 HOUR, true) AS last FROM events
) GROUP BY user_id
"""
ORACLES["latest_buffers"] = """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1
"""
