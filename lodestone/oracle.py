"""The registered queries restated in DuckDB SQL, from the same fixed values."""

from __future__ import annotations

from .functions.analysis import ARCHITECTURAL_WORDS, FILE_TYPE_WORDS, STOP_WORDS
from .functions.classify import DOCUMENT_TYPES, FILE_TYPES, LANGUAGES
from .operators import context
from .operators.chat import ANSWERED, ASKED, HISTORY_HEAD


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_q(v)}" for c, v in pairs) + f" ELSE {default} END"


def starts(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    last = f"(greatest(ceil(({n} - {size}) / {step}.0), 0)::BIGINT * {step})"
    return f"list_concat(range(0, {last} + 1, {step}), CASE WHEN {n} - {overlap} > {last} THEN [({n} - {overlap})::BIGINT] ELSE [] END)"


def pieces(text: str) -> str:
    cut = f"list_transform({starts(f'length({text})', 2000, 200)}, lambda s: substring({text}, s + 1, 2000))"
    return f"list_filter(CASE WHEN length({text}) <= 2000 THEN [{text}] ELSE {cut} END, lambda p: length({trim('p')}) > 0)"


def trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+', ''), '[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+$', '')"


def ident(*parts: str) -> str:
    return "substring(sha256(concat_ws(':', " + ", ".join(parts) + ")), 1, 16)"


def ext(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/](\\.[^./]*)$', 1))"


CHUNKED = f"""
chunked AS (
  SELECT {ident("'doc'", "source", "'section-root'", "i - 1")} AS id, list_extract(p, i) AS content, source
  FROM (SELECT source, p, unnest(range(1, len(p) + 1)) AS i
        FROM (SELECT concat(source, '/', doc_id, '.txt') AS source, {pieces(trim("text"))} AS p FROM documents WHERE length({trim("text")}) > 0)))"""

SHEETS = """
sheet_rows AS (
  SELECT CASE WHEN c_custkey % 200 = 7 THEN 'EMPTY' ELSE c_mktsegment END AS sheet, c_custkey AS k,
    CASE WHEN c_custkey % 200 = 7 THEN ',,' ELSE concat(',', c_custkey, ',"', replace(concat(' "', substring(c_name, 10, 20), '", ', c_mktsegment, ' '), '"', '""'), '"') END AS line
  FROM customer),
sheets AS (
  SELECT sheet, count(*) AS n, string_agg(CASE WHEN sheet = 'EMPTY' THEN ',,' ELSE line END, chr(10) ORDER BY k) AS content, count(*) OVER () AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY k) AS r FROM sheet_rows QUALIFY r <= 10000) GROUP BY sheet)"""

#: Every document as markdown: (source, text).
MARKDOWN = """
  SELECT concat(source, '/', doc_id, '.md') AS source,
    concat(CASE doc_id % 3 WHEN 0 THEN concat('# ', source, '  ', chr(10)) WHEN 1 THEN '' ELSE concat('## Sub', chr(10)) END, replace(text, chr(10), concat(chr(10), '## Part ', lang, ' ', chr(10)))) AS text
  FROM documents"""


def sections(texts: str) -> str:
    """Sections of markdown texts (source, text), line by line: `titled` has their text with the heading."""
    head = "^(#{1,6})[\\s\\x0B\\p{Z}\\x{FEFF}]+([^\\n\\r]+)$"
    return f"""
numbered AS (SELECT source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({texts})),
marked AS (SELECT *, regexp_matches(line, '{head}') AS h FROM numbered),
parted AS (SELECT *, sum(h::INT) OVER (PARTITION BY source ORDER BY i) AS part FROM marked),
found AS (
  SELECT source, part, {trim("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '')")} AS content,
    coalesce(max(regexp_extract(line, '{head}', 2)) FILTER (h), '') AS heading, coalesce(max(length(regexp_extract(line, '{head}', 1))) FILTER (h), 0) AS level
  FROM parted GROUP BY ALL),
titled AS (
  SELECT *, CASE WHEN length(heading) > 0 THEN concat(repeat('#', level), ' ', heading, chr(10), chr(10), content) ELSE content END AS titled, count(*) OVER (PARTITION BY source) AS sections
  FROM found WHERE length(content) > 0)"""


QUESTIONS = """
questions AS (
  SELECT item_id AS query_id, concat(text, ' in src', item_id % 20, CASE WHEN item_id % 3 = 0 THEN ' module' ELSE '' END) AS question FROM benchmark)"""

QUERIES = """
queries AS (
  SELECT vec_id AS query_id, embedding AS vector, question
  FROM embeddings JOIN questions q ON q.query_id = (vec_id // 20) % (SELECT count(*) FROM benchmark) WHERE vec_id % 20 = 0)"""


def analysed(source: str, services: list[str]) -> str:
    words = f"list_filter(list_transform(regexp_split_to_array(question, '[\\s\\x0B\\p{{Z}},;.!?]+'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains({_list(STOP_WORDS)}, w))"
    names = f"list_filter(regexp_extract_all(regexp_replace(question, '[^\\x00-\\x7F]', '#', 'g'), '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\\b', 1), lambda w: length(w) > 2 AND NOT list_contains({_list(STOP_WORDS)}, lower(w)))"
    first = lambda x: f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"
    return f"""
words AS (SELECT *, {words} AS w0, {names} AS n0 FROM {source}),
analysed AS (
  SELECT * EXCLUDE (w0, n0), {first("w0")} AS keywords, {first("n0")} AS names,
    {_case([(f"contains(lower(question), {_q(s)})", s) for s in services], "NULL")} AS service_filter,
    {_case([(f"contains(lower(question), {_q(w)})", w) for w in FILE_TYPE_WORDS], "NULL")} AS type_filter,
    {" OR ".join(f"contains(lower(question), {_q(w)})" for w in ARCHITECTURAL_WORDS)} AS is_architectural
  FROM words)"""


CHUNKS = """
chunks AS MATERIALIZED (
  SELECT doc_id::VARCHAR AS id, text AS content, embedding AS vector, CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'document' END AS kind,
    concat(source, '/f', doc_id // 40, '.ts') AS path, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS service, lang AS file_type,
    (doc_id % 40) * 7 + 1 AS line
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""

#: Each lateral sum runs over one pair of vectors.
SQUARE = "round(list_sum(list_transform(list_zip(q.vector, c.vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6)"


def keyword(chunks: str, k: int, filtered: bool) -> str:
    keep = "(c.kind <> 'code' OR ((a.service_filter IS NULL OR c.service = a.service_filter) AND (a.type_filter IS NULL OR c.file_type = a.type_filter)))" if filtered else "true"
    return f"""
asked AS (SELECT query_id, unnest(keywords) AS word, len(keywords) AS n FROM analysed),
distinct_words AS (SELECT DISTINCT word FROM asked),
lowered AS MATERIALIZED (SELECT id, lower(content) AS low FROM {chunks}),
grams AS MATERIALIZED (
  SELECT id, unnest(list_distinct(list_concat(regexp_extract_all(low, '(?s)...'), regexp_extract_all(substring(low, 2), '(?s)...'), regexp_extract_all(substring(low, 3), '(?s)...')))) AS gram FROM lowered),
gram_sizes AS (SELECT gram, count(*) AS n FROM grams GROUP BY 1),
rarest AS (
  SELECT word, arg_min(g.gram, coalesce(n, 0)) AS gram FROM (SELECT word, unnest(list_transform(range(1, length(word) - 1), lambda i: substring(word, i, 3))) AS gram FROM distinct_words WHERE length(word) > 2) g
  LEFT JOIN gram_sizes USING (gram) GROUP BY 1),
may_hold AS (
  SELECT word, id FROM rarest JOIN grams USING (gram) UNION ALL SELECT word, id FROM distinct_words, lowered WHERE length(word) <= 2),
counted AS MATERIALIZED (
  SELECT id, word, (length(low) - length(replace(low, word, ''))) // length(word) AS c FROM may_hold JOIN lowered USING (id) WHERE contains(low, word)),
scored AS (
  SELECT s.query_id, s.id, s.occurrences, least(s.occurrences / greatest(5 * n, 1), 1.0) AS score
  FROM (SELECT query_id, id, sum(c)::BIGINT AS occurrences, any_value(n) AS n FROM counted JOIN asked USING (word) GROUP BY ALL) s
  {f"JOIN {chunks} c ON c.id = s.id JOIN analysed a ON a.query_id = s.query_id WHERE {keep}" if filtered else ""}),
keyed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


FUSED = f"""
distances AS MATERIALIZED (
  SELECT q.query_id, c.id, {SQUARE} AS distance FROM analysed q, chunks c
  WHERE c.vector IS NOT NULL AND (c.kind <> 'code' OR ((q.service_filter IS NULL OR c.service = q.service_filter) AND (q.type_filter IS NULL OR c.file_type = q.type_filter)))),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM distances QUALIFY rank <= 18),
fused AS (
  SELECT query_id, id, s.rank AS semantic_rank, k.rank AS keyword_rank, coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS score
  FROM semantic s FULL JOIN keyed k USING (query_id, id)),
candidates AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, semantic_rank NULLS LAST, keyword_rank NULLS LAST, id) AS position FROM fused QUALIFY position <= 18)"""

RERANKED = """
boosted AS (
  SELECT f.query_id, f.id, f.position, c.path, c.line, c.kind, c.service, c.file_type, c.content,
    round(f.score + CASE WHEN c.service = a.service_filter THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c.file_type = a.type_filter THEN 0.15::DOUBLE ELSE 0 END
      + len(list_filter(a.names, lambda w: contains(lower(c.content), lower(w)))) * 0.1::DOUBLE
      + CASE WHEN a.is_architectural AND c.file_type IN ('module', 'service') THEN 0.1::DOUBLE ELSE 0 END
      + len(list_filter(a.keywords, lambda w: contains(lower(c.content), w))) * 0.05::DOUBLE, 9) AS raw
  FROM candidates f JOIN chunks c USING (id) JOIN analysed a USING (query_id)),
normal AS (
  SELECT *, min(raw) OVER w AS low, max(raw) OVER w AS high FROM boosted WINDOW w AS (PARTITION BY query_id)),
best AS (
  SELECT * EXCLUDE (low, high), CASE WHEN high = low THEN 1.0::DOUBLE ELSE round((raw - low) / (high - low), 9) END AS score FROM normal),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM best QUALIFY rank <= 6)"""


def expanded(base: str, order: str = "abs(c.line - b.line), c.line, c.id") -> str:
    return f"""
pairs AS (
  SELECT b.query_id, b.id AS base_id, b.rank AS base_rank, b.score * 0.5 AS score, c.id,
    row_number() OVER (PARTITION BY b.query_id, b.id ORDER BY {order}) AS near
  FROM {base} b JOIN chunks c ON c.path = b.path AND c.line BETWEEN b.line - 50 AND b.line + 50
  WHERE b.kind = 'code' AND c.kind = 'code' QUALIFY near <= 3),
together AS (
  SELECT query_id, id, score, 0 AS part, rank AS a, 0 AS b FROM {base}
  UNION ALL SELECT query_id, id, score, 1, base_rank, near FROM pairs WHERE id <> base_id),
once AS (SELECT * FROM together QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY part, a, b) = 1),
expanded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, a, b) AS rank FROM once)"""


def assembled(tokens: int) -> str:
    return f"""
spent AS (
  SELECT r.query_id, r.score, r.rank, r.content, r.path, r.service, r.file_type, r.kind, r.line,
    row_number() OVER w AS position,
    sum(ceil(length(r.content) / 3)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens
  FROM results r WINDOW w AS (PARTITION BY r.query_id ORDER BY r.score DESC, r.rank)),
assembled AS (SELECT * FROM spent WHERE tokens <= {tokens} AND position <= 8)"""


def prompts(label: str) -> str:
    head = "\n".join([context.CONTEXT_HEAD, "", context.CONTEXT_LINE % label, "", ""])
    tail = "\n".join(["", "", context.INSTRUCTIONS_HEAD, "", *context.INSTRUCTIONS])
    return f"""
sections AS (
  SELECT query_id, string_agg(concat('[', position, '] ',
      CASE WHEN kind <> 'document' AND length(service) > 0 THEN concat(service, '/', path) ELSE path END, ' (', file_type,
      CASE WHEN kind = 'document' AND line > 0 THEN concat(', page ', line) ELSE '' END, ', ', printf('%.1f', score * 100 + CASE WHEN score * 400 = floor(score * 400) AND (score * 400)::BIGINT % 2 = 1 THEN 1e-9 ELSE 0 END), '%)', chr(10), content, chr(10), chr(10)), '' ORDER BY position) AS s
  FROM assembled GROUP BY 1),
prompts AS (
  SELECT query_id, concat({_q(head)}, coalesce(s, ''), {_q(context.QUESTION_HEAD)}, chr(10), chr(10), question, {_q(tail)}) AS prompt
  FROM analysed LEFT JOIN sections USING (query_id))"""


FROM_EXPANDED = "results AS (SELECT e.query_id, e.id, e.score, e.rank, c.content, c.path, c.service, c.file_type, c.kind, c.line FROM expanded e JOIN chunks c USING (id))"
HISTORIES = f"""
said AS (
  SELECT *, sum(CASE WHEN role = 'user' AND lower(trim(text)) = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment
  FROM conversations WHERE role IN ('user', 'assistant')),
told AS (
  SELECT conv_id, turn, role, text,
    coalesce(string_agg(concat(CASE WHEN role = 'user' THEN {_q(ASKED)} ELSE {_q(ANSWERED)} END, ': ', text), chr(10)) OVER (PARTITION BY conv_id, segment ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history
  FROM said WHERE NOT (role = 'user' AND lower(trim(text)) = 'clear')),
histories AS (SELECT conv_id, turn, text AS question, history FROM told WHERE role = 'user')"""


#: The tree of files: its path within /data, its text as it is read leniently, its size and its doc_id.
TREE = """
tree AS MATERIALIZED (
  SELECT doc_id AS i, concat(source, '/', lang, '/', list_extract(['src/', 'lib/deep/', 'node_modules/x/', '', 'api/', '.hid/', 'api/dist/'], doc_id % 7 + 1), 'f', doc_id,
      list_extract(['.service.ts', '.tsx', '.py', '.spec.ts', '.go', '.d.ts', '.md', '.txt', '.controller.js', '.pdf', '.rs'], doc_id % 11 + 1)) AS relative,
    CASE doc_id % 13 WHEN 1 THEN concat(text, chr(65533), '.') WHEN 2 THEN concat('a', chr(65533), ' ', text) WHEN 3 THEN NULL WHEN 4 THEN '' ELSE text END AS text,
    CASE doc_id % 13 WHEN 1 THEN strlen(text) + 2 WHEN 2 THEN strlen(text) + 3 WHEN 3 THEN 7 WHEN 4 THEN 0 WHEN 5 THEN 10485761 ELSE strlen(text) END::BIGINT AS size, source, lang
  FROM documents),
services AS (
  SELECT DISTINCT p AS path, concat('s:', p) AS name, replace(rtrim(p, '/'), './', '') AS folder
  FROM (SELECT unnest(['.', source, concat('./', source, '/', lang, '/'), concat(source, '/', lang, '/api')]) AS p FROM (SELECT DISTINCT source, lang FROM documents))),
assigned AS (
  SELECT t.*, s.name, CASE WHEN folder = '.' THEN relative ELSE substring(relative, length(folder) + 2) END AS inside
  FROM tree t JOIN services s ON folder = '.' OR starts_with(relative, concat(folder, '/'))),
code_files AS (
  SELECT *, regexp_extract(relative, '[^.]*$') AS ext,
    CASE WHEN contains(lower(relative), '.controller.') THEN 'controller' WHEN contains(lower(relative), '.service.') THEN 'service' WHEN ends_with(relative, '.tsx') THEN 'component' ELSE 'unknown' END AS file_type
  FROM assigned WHERE regexp_matches(inside, '\\.(ts|tsx|js|py|go|rs)$') AND NOT regexp_matches(inside, '\\.(spec|d)\\.ts$')
    AND NOT regexp_matches(concat('/', inside), '/(node_modules|dist)/') AND NOT contains(concat('/', inside), '/.')),
code_good AS (
  SELECT *, CASE ext WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript-react' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' ELSE 'rust' END AS language
  FROM code_files WHERE size BETWEEN 1 AND 50000 AND text IS NOT NULL),
docs AS (
  SELECT *, CASE WHEN ends_with(relative, '.md') THEN 'markdown' ELSE 'text' END AS kind,
    CASE WHEN size < 1 THEN 'empty' WHEN size > 10485760 THEN 'larger than 10485760 bytes' WHEN text IS NULL THEN 'cannot be read' END AS message
  FROM tree WHERE regexp_matches(relative, '\\.(md|txt)$') AND NOT regexp_matches(relative, '/(node_modules|dist)/') AND NOT contains(relative, '/.'))"""


def tree_chunks() -> str:
    """Chunks of the tree's documents (source, id, content); no text has a heading."""
    return f"""
doc_pieces AS (SELECT i, concat('/data/', relative) AS source, {pieces(trim("text"))} AS p FROM docs WHERE message IS NULL AND length({trim("text")}) > 0),
doc_chunks AS (
  SELECT i, source, {ident("'doc'", "source", "'section-root'", "k - 1")} AS id, list_extract(p, k) AS content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM doc_pieces))"""


#: Hashed words of chunks and questions as unit vectors of 64 numbers.
HASHED = """
all_words AS (
  SELECT kind, id, unnest(list_filter(regexp_split_to_array(lower(content), '[\\s\\x0B\\p{Z}]+'), lambda w: length(w) > 0)) AS w
  FROM (SELECT 'c' AS kind, id, content FROM chunked UNION ALL SELECT 'q', query_id::VARCHAR, question FROM questions)),
word_sums AS (
  SELECT kind, id, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::BIGINT AS x FROM (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM all_words) GROUP BY ALL),
cells AS (
  SELECT e.kind, e.id, k, coalesce(x, 0) AS x FROM (SELECT kind, id, unnest(range(0, 64)) AS k FROM (SELECT DISTINCT kind, id FROM word_sums)) e LEFT JOIN word_sums USING (kind, id, k)),
hashed_vectors AS MATERIALIZED (
  SELECT kind, id, list((CASE WHEN x = 0 THEN 0 ELSE x::FLOAT / norm END)::FLOAT ORDER BY k) AS vector
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY kind, id))::FLOAT AS norm FROM cells) GROUP BY ALL)"""


def target(behind: str) -> str:
    """What a decorator stands before, told by the 200 characters behind its match: a class, else what is
    called first. These reach into the document's text."""
    ahead = f"substring({behind}, 1, 200)"
    return f"""CASE WHEN regexp_matches({ahead}, 'class[\\s\\x0B]+\\w') THEN regexp_extract({ahead}, 'class[\\s\\x0B]+(\\w+)', 1)
    WHEN regexp_matches({ahead}, '\\w[\\s\\x0B]*\\(') THEN regexp_extract({ahead}, '(?:async[\\s\\x0B]+)?(\\w+)[\\s\\x0B]*\\(', 1) ELSE 'unknown' END"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"


def statements(services: list[str], label: str) -> dict[str, str]:
    search = [QUESTIONS, QUERIES, analysed("queries", services), CHUNKS, keyword("chunks", 18, True), FUSED]
    full = [*search, RERANKED, expanded("reranked"), FROM_EXPANDED]
    names = [".controller.ts", ".service.ts", ".module.tsx", ".entity.py", ".dto.go", "/components/a.jsx", "/pages/b.java", "/hooks/c.rs", "/utils/d.rb", "/models/e.php", "/routes/f.kt", ".spec.cs", ".config.cpp", ".md", ".xlsx", ".pdf"]
    fits = [(" OR ".join([f"contains(lower(relative), {_q(p)})" for p in parts] + [f"ends_with(lower(relative), {_q(e)})" for e in ends]), kind) for kind, parts, ends in FILE_TYPES]
    by_ext = lambda table, default: _case([(f"{ext('relative')} = {_q(k)}", v) for k, v in table.items()], _q(default))
    inventory = """
inventory AS (
  SELECT doc_id, source, concat(source, CASE WHEN doc_id % 11 = 5 THEN '/node_modules/' ELSE '/' END, lang, '/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.service.ts' WHEN 1 THEN '.txt' ELSE '.md' END) AS relative,
    strlen(text)::BIGINT AS size, text, lang
  FROM (SELECT * EXCLUDE (text), CASE WHEN doc_id % 3 = 0 THEN concat('import { X } from ', chr(39), './x', doc_id, chr(39), chr(10), 'export class K', doc_id, ' {}', chr(10), text) ELSE text END AS text FROM documents))"""
    file_chunks = f"""
files AS (SELECT concat('/data/', relative) AS path, relative, source, string_split(text, chr(10)) AS l FROM inventory WHERE relative LIKE '%.ts' AND doc_id % 11 <> 5 AND size BETWEEN 1 AND 50000),
wins AS (
  SELECT path, relative, source, array_to_string(l[s + 1 : s + 18], chr(10)) AS content, s + 1 AS s, least(s + 18, len(l)) AS e, 'text' AS level
  FROM (SELECT *, unnest({starts("len(l)", 18, 2)}) AS s FROM files)),
every AS (
  SELECT path, relative, source, concat('// File: ', relative, chr(10), '// Service: ', source, chr(10), '// Type: service', chr(10), '// Lines: ', len(l), chr(10), chr(10), '// Imports:', chr(10), l[1], chr(10), chr(10), '// Exports:', chr(10), l[2]) AS content,
    1 AS s, len(l) AS e, 'file-summary' AS level, {ident("path", "'0'", "'0'")} AS id FROM files
  UNION ALL SELECT path, relative, source, content, s, e, level, {ident("path", "s", "e")} FROM wins WHERE length({trim("content")}) > 0)"""
    nearest = lambda kind: f"SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place FROM pairs_d WHERE kind = '{kind}' QUALIFY place <= 10"
    chunked = _with(CHUNKED) + 'SELECT id, content, source AS "filePath", source AS "relativePath", \'\' AS "serviceName", \'text\' AS "fileType", \'\' AS language, \'\' AS "symbolName", \'\' AS level, 0::INT AS "startLine", 0::INT AS "endLine", \'document\' AS "chunkType" FROM chunked'
    tree_code = f"""
code_lines AS (SELECT *, concat('/data/', relative) AS path, string_split(text, chr(10)) AS l FROM code_good),
code_wins AS (SELECT path, name, array_to_string(l[s + 1 : s + 18], chr(10)) AS content, s + 1 AS s, least(s + 18, len(l)) AS e FROM (SELECT *, unnest({starts("len(l)", 18, 2)}) AS s FROM code_lines)),
code_chunks AS (
  SELECT path, name, {ident("path", "'0'", "'0'")} AS id, concat('// File: ', relative, chr(10), '// Service: ', name, chr(10), '// Type: ', file_type, chr(10), '// Lines: ', len(l), chr(10)) AS content FROM code_lines
  UNION ALL SELECT path, name, {ident("path", "s", "e")}, content FROM code_wins WHERE length({trim("content")}) > 0)"""
    asked = [
        QUESTIONS, analysed("questions", services), CHUNKED.replace("concat(source, '/', doc_id, '.txt') AS source", "concat('/data/', source, '/', doc_id, '.txt') AS source"), HASHED,
        """chunks AS MATERIALIZED (
  SELECT c.id, c.content, v.vector, 'document' AS kind, c.source AS path, '' AS service, 'text' AS file_type, 0 AS line FROM chunked c JOIN hashed_vectors v ON v.kind = 'c' AND v.id = c.id)""",
    ]
    asked_search = FUSED.replace("FROM analysed q, chunks c", "FROM (SELECT a.*, v.vector FROM analysed a JOIN hashed_vectors v ON v.kind = 'q' AND v.id = a.query_id::VARCHAR) q, chunks c")
    scaled = CHUNKS.replace("chunks AS MATERIALIZED", "plain_chunks AS") + """,
chunks AS MATERIALIZED (
  SELECT * REPLACE (list_transform(vector, lambda x: (x * f)::FLOAT) AS vector), list_reduce(list_transform(vector, lambda x: (x * f)::FLOAT::DOUBLE * (x * f)::FLOAT::DOUBLE), lambda a, b: a + b) AS norm
  FROM (SELECT *, list_extract([1, 2, 4], id::INT % 3 + 1)::FLOAT AS f FROM plain_chunks WHERE vector IS NOT NULL))"""
    capped = keyword("chunks", 18, False).replace("scored AS (", "all_scored AS (") + """,
scored AS (SELECT s.* FROM all_scored s JOIN chunks c USING (id) QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY c.norm, id) <= 54),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 18)"""
    capped = capped.replace("keyed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 18),\n", "")
    near_d = f"near_d AS (SELECT q.query_id, c.id, c.path, c.line, c.kind, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)"
    base = "base AS (SELECT *, round(1 - least(distance, 1.0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near_d QUALIFY rank <= 6)"
    return {
        "keyword_capped": _with(QUESTIONS, QUERIES, analysed("queries", services), scaled, capped) + "SELECT query_id, id, occurrences, round(score, 6) AS score, rank::INT AS rank FROM kept",
        "expanded_by_norm": _with(QUESTIONS, QUERIES, scaled, near_d, base, expanded("base", "c.norm, c.id")) + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM expanded",
        "code_tree": _with(TREE) + """
SELECT name AS "serviceName", relative AS "relativePath", file_type AS "fileType", language, len(string_split(text, chr(10)))::INT AS line_count, size, sha256(text) AS sha FROM code_good""",
        "failed_documents": _with(TREE, tree_chunks()) + """
SELECT mode, source, id, sha256(content) AS sha, NULL::VARCHAR AS name, NULL::VARCHAR AS message FROM doc_chunks, (VALUES ('lenient'), ('strict')) m(mode) WHERE mode = 'lenient' OR i % 13 NOT IN (1, 2)
UNION ALL SELECT mode, concat('/data/', relative), NULL, NULL, regexp_extract(relative, '[^/]*$'), coalesce(message, 'not UTF-8') FROM docs, (VALUES ('lenient'), ('strict')) m(mode)
  WHERE message IS NOT NULL OR (mode = 'strict' AND i % 13 IN (1, 2))
UNION ALL SELECT 'service', concat('d', doc_id), NULL, NULL, concat('d', doc_id), CASE WHEN doc_id % 4 = 0 OR doc_id % 8 = 5 THEN 'unknown' WHEN doc_id % 8 = 1 THEN 'Vue' ELSE 'Next.js' END FROM documents""",
        "streamed_files": _with(TREE, tree_chunks(), tree_code) + """
SELECT 'document' AS "chunkType", source, '' AS "serviceName", id, sha256(content) AS told FROM doc_chunks
UNION ALL SELECT 'code', path, name, id, sha256(content) FROM code_chunks
UNION ALL SELECT 'error', concat('/data/', relative), NULL, regexp_extract(relative, '[^/]*$'), message FROM docs WHERE message IS NOT NULL
UNION ALL SELECT 'error', concat('/data/', relative), NULL, regexp_extract(relative, '[^/]*$'), CASE WHEN size < 1 THEN 'empty' WHEN size > 50000 THEN 'larger than 50000 bytes' ELSE 'cannot be read' END
  FROM code_files WHERE size < 1 OR size > 50000 OR text IS NULL""",
        "asked_results": _with(*asked, keyword("chunks", 18, True), asked_search, RERANKED, expanded("reranked")) + """
SELECT query_id, id, path AS "filePath", round(score, 6) AS score, rank::INT AS rank FROM expanded JOIN (SELECT id, path FROM chunks) USING (id)""",
        "indexed_keywords": _with(
            QUESTIONS, analysed("questions", services).replace("analysed AS (", "analysed_q AS ("),
            """analysed AS (
  SELECT -1 - query_id AS query_id, keywords FROM analysed_q
  UNION ALL SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{11,}')[1:3] AS w FROM documents))""",
            CHUNKED, keyword("chunked", 18, False),
        ) + "SELECT query_id, id, occurrences, round(score, 6) AS score, rank::INT AS rank FROM keyed",
        "capped_sheets": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem QUALIFY k <= 10000)
SELECT l_returnflag AS "sheetName", count(*)::INT AS "rowCount", count(*) OVER () AS "totalSheets", sha256(string_agg(concat(l_orderkey, ',', l_linenumber, ',', l_partkey, ',', l_suppkey), chr(10) ORDER BY k)) AS sha FROM r GROUP BY 1""",
        "service_filters": f"""
WITH q AS (
  SELECT item_id AS query_id, concat(text, CASE item_id % 4 WHEN 0 THEN concat(' of APP', item_id, ' en') WHEN 1 THEN concat(' of app', item_id, '-de?') WHEN 2 THEN concat(' of app', item_id * 3, 'fr') ELSE '' END) AS question FROM benchmark),
s AS (SELECT concat('app', doc_id, '-', lang) AS name, doc_id AS place, doc_id, lang FROM documents),
hits AS (
  SELECT query_id, name, 0 AS part, place FROM q JOIN s ON contains(lower(question), concat('app', doc_id, '-', lang)) OR contains(lower(question), concat('app', doc_id, ' ', lang)) OR contains(lower(question), concat('app', doc_id, lang))
  UNION ALL
  SELECT query_id, arg_min(name, place), 1, min(place) FROM q JOIN (SELECT lang, min(place) AS place, arg_min(name, place) AS name FROM s GROUP BY lang) f
    ON regexp_matches(question, concat('(?i)(^|[^A-Za-z0-9_])', lang, '($|[^A-Za-z0-9_])')) GROUP BY query_id)
SELECT q.query_id, best.name AS service FROM q LEFT JOIN (SELECT query_id, arg_min(name, (part, place)) AS name FROM hits GROUP BY 1) best ON q.query_id = best.query_id""",
        "cleared_histories": _with(HISTORIES.replace("FROM conversations WHERE", "FROM (SELECT * REPLACE (CASE WHEN role = 'user' AND (conv_id + 3 * turn) % 11 = 6 THEN ' Clear ' ELSE text END AS text) FROM conversations) WHERE")) + "SELECT * FROM histories",
        "table_states": """
SELECT k.kind AS "chunkType", CASE WHEN state = 'absent' OR (state = 'cleared' AND k.kind = 'code') THEN 0 ELSE n END AS n, state
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'code' ELSE 'document' END AS kind, count(*) AS n FROM documents GROUP BY 1) k, (VALUES ('absent'), ('filled'), ('cleared')) s(state)""",
        "streamed_chunks": chunked,
        "detected_services": """
WITH m AS (
  SELECT source, max(concat('{"name":"', lpad((doc_id % 1000)::VARCHAR, 3, '0'), '","', CASE WHEN doc_id % 2 = 0 THEN 'dependencies' ELSE 'devDependencies' END, '":{"',
    CASE lang WHEN 'en' THEN '@nestjs/core' WHEN 'fr' THEN 'react' WHEN 'de' THEN 'express' ELSE 'other' END, '":"1"}}')) AS json FROM documents GROUP BY 1),
f AS (SELECT source, CASE WHEN contains(json, '@nestjs') THEN 'NestJS' WHEN contains(json, '"express"') THEN 'Express' WHEN contains(json, '"react"') THEN 'React' ELSE 'Node.js' END AS framework FROM m)
SELECT source AS name, source AS path, framework, CASE framework WHEN 'React' THEN '프론트엔드' WHEN 'Node.js' THEN 'service' ELSE '백엔드 API' END AS role FROM f""",
        "system_prompts": """
WITH s AS (SELECT lang, source, min(doc_id) AS place, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang AS project, concat('You are an expert assistant for ', lang, '.', chr(10), 'Texts: ', sum(n)::BIGINT, '.', chr(10), chr(10), '프로젝트 서비스 구성:', chr(10),
  string_agg(concat('- ', source, ': NestJS (api)'), chr(10) ORDER BY place), chr(10), chr(10), 'Guidelines:', chr(10), '- Be brief.') AS prompt
FROM s GROUP BY lang""",
        "minimum_slice": _with(
            QUESTIONS, analysed("questions", services), CHUNKED, keyword("chunked", 18, False),
            "results AS (SELECT k.query_id, k.id, round(k.score, 6) AS score, k.rank, c.content, c.source AS path, '' AS service, 'text' AS file_type, 'document' AS kind, 0 AS line FROM keyed k JOIN chunked c USING (id))",
            assembled(6000), prompts(label),
        ) + "SELECT query_id, length(prompt)::INT AS n, sha256(prompt) AS sha FROM prompts",
        "document_chunks": chunked,
        "code_windows": f"""
WITH files AS (SELECT concat(source, '/', doc_id) AS path, source, lang, text, string_split(text, chr(10)) AS l FROM documents),
summary AS (
  SELECT path, source, lang, concat('// File: ', path, chr(10), '// Service: ', source, chr(10), '// Type: ', lang, chr(10), '// Lines: ', len(l), chr(10)) AS content,
    1 AS s, len(l) AS e, 'file-summary' AS level, {ident("path", "'0'", "'0'")} AS id FROM files),
wins AS (
  SELECT path, source, lang, array_to_string(l[s + 1 : s + 4], chr(10)) AS content, s + 1 AS s, least(s + 4, len(l)) AS e, 'text' AS level
  FROM (SELECT *, unnest({starts("len(l)", 4, 1)}) AS s FROM files)),
every AS (
  SELECT * FROM summary UNION ALL
  SELECT path, source, lang, content, s, e, level, {ident("path", "s", "e")} FROM wins WHERE length({trim("content")}) > 0)
SELECT id, content, path AS "filePath", path AS "relativePath", source AS "serviceName", lang AS "fileType", '' AS language, '' AS "symbolName", level, s::INT AS "startLine", e::INT AS "endLine", 'code' AS "chunkType" FROM every""",
        "page_chunks": f"""
WITH parts AS (
  SELECT concat(source, '/', doc_id, '.txt') AS source, page, {trim("substring(text, (page - 1) * n + 1, n)")} AS content
  FROM (SELECT *, greatest(ceil(length(text) / 3.0), 1)::BIGINT AS n, unnest([1, 2, 3]) AS page FROM documents)),
cut AS (SELECT source, page, {pieces("content")} AS p FROM parts WHERE length(content) > 0),
each AS (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)
SELECT {ident("'doc'", "source", "concat('page-', page)", "i - 1")} AS id, list_extract(p, i) AS content, source, page::INT AS page, (i - 1)::INT AS "index", '3' AS total_pages FROM each""",
        "sheet_chunks": _with(SHEETS, f"cut AS (SELECT *, {pieces('content')} AS p FROM sheets WHERE length(content) > 0)") + f"""
SELECT {ident("'doc'", "'customers.xlsx'", "concat('sheet-', sheet)", "i - 1")} AS id, list_extract(p, i) AS content, 'customers.xlsx' AS source, sheet, n::VARCHAR AS row_count, total::VARCHAR AS total_sheets
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)""",
        "sheet_caps": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders QUALIFY k <= 10000)
SELECT o_orderstatus AS "sheetName", count(*)::INT AS "rowCount", string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY k) AS content FROM r GROUP BY 1""",
        "document_totals": _with(sections(MARKDOWN)) + f"""
SELECT concat(source, '/', doc_id, '.txt') AS source, (CASE WHEN length({trim('text')}) > 0 THEN 1 ELSE 0 END)::INT AS sections, false AS "hasTitle" FROM documents
UNION ALL SELECT source, count(*)::INT, arg_min(level, part) = 1 FROM titled GROUP BY source""",
        "part_totals": _with(SHEETS) + f"""
SELECT concat(source, '/', doc_id, '.txt') AS source, (CASE WHEN length({trim('text')}) > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS parts, 3::BIGINT AS total FROM documents
UNION ALL SELECT 'customers.xlsx', count(*) FILTER (length(content) > 0), any_value(total) FROM sheets""",
        "markdown_chunks": _with(sections(MARKDOWN), f"cut AS (SELECT *, {pieces('titled')} AS p FROM titled)") + f"""
SELECT {ident("'doc'", "source", "CASE WHEN length(heading) > 0 THEN concat('section-', heading) ELSE 'section-root' END", "i - 1")} AS id, list_extract(p, i) AS content, source AS "filePath", 'markdown' AS "fileType",
  heading AS level, level::VARCHAR AS heading_level, sections::VARCHAR AS section_count
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)""",
        "all_documents": _with(
            sections(MARKDOWN), SHEETS,
            f"""halves AS (
  SELECT concat(source, '/', doc_id, '.txt') AS source, {trim("substring(text, (page - 1) * n + 1, n)")} AS content
  FROM (SELECT *, greatest(ceil(length(text) / 2.0), 1)::BIGINT AS n, unnest([1, 2]) AS page FROM documents))""",
            f"""every AS (
  SELECT 'text' AS kind, concat(source, '/', doc_id, '.txt') AS source, {pieces(trim("text"))} AS p FROM documents WHERE length({trim("text")}) > 0
  UNION ALL SELECT 'markdown', source, {pieces("titled")} FROM titled
  UNION ALL SELECT 'pdf', source, {pieces("content")} FROM halves WHERE length(content) > 0
  UNION ALL SELECT 'excel', 'customers.xlsx', {pieces("content")} FROM sheets WHERE length(content) > 0)""",
        ) + "SELECT kind AS \"sourceType\", sum(len(p))::BIGINT AS chunks, count(DISTINCT source) AS sources, sum(list_sum(list_transform(p, lambda x: length(x))))::BIGINT AS characters FROM every GROUP BY 1",
        "search_results": _with(QUESTIONS, QUERIES, CHUNKS, f"d AS (SELECT q.query_id, c.*, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)") + """
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank, id, sha256(content) AS sha, round(1 - least(distance, 1.0), 6) AS score, path AS "relativePath", kind AS "chunkType",
  line::INT AS "startLine", (line + 6)::INT AS "endLine", 'text' AS level, path AS "filePath", service AS "serviceName", file_type AS "fileType", '' AS "symbolName" FROM d QUALIFY rank <= 5""",
        "keyword_parity": _with(QUESTIONS, QUERIES, analysed("queries", services), CHUNKS) + f"""
SELECT query_id, id, occurrences, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT query_id, id, occurrences, least(occurrences / greatest(5 * len(keywords), 1), 1.0) AS score FROM (
    SELECT a.query_id, c.id, a.keywords, coalesce(list_sum(list_transform(a.keywords, lambda w: (length(c.low) - length(replace(c.low, w, ''))) // length(w))), 0)::BIGINT AS occurrences
    FROM analysed a, (SELECT *, lower(content) AS low FROM chunks) c
    WHERE (c.kind = 'document' OR len(list_filter(a.keywords, lambda w: contains(c.content, w))) > 0)
      AND (c.kind <> 'code' OR ((a.service_filter IS NULL OR c.service = a.service_filter) AND (a.type_filter IS NULL OR c.file_type = a.type_filter)))))
QUALIFY rank <= 18""",
        "chunk_table": _with(CHUNKS) + "SELECT id, path AS \"filePath\", kind AS \"chunkType\", line::INT AS \"startLine\", 64::INT AS width FROM chunks WHERE kind = 'document' OR line < 100",
        "embedded_chunks": _with(CHUNKED, f"""
words AS (SELECT id, source, unnest(list_filter(regexp_split_to_array(lower(content), '[\\s\\x0B\\p{{Z}}]+'), lambda w: length(w) > 0)) AS w FROM chunked)""", """
hashed AS (SELECT id, source, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM words)""", """
sums AS (SELECT id, source, h % 64 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM hashed GROUP BY ALL)""", """
facts AS (SELECT id, source, count(*) FILTER (x <> 0) AS filled, max(x) AS most, min(k) FILTER (x = m) AS place, count(*) AS held, sum(x * x) AS square
  FROM (SELECT *, max(x) OVER (PARTITION BY id, source) AS m FROM sums) GROUP BY ALL)""", """
zeros AS (SELECT id, source, min(z) AS free FROM (SELECT DISTINCT id, source, unnest(range(0, 64)) AS z FROM facts WHERE most <= 0) t
  WHERE NOT EXISTS (SELECT 1 FROM sums s WHERE s.id = t.id AND s.source = t.source AND s.k = z AND s.x <> 0) GROUP BY ALL)""") + """
SELECT f.id, f.source AS "filePath", 64::INT AS width, CASE WHEN square > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS square, filled::INT AS filled,
  (coalesce(z.free, place) + 1)::INT AS greatest
FROM facts f LEFT JOIN zeros z USING (id, source)""",
        "framework_metadata": f"""
WITH k AS (SELECT *, doc_id AS i, doc_id % 5 AS kind FROM documents),
b AS (
  SELECT *, concat(') {{}}', chr(10), '}}', chr(10), text) AS behind_post, concat(') {{}}', chr(10), '  @UseInterceptors(I', i % 2, ')', chr(10), '  @Post()', chr(10), '  async make(', behind_post) AS behind_guards,
    CASE kind WHEN 0 THEN concat(' C', i, ' {{', chr(10), '  constructor(private a: A', i % 7, ', readonly b: B) {{}}', chr(10), '  @Get(', chr(39), lang, chr(39), ')', chr(10), '  @UseGuards(G1, G', i % 4, ')', chr(10), '  list(', behind_guards)
      WHEN 1 THEN concat(' E', i, ' {{', chr(10), '  @ManyToOne(() => User, (u) => u.items', i % 3, ') @JoinColumn()', chr(10), '  user: User;', chr(10), '  @OneToOne(() => P', i % 2, ')', chr(10), '  p: P;', chr(10), '}}', chr(10), text)
      WHEN 3 THEN concat(' S', i, ' {{', chr(10), '  constructor(private readonly repo: Repo', i % 3, ', public readonly x: X) {{}}', chr(10), '  async run() {{}}', chr(10), '}}', chr(10), text) END AS behind_class
  FROM k),
d AS (SELECT *, {target("behind_class")} AS of_class, {target("behind_guards")} AS of_guards, {target("behind_post")} AS of_post FROM b)
SELECT doc_id,
  CASE WHEN kind < 4 THEN 'nestjs' WHEN i % 2 = 1 THEN 'custom' END AS plugin, kind < 4 OR i % 2 = 1 AS "hasFramework",
  CASE kind WHEN 0 THEN 'controller' WHEN 1 THEN 'entity' WHEN 2 THEN 'module' WHEN 3 THEN 'service' END AS role,
  CASE kind WHEN 0 THEN concat('REST 컨트롤러 (', source, '). Routes: GET /', source, '/', lang, ', POST /', source)
    WHEN 1 THEN concat('엔티티 (', source, '). Relations: OneToOne → P', i % 2, ', ManyToOne → User')
    WHEN 2 THEN concat('모듈 (', source, '). Imports: A', i % 3, ', B.forRoot, C')
    WHEN 3 THEN concat('서비스 (', source, '). Dependencies: Repo', i % 3, ', X')
    ELSE concat(lang, ' 파일 (', source, '). typescript, ', len(string_split(text, chr(10))) + i % 2, ' lines') END AS summary,
  CASE kind WHEN 0 THEN concat('./m', i, ',b', i % 3) WHEN 2 THEN 'x' WHEN 3 THEN concat('q', i % 5) ELSE '' END AS imports,
  CASE kind WHEN 0 THEN concat('C', i) WHEN 1 THEN concat('E', i) WHEN 2 THEN concat('M', i) WHEN 3 THEN concat('S', i) ELSE '' END AS exports,
  CASE kind WHEN 0 THEN 'Controller,Get,UseGuards,UseInterceptors,Post' WHEN 1 THEN 'Entity,ManyToOne,JoinColumn,OneToOne' WHEN 2 THEN 'Module' WHEN 3 THEN 'Injectable' ELSE '' END AS decorators,
  CASE WHEN kind = 2 THEN concat('A', i % 3, ',B.forRoot,C') WHEN kind < 4 THEN '' WHEN i % 2 = 1 THEN 'custom' END AS modules,
  CASE WHEN kind = 0 THEN concat('GET /', source, '/', lang, ' UseGuards G1,G', i % 4, ' I', i % 2, ';POST /', source, ' make  ') WHEN kind < 4 OR i % 2 = 1 THEN '' END AS routes,
  CASE WHEN kind = 1 THEN concat('OneToOne P', i % 2, ' - false;ManyToOne User u.items', i % 3, ' true') WHEN kind < 4 OR i % 2 = 1 THEN '' END AS relations,
  CASE WHEN kind = 0 THEN concat('A', i % 7, ',B') WHEN kind = 3 THEN concat('Repo', i % 3, ',X') WHEN kind < 4 OR i % 2 = 1 THEN '' END AS deps,
  CASE WHEN kind = 0 THEN concat('Controller(', chr(39), source, chr(39), ') ', of_class, ';UseGuards(G1, G', i % 4, ') ', of_guards, ';Post() ', of_post)
    WHEN kind = 1 THEN concat('Entity(', chr(39), 'e', i, chr(39), ') ', of_class, ';JoinColumn() user') WHEN kind = 3 THEN concat('Injectable() ', of_class) WHEN kind < 4 OR i % 2 = 1 THEN '' END AS occurrences
FROM d""",
        "classified_paths": f"""
WITH p AS (SELECT doc_id, concat(source, '/', doc_id, list_extract({_list(names)}, doc_id % {len(names)} + 1)) AS relative FROM documents)
SELECT doc_id, relative, regexp_extract(relative, '[^/]*$') AS name, {_case(fits, "'unknown'")} AS file_type, {by_ext(LANGUAGES, "unknown")} AS language, {by_ext(DOCUMENT_TYPES, "text")} AS document_type FROM p""",
        "question_analysis": _with(QUESTIONS, analysed("questions", services)) + "SELECT query_id, array_to_string(keywords, ' ') AS keywords, array_to_string(names, ' ') AS entity_names, service_filter, type_filter AS file_type_filter, is_architectural FROM analysed",
        "trimmed": f"SELECT doc_id, sha256({trim('text')}) AS sha FROM documents",
        "keyword_search": _with(QUESTIONS, analysed("questions", services), CHUNKED, keyword("chunked", 18, False)) + "SELECT query_id, id, occurrences, round(score, 6) AS score, rank::INT AS rank FROM keyed",
        "nearest_by_cells": _with(QUESTIONS, QUERIES, CHUNKS, f"d AS (SELECT q.query_id, c.id, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)") + "SELECT query_id, id, distance, round(1 - least(distance, 1.0), 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank FROM d QUALIFY rank <= 18",
        "semantic_search": _with(QUESTIONS, QUERIES, CHUNKS, f"d AS (SELECT q.query_id, c.id, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)") + "SELECT query_id, id, distance, round(1 - least(distance, 1.0), 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INT AS rank FROM d QUALIFY rank <= 18",
        "merged_hits": _with(QUESTIONS, QUERIES, CHUNKS, f"pairs_d AS (SELECT q.query_id, c.id, c.kind, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)", f"both_d AS (SELECT *, 0 AS f FROM ({nearest('code')}) UNION ALL SELECT *, 1 FROM ({nearest('document')}))") + "SELECT query_id, id, distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, f, id))::INT AS rank FROM both_d QUALIFY rank <= 10",
        "hybrid_search": _with(*search) + "SELECT query_id, id, round(score, 6) AS score, position::INT AS rank, semantic_rank::INT AS semantic_rank, keyword_rank::INT AS keyword_rank FROM candidates",
        "reranked": _with(*search, RERANKED) + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM reranked",
        "expanded": _with(QUESTIONS, QUERIES, CHUNKS, f"near_d AS (SELECT q.query_id, c.id, c.path, c.line, c.kind, {SQUARE} AS distance FROM queries q, chunks c WHERE c.vector IS NOT NULL)", "base AS (SELECT *, round(1 - least(distance, 1.0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near_d QUALIFY rank <= 6)", expanded("base")) + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM expanded",
        "retrieved": _with(*full) + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM expanded",
        "assembled": _with(*full, assembled(6000)) + "SELECT query_id, position::INT AS position, tokens, path AS \"filePath\", service AS \"serviceName\", file_type AS \"fileType\", round(score, 6) AS score, kind AS \"chunkType\" FROM assembled",
        "rag_prompts": _with(*full, assembled(6000), prompts(label)) + "SELECT query_id, length(prompt)::INT AS n, sha256(prompt) AS sha FROM prompts",
        "chat_histories": _with(HISTORIES) + "SELECT * FROM histories",
        "chat_prompts": _with(
            HISTORIES,
            "queries AS (SELECT concat(conv_id, ':', turn) AS query_id, question, embedding AS vector FROM histories JOIN embeddings ON vec_id = (conv_id * 31 + turn) % (SELECT count(*) FROM embeddings))",
            analysed("queries", services), CHUNKS, keyword("chunks", 18, True), FUSED, RERANKED, expanded("reranked"), FROM_EXPANDED, assembled(6000), prompts(label),
            f"final AS (SELECT p.query_id, concat(CASE WHEN length(h.history) > 0 THEN concat({_q(HISTORY_HEAD)}, chr(10), h.history, chr(10), chr(10)) ELSE '' END, p.prompt) AS prompt FROM prompts p JOIN histories h ON p.query_id = concat(h.conv_id, ':', h.turn))",
        ) + "SELECT query_id, length(prompt)::INT AS n, sha256(prompt) AS sha FROM final",
        "chunk_counts": _with(CHUNKS) + "SELECT kind AS \"chunkType\", count(*) AS n FROM chunks GROUP BY 1",
        "service_files": _with(inventory) + """
SELECT concat('/data/', relative) AS "filePath", relative AS "relativePath", source AS "serviceName", 'service' AS "fileType", 'typescript' AS language, len(string_split(text, chr(10)))::INT AS line_count,
  strftime(to_timestamp(doc_id + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS "lastModified", size
FROM inventory WHERE relative LIKE '%.ts' AND doc_id % 11 <> 5 AND size BETWEEN 1 AND 50000""",
        "listed_documents": _with(inventory) + "SELECT relative AS \"relativePath\", CASE WHEN relative LIKE '%.md' THEN 'markdown' ELSE 'text' END AS \"documentType\", regexp_extract(relative, '[^/]*$') AS \"fileName\", size AS \"sizeBytes\" FROM inventory WHERE regexp_matches(relative, '\\.(md|txt)$') AND doc_id % 11 <> 5 AND size BETWEEN 1 AND 10485760",
        "file_chunks": _with(inventory, file_chunks) + 'SELECT id, content, path AS "filePath", relative AS "relativePath", source AS "serviceName", \'service\' AS "fileType", \'typescript\' AS language, \'\' AS "symbolName", level, s::INT AS "startLine", e::INT AS "endLine", \'code\' AS "chunkType" FROM every',
        "indexed_code": _with(inventory, file_chunks) + "SELECT (SELECT count(*) FROM inventory WHERE relative LIKE '%.ts' AND doc_id % 11 <> 5) AS \"processedFiles\", count(*) AS chunks FROM every",
        "indexed_documents": _with(
            inventory, "listed AS (SELECT doc_id, relative AS source, text FROM inventory WHERE regexp_matches(relative, '\\.(md|txt)$') AND doc_id % 11 <> 5 AND size BETWEEN 1 AND 10485760)",
            sections("SELECT * FROM listed WHERE doc_id % 3 = 2"),
            f"""every AS (
  SELECT len({pieces("titled")}) AS n FROM titled UNION ALL
  SELECT len({pieces(trim("text"))}) AS n FROM listed WHERE doc_id % 3 = 1 AND length({trim("text")}) > 0)""",
        ) + "SELECT (SELECT count(*) FROM listed) AS \"processedFiles\", sum(n)::BIGINT AS chunks FROM every",
        "paired_vectors": "SELECT doc_id AS id, lang, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 5) AS first FROM documents JOIN embeddings ON doc_id = vec_id",
    }
