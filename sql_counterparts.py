"""The queries of ``loomdex.plans.table_queries`` once more, as SQL for DuckDB.

Written independently of the Spark code and only used to check its results.
Every text reads the same tables whole.
"""

from __future__ import annotations

from loomdex import fixed_values as fv

SQL: dict[str, str] = {}

NL = "chr(10)"
SPACES = " || ".join(f"chr({ord(c)})" for c in fv.WHITESPACE)
# RE2 writes code points as \x{..}
SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
IN_LINE = r"[\t\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def half_up(x: str, scale: int = 100) -> str:
    return f"floor(({x}) * {scale} + 0.5) / {scale}.0"


def rate(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN {half_up(f'({a})::DOUBLE / ({b})')} END"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


DOCS = """docs AS (
  SELECT 'doc-' || doc_id AS documentId, lang || ' / ' || source AS title, source,
         'https://corpus.example/' || source || '/' || doc_id AS sourceUrl,
         lang AS category, text
  FROM documents)"""


def tail(x: str, overlap: int) -> str:
    end = f"right({x}, {overlap})"
    return (f"CASE WHEN length({x}) <= {overlap} THEN ''"
            f" WHEN strpos({end}, {NL}) BETWEEN 2 AND {overlap - 1}"
            f" THEN substr({end}, strpos({end}, {NL}) + 1) ELSE {end} END")


def chunks(size: int, overlap: int, source: str = "docs", name: str | None = None) -> str:
    name = name or f"chunks_{size}"
    return f"""folded_{name} AS (
  SELECT documentId, title, source, sourceUrl, category,
    list_reduce(string_split(text, {NL}), lambda a, l: CASE
      WHEN length(l) > {size} THEN {{
        'o': a.o || CASE WHEN {trim('a.c')} <> '' THEN [{trim('a.c')}] ELSE []::VARCHAR[] END
             || list_transform(regexp_extract_all(l, '(?s).{{1,{size}}}'), lambda p: {trim('p')}),
        'c': {tail('l', overlap)}}}
      WHEN length(a.c) + (a.c <> '')::INT + length(l) > {size} AND {trim('a.c')} <> '' THEN {{
        'o': list_append(a.o, {trim('a.c')}),
        'c': CASE WHEN ({tail('a.c', overlap)}) = '' THEN l
             ELSE ({tail('a.c', overlap)}) || {NL} || l END}}
      ELSE {{'o': a.o, 'c': CASE WHEN a.c = '' THEN l ELSE a.c || {NL} || l END}}
      END, {{'o': []::VARCHAR[], 'c': ''}}) AS f
  FROM {source} WHERE {trim('text')} <> ''),
listed_{name} AS (
  SELECT * EXCLUDE f,
    f.o || CASE WHEN {trim('f.c')} <> '' THEN [{trim('f.c')}] ELSE []::VARCHAR[] END AS pieces
  FROM folded_{name}),
{name} AS (
  SELECT documentId || '-' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, '0') AS chunkId,
    documentId, title, source, sourceUrl, category, i::INT AS chunkIndex, pieces[i + 1] AS text,
    {size} AS chunkSize, {overlap} AS overlap
  FROM (SELECT *, unnest(range(len(pieces))) AS i FROM listed_{name}))"""


C800 = chunks(800, 100)
C300 = chunks(300, 50)

QUESTIONS = """questions AS (
  SELECT 'Q' || b.item_id AS id, coalesce(d.lang, 'out-of-scope') AS category, b.text AS question,
    CASE WHEN d.doc_id IS NULL THEN 'insufficient' ELSE b.text END AS groundTruth,
    CASE WHEN d.doc_id IS NULL THEN '' ELSE 'doc-' || d.doc_id END AS expectedSource,
    CASE WHEN d.doc_id IS NULL THEN ''
         ELSE 'https://corpus.example/' || d.source || '/' || d.doc_id END AS expectedSourceUrl,
    CASE WHEN d.doc_id IS NULL THEN 'out_of_scope' ELSE 'in_scope' END AS scope,
    b.item_id AS position
  FROM benchmark b
  LEFT JOIN (SELECT x.item_id, min(y.doc_id) AS doc_id
             FROM benchmark x JOIN documents y ON contains(y.text, x.text) GROUP BY 1) e
    ON e.item_id = b.item_id
  LEFT JOIN documents d ON d.doc_id = e.doc_id)"""


def term_counts(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT k, b, count(*) AS n FROM (
    SELECT {key} AS k, ('0x' || substr(md5(t), 1, 7))::BIGINT % 1024 AS b
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z]+')) AS t FROM {source}))
  GROUP BY ALL)"""


def top5(size: int, name: str) -> str:
    return ",\n".join([
        term_counts(f"terms_{name}", f"chunks_{size}", "chunkId", "text"),
        term_counts(f"asked_{name}", "(SELECT 'Q' || item_id AS id, text FROM benchmark)", "id",
                    "text"),
        f"""ranked_{name} AS (
  SELECT queryId, chunkId, cosine,
    row_number() OVER (PARTITION BY queryId ORDER BY cosine DESC, chunkId) AS rank
  FROM (
    SELECT a.k AS queryId, t.k AS chunkId, sum(a.n * t.n)::DOUBLE
      / sqrt(any_value(c.nn)::DOUBLE * any_value(q.nn)::DOUBLE) AS cosine
    FROM asked_{name} a JOIN terms_{name} t ON a.b = t.b
    JOIN (SELECT k, sum(n * n) AS nn FROM terms_{name} GROUP BY 1) c ON c.k = t.k
    JOIN (SELECT k, sum(n * n) AS nn FROM asked_{name} GROUP BY 1) q ON q.k = a.k
    GROUP BY 1, 2))""",
        f"""{name} AS (
  SELECT r.queryId, r.rank, c.chunkId, c.documentId, c.title, c.source, c.sourceUrl, c.category,
    c.chunkIndex, c.text, r.cosine, (1.0 + r.cosine) / 2.0 AS score
  FROM ranked_{name} r JOIN chunks_{size} c ON c.chunkId = r.chunkId WHERE r.rank <= 5)""",
    ])


FOUND = (DOCS, C800, top5(800, "found"))
FOUND_300 = (DOCS, C300, top5(300, "found300"))

RUN_LOG = """run_log AS (
  SELECT event_id, user_id, event_type, value, round(value * 100)::BIGINT AS ms,
    CASE WHEN event_type = 'error' THEN
      '{"error":{"code":' || CASE WHEN k < 30 THEN '429' WHEN k < 60 THEN '503' ELSE '400' END
      || ',"message":"' || CASE WHEN k % 2 = 0 THEN 'Quota exceeded for user '
      ELSE 'Request failed for user ' END || repeat(user_id || ' ', 60) || '"}}' END AS message
  FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events))"""

NO_CONTEXT = "Nothing that was found helps here: it does not provide enough information for an answer."

RECORDS = f"""lists AS (
  SELECT queryId AS id, list({{'chunkId': chunkId, 'documentId': documentId, 'title': title,
    'sourceUrl': sourceUrl, 'score': score, 'text': text}} ORDER BY rank) AS r
  FROM found GROUP BY 1),
said AS (
  SELECT f.queryId AS id, CASE WHEN f.cosine < 0.8 THEN '{NO_CONTEXT}' ELSE f.text END AS answer,
    l.ms AS retrievalMs, l.ms * 7 AS generationMs
  FROM found f JOIN run_log l ON f.queryId = 'Q' || l.event_id WHERE f.rank = 1),
cited AS (
  SELECT id, list({{'title': title, 'sourceUrl': sourceUrl, 'documentId': documentId,
    'score': score}} ORDER BY rank) AS c
  FROM (SELECT queryId AS id, title, sourceUrl, documentId, score, rank,
          row_number() OVER (PARTITION BY queryId, documentId ORDER BY score DESC, rank) AS n
        FROM found) WHERE n = 1 GROUP BY 1),
records AS (
  SELECT q.id, q.question, s.answer, l.r AS retrieved,
    contains(lower(s.answer), 'does not provide enough information') AS insufficient,
    CASE WHEN contains(lower(s.answer), 'does not provide enough information')
      THEN [] ELSE c.c END AS citations,
    s.retrievalMs, s.generationMs, s.retrievalMs + s.generationMs AS totalMs
  FROM (SELECT 'Q' || item_id AS id, text AS question FROM benchmark) q
  JOIN lists l ON l.id = q.id JOIN said s ON s.id = q.id JOIN cited c ON c.id = q.id)"""

RESULTS = """results AS (
  SELECT q.id, q.category, q.scope, q.question, q.groundTruth, q.expectedSource,
    q.expectedSourceUrl, q.position,
    CASE WHEN f.id IS NULL THEN r.answer END AS generatedAnswer,
    CASE WHEN f.id IS NULL THEN r.insufficient END AS insufficient,
    CASE WHEN f.id IS NULL THEN r.retrieved ELSE [] END AS retrieved,
    CASE WHEN f.id IS NULL THEN r.citations ELSE [] END AS citations,
    CASE WHEN f.id IS NULL THEN r.retrievalMs END AS retrievalLatencyMs,
    CASE WHEN f.id IS NULL THEN r.generationMs END AS generationLatencyMs,
    CASE WHEN f.id IS NULL THEN r.totalMs ELSE f.ms END AS totalLatencyMs,
    CASE WHEN f.id IS NULL THEN 'success' ELSE 'error' END AS status,
    f.message
  FROM questions q LEFT JOIN records r ON r.id = q.id
  LEFT JOIN (SELECT 'Q' || event_id AS id, ms, message FROM run_log WHERE message IS NOT NULL) f
    ON f.id = q.id)"""

ALL_RECORDS = (*FOUND, RUN_LOG, RECORDS)
ALL_RESULTS = (*FOUND, RUN_LOG, RECORDS, QUESTIONS, RESULTS)
IDS = "list_transform({}, lambda c: c.documentId)"
OK = "status = 'success'"
IN = f"({OK} AND scope = 'in_scope')"
OUT = f"({OK} AND scope = 'out_of_scope')"


def hit(k: int, retrieved: str = "retrieved") -> str:
    return f"list_contains({IDS.format(f'{retrieved}[1:{k}]')}, expectedSource)"


# --- corpus ----------------------------------------------------------------------------
CORPUS = """picked AS (
  SELECT 'doc-' || p_partkey AS id, p_name AS title, p_brand AS category,
    'https://corpus.example/part/' || p_partkey AS url FROM part),
raw AS (SELECT 'doc-' || doc_id AS id, text FROM documents)"""
MANIFEST = f"""manifest AS (
  SELECT p.id, p.title, 'corpus' AS source, p.url AS sourceUrl,
    'data/raw/' || p.id || '.txt' AS file, p.category,
    len(string_split(r.text, {NL})) AS lines, length(r.text) AS chars,
    length({trim('r.text')}) < 100 AS short
  FROM picked p JOIN raw r ON r.id = p.id)"""

SQL["corpus_missing"] = with_(
    CORPUS, select="SELECT id, title FROM picked WHERE id NOT IN (SELECT id FROM raw)")
SQL["corpus_selected"] = with_(
    CORPUS,
    select="SELECT p.id, p.title, length(r.text) AS chars FROM picked p JOIN raw r ON r.id = p.id")
SQL["corpus_short"] = (
    f"SELECT 'doc-' || doc_id AS id, length({trim('text')}) < 100 AS short FROM documents")
SQL["corpus_manifest"] = with_(CORPUS, MANIFEST, select="SELECT * FROM manifest")
SQL["corpus_manifest_saved"] = with_(
    CORPUS, MANIFEST,
    select="SELECT id, title, source, sourceUrl, file, category FROM manifest")
SQL["corpus_report"] = with_(CORPUS, MANIFEST, select=f"""
SELECT count(*) AS selected, count(m.id) AS copied, count(*) - count(m.id) AS missing,
  count(*) FILTER (m.short) AS short, coalesce(sum(m.chars), 0)::BIGINT AS total_chars,
  ({half_up('avg(m.chars)', 1)})::BIGINT AS average_chars, count(m.id) >= 20 AS enough
FROM picked p LEFT JOIN manifest m ON m.id = p.id""")

RAW = f"""marked AS (
  SELECT 'doc-' || doc_id AS id, CASE WHEN lang = 'es'
    THEN '.. note::' || {NL} || '   ' || replace(text, {NL}, {NL} || '   ') || {NL}
    ELSE replace('.. meta::~   :keywords: ' || lang || '~~.. _' || source || ':~~=====~ '
      || source || ' page~=====~~.. default-domain:: corpus~~See :ref:`the ' || lang
      || ' index <idx-' || source || '>` and :doc:`/' || source || '`, ``' || source
      || '`` or |' || lang || '| {{+name+}}.~~Body~----~~.. note::~   :class: x~~   not kept~~'
      || '.. code-block:: text~~     kept code~~.. include:: /x.rst~~', '~', {NL})
      || text || replace('~~  .. tip:: orphan~- .. include:: /y.rst~.. closing comment~', '~', {NL})
    END AS rawText
  FROM documents)""".replace("{{", "{").replace("}}", "}")

_BODY = r"(?:[ \t]+[^\n]*\n|\n)*"
_NAME = r"[a-zA-Z][a-zA-Z0-9_-]*"
_DECO = "(?:" + "|".join(
    "".join(f"[{c}]" if c != "^" else r"\^" for _ in range(3)) + (f"[{c}]*" if c != "^" else r"\^*")
    for c in "=-~^.`'\"#*+_") + ")" + SPACE + "*$"


def _sub(x: str, pattern: str, to: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{to}', 'g')"


def _rules(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = _sub(x, p)
    return x


_FIRST = [rf"(?m)^\.\.{SPACE}+{n}::[^\n]*\n{_BODY}" for n in fv.BLOCK_DIRECTIVES] + [
    rf"(?m)^\.\.{SPACE}+default-domain::[^\n]*\n",
    rf"(?m)^[ \t]*\.\.{SPACE}+include::[^\n]*\n",
    rf"(?m)^\.\.{SPACE}+_[a-zA-Z0-9_-]+:{SPACE}*\n",
]
_LAST = [
    rf"(?m)^\.\.{SPACE}+{_NAME}::[^\n]*\n{_BODY}",
    rf"(?m)^[ \t]+\.\.{SPACE}+{_NAME}::[^\n]*\n",
    rf"(?m)^[ \t]*[-*]{SPACE}+\.\.{SPACE}+include::[^\n]*\n",
    # a comment: two dots and a blank, then no "name::"
    r"(?m)^[ \t]*\.\. (?:[^_a-zA-Z\s][^\n]*|[_a-zA-Z][a-zA-Z0-9_-]*(?:[^a-zA-Z0-9_:\n-][^\n]*"
    r"|:[^:\n][^\n]*|:)?)?\n",
    rf"(?m)^\.\.{SPACE}+{_NAME}::[^\n]*\n{_BODY}",
]
_DECO_SQL = _DECO.replace("'", "''")


def _deco(x: str) -> str:
    return f"regexp_matches({x}, '^{_DECO_SQL}')"


_TITLES = f"""array_to_string(list_reduce(range(1, len(ls) + 1), lambda a, i: CASE
      WHEN a.skip > 0 THEN {{'o': a.o, 'skip': a.skip - 1}}
      WHEN {_deco('ls[i]')} AND i + 2 <= len(ls) AND {trim('ls[i + 1]')} <> ''
           AND {_deco('ls[i + 2]')} THEN {{'o': list_append(a.o, {trim('ls[i + 1]')}), 'skip': 2}}
      WHEN {_deco('ls[i]')} AND len(a.o) > 0 AND {trim('a.o[-1]')} <> '' AND NOT {_deco('a.o[-1]')}
           THEN {{'o': a.o, 'skip': 0}}
      ELSE {{'o': list_append(a.o, ls[i]), 'skip': 0}}
      END, {{'o': []::VARCHAR[], 'skip': 0::BIGINT}}).o, {NL})"""


def _inline(x: str) -> str:
    x = _sub(x, rf":{_NAME}:`([^`<>]+){SPACE}+<[^`>]+>`", r"\1")
    x = _sub(x, rf":{_NAME}:`([^`]+)`", r"\1")
    x = _sub(x, r"``([^`]+)``", r"\1")
    x = _sub(x, rf"\|{_NAME}\|")
    return _sub(x, rf"\{{\+[a-zA-Z](?:[a-zA-Z0-9_+-]|{SPACE})*\+\}}")


def _collapse(x: str) -> str:
    x = _sub(x, rf"(?m)^{IN_LINE}{{3,}}")
    return trim(f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')")


_CODE = f"regexp_replace(t, '(?m)^\\.\\.{SPACE}+code-block::[^\\n]*\\n', {NL}, 'g')"
CLEANED = f"""known AS (
  SELECT 'doc-' || vec_id AS id, 'Document ' || vec_id AS title, 'corpus' AS source,
    'https://corpus.example/' || vec_id AS sourceUrl,
    'data/raw/doc-' || vec_id || '.txt' AS file, 'label-' || label AS category FROM embeddings),
step1 AS (SELECT id, rawText, string_split({_rules('rawText', _FIRST)}, {NL}) AS ls FROM marked),
step2 AS (SELECT id, rawText, {_TITLES} AS t FROM step1),
step3 AS (SELECT id, rawText, {_inline(_CODE)} AS t FROM step2),
step4 AS (SELECT id, rawText, {_rules('t', _LAST)} AS t FROM step3),
cleaned AS (
  SELECT s.id, s.rawText, k.title, k.source, k.sourceUrl, k.category,
    coalesce(k.file, s.id || '.txt') AS file,
    CASE WHEN k.id IS NOT NULL THEN {_collapse('s.t')} END AS text,
    CASE WHEN k.id IS NULL THEN 'no manifest entry'
         WHEN {_collapse('s.t')} = '' THEN 'empty after cleaning' END AS reason
  FROM step4 s LEFT JOIN known k ON k.id = s.id)"""


def title_of(text: str, fallback: str) -> str:
    lines = f"list_filter(string_split({text}, {NL}), lambda l: {trim('l')} <> '')"
    return f"coalesce({trim(f'{lines}[1]')}, {fallback})"


SQL["clean_corpus"] = with_(RAW, CLEANED, select=f"""
SELECT id AS "documentId", title, {title_of('text', 'title')} AS "extractedTitle", source,
  sourceUrl AS "sourceUrl", category, file AS "originalFile", text
FROM cleaned WHERE reason IS NULL""")
SQL["parse_rejects"] = with_(
    RAW, CLEANED, select="SELECT file, reason FROM cleaned WHERE reason IS NOT NULL")
SQL["parse_report"] = with_(RAW, CLEANED, select=f"""
SELECT count(*) AS raw, count(n) AS processed, count(*) - count(n) AS failed,
  count(*) FILTER (n < 500) AS short, ({half_up('avg(n)', 1)})::BIGINT AS average_chars,
  min(n) AS min_chars,
  (list(id ORDER BY n, id) FILTER (n IS NOT NULL))[1] AS min_id,
  max(n) AS max_chars,
  (list(id ORDER BY n DESC, id) FILTER (n IS NOT NULL))[1] AS max_id, count(n) >= 20 AS enough
FROM (SELECT id, CASE WHEN reason IS NULL THEN length(text) END AS n FROM cleaned)""")
SQL["clean_effect"] = with_(RAW, CLEANED, select=f"""
SELECT id AS "documentId", length(rawText) AS raw_chars, length(text) AS clean_chars,
  ({half_up('(1.0 - length(text)::DOUBLE / length(rawText)) * 100', 1)})::BIGINT AS reduction_percent,
  regexp_replace(left(text, 400), '\\n+', ' ', 'g') AS preview
FROM cleaned WHERE reason IS NULL""")
SQL["extract_title"] = with_(DOCS, select=f"""
SELECT documentId AS "documentId", {title_of('text', 'title')} AS "extractedTitle" FROM docs""")
_spaced = (f"{NL} || ' ' || {NL} || {NL} || "
           f"replace(text, ' ', {NL} || '    ' || {NL} || {NL})")
SQL["clean_collapse"] = with_(
    DOCS, select=f'SELECT documentId AS "documentId", {_collapse(f"({_spaced})")} AS text FROM docs')
_roles = ("':ref:`' || category || ' page <' || source || '>` :doc:`' || documentId || '` ``' "
          "|| source || '`` |' || category || '| {+a b+} ' || text")
SQL["strip_roles"] = with_(
    DOCS, select=f'SELECT documentId AS "documentId", {_inline(f"({_roles})")} AS text FROM docs')

# --- chunks --------------------------------------------------------------------------------
for _size, _cte in ((800, C800), (300, C300)):
    SQL[f"chunk_{_size}"] = with_(DOCS, _cte, select=(
        'SELECT documentId AS "documentId", chunkIndex AS "chunkIndex", text '
        f"FROM chunks_{_size}"))
SQL["chunk_rows"] = with_(DOCS, C800, select="SELECT * FROM chunks_800")
SQL["chunk_doc_stats"] = with_(DOCS, C800, select=f"""
SELECT d.documentId AS "documentId", length(any_value(d.text)) AS doc_len, count(*) AS num_chunks,
  min(length(c.text)) AS min_len, max(length(c.text)) AS max_len,
  ({half_up('avg(length(c.text))', 1)})::BIGINT AS avg_len
FROM docs d JOIN chunks_800 c ON c.documentId = d.documentId GROUP BY 1""")
SQL["chunk_report"] = with_(DOCS, C800, select=f"""
SELECT (SELECT count(*) FROM docs) AS documents, count(*) AS chunks,
  {half_up('count(*)::DOUBLE / (SELECT count(*) FROM docs)', 10)} AS chunks_per_document,
  ({half_up('avg(length(text))', 1)})::BIGINT AS avg_len,
  min(length(text)) AS min_len, (list(chunkId ORDER BY length(text), chunkId))[1] AS min_chunk,
  max(length(text)) AS max_len,
  (list(chunkId ORDER BY length(text) DESC, chunkId))[1] AS max_chunk, 200 AS tokens_per_chunk
FROM chunks_800""")
SQL["chunk_overlap_check"] = with_(DOCS, C800, select=f"""
SELECT documentId AS "documentId", chunkIndex AS "chunkIndex",
  contains(left(following, 150), {trim('left(right(text, 100), 30)')}) AS overlap_found
FROM (SELECT *, lead(text) OVER (PARTITION BY documentId ORDER BY chunkIndex) AS following
      FROM chunks_800) WHERE following IS NOT NULL""")
SQL["chunk_first_rows"] = with_(DOCS, C800, select="""
SELECT chunkId AS "chunkId" FROM chunks_800 ORDER BY documentId, chunkIndex LIMIT 200""")

# --- embedding and vector tables ---------------------------------------------------------------
SQL["embed_hashed"] = with_(
    DOCS, C800, term_counts("terms", "chunks_800", "chunkId", "text"),
    select='SELECT k AS "chunkId", b AS bucket, n FROM terms')
SQL["embed_batches"] = with_(DOCS, C800, select="""
SELECT (number - 1) // 50 + 1 AS batch, ceil(any_value(n) / 50.0)::BIGINT AS n_batches,
  min(number) AS first_chunk, max(number) AS last_chunk,
  string_agg(chunkId, ',' ORDER BY number) AS "chunkIds"
FROM (SELECT chunkId, count(*) OVER () AS n,
        row_number() OVER (ORDER BY documentId, chunkIndex) AS number FROM chunks_800)
GROUP BY 1""")

VECTORS = f"""vector_records AS (
  SELECT e.chunkId, e.text, v.embedding FROM (
    SELECT doc_id, 'doc-' || doc_id AS chunkId, text FROM documents
    UNION ALL
    SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN 'doc-' || d.doc_id END,
      CASE WHEN l.quality = 0 THEN ' ' || {NL} || chr(9) || ' ' ELSE d.text END
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id) e
  LEFT JOIN embeddings v ON v.vec_id = e.doc_id),
stored AS (SELECT * FROM vector_records WHERE chunkId IS NOT NULL)"""
SQL["embed_rejects"] = with_(VECTORS, select=f"""
SELECT chunkId AS "chunkId", 'empty text' AS error FROM vector_records WHERE {trim('text')} = ''""")
SQL["embed_failures"] = with_(VECTORS, select=f"""
SELECT chunkId AS "chunkId",
  CASE WHEN {trim('text')} = '' THEN 'empty text' ELSE 'text refused' END AS error
FROM stored WHERE {trim('text')} = '' OR length(text) > 5000
  OR NOT regexp_matches(lower(text), '[a-z]')""")
SQL["embed_todo"] = with_(VECTORS, select="""
SELECT 'doc-' || doc_id AS "chunkId" FROM documents
WHERE 'doc-' || doc_id NOT IN (SELECT chunkId FROM stored WHERE len(embedding) > 0)""")
_DIM = "CASE WHEN len(embedding) > 0 THEN len(embedding) END"
SQL["dim_check"] = with_(VECTORS, select=f"""
SELECT count(DISTINCT d) AS dimensions, min(d) AS min_dim, max(d) AS max_dim,
  count(DISTINCT d) = 1 AS consistent FROM (SELECT {_DIM} AS d FROM vector_records)""")
SQL["dim_counts"] = with_(VECTORS, select=f"""
SELECT {_DIM} AS dimension, count(*) AS n FROM vector_records WHERE len(embedding) > 0 GROUP BY 1""")
SQL["dup_ids"] = with_(VECTORS, select="""
SELECT count(*) AS total, count(DISTINCT chunkId) AS unique_ids,
  count(*) - count(DISTINCT chunkId) AS duplicate_rows FROM stored""")
SQL["dup_groups"] = with_(VECTORS, select="""
SELECT count(*) AS duplicates
FROM (SELECT chunkId FROM stored GROUP BY 1 HAVING count(*) > 1)""")
SQL["validate_input"] = with_(VECTORS, select=f"""
SELECT NULL AS id, 'missing id' AS rule, count(*) AS n FROM vector_records
WHERE chunkId IS NULL HAVING count(*) > 0
UNION ALL
SELECT chunkId, 'duplicate id', count(*) - 1 FROM stored GROUP BY 1 HAVING count(*) > 1
UNION ALL
SELECT chunkId, 'missing vector', count(*) FROM stored
WHERE embedding IS NULL OR len(embedding) = 0 GROUP BY 1
UNION ALL
SELECT chunkId, 'blank text', count(*) FROM stored WHERE {trim('text')} = '' GROUP BY 1""")
SQL["store_check"] = with_(VECTORS, select=f"""
SELECT count(*) AS total, count(*) FILTER (embedding IS NULL OR len(embedding) = 0) AS missing_vectors,
  count(DISTINCT chunkId) AS unique_ids,
  (SELECT count(*) FROM (SELECT 1 FROM stored GROUP BY chunkId HAVING count(*) > 1)) AS duplicates,
  min({_DIM}) AS min_dim, max({_DIM}) AS max_dim FROM stored""")
SQL["store_verdict"] = """
SELECT count(*) > 0 AS count_ok, count(*) FILTER (embedding IS NULL) = 0 AS no_missing,
  count(*) = count(DISTINCT vec_id) AS no_duplicates,
  bool_and(len(embedding) = 64) AS dimension_ok,
  count(*) > 0 AND count(*) FILTER (embedding IS NULL) = 0 AND count(*) = count(DISTINCT vec_id)
    AND bool_and(len(embedding) = 64) AS passed FROM embeddings"""
SQL["store_sample"] = """
SELECT vec_id, label, len(embedding) AS dimension, round(embedding[1]::DOUBLE, 6) AS first_value
FROM embeddings WHERE len(embedding) > 0 ORDER BY vec_id LIMIT 1"""
SQL["chunk_file_check"] = with_(DOCS, C800, select=f"""
SELECT count(*) AS n_chunks, count(DISTINCT chunkId) AS unique_ids,
  count(*) - count(DISTINCT chunkId) AS duplicate_ids,
  count(*) FILTER ({trim('text')} = '') AS empty_text,
  count(*) FILTER (chunkSize <> 800 OR overlap <> 100) AS wrong_config,
  count(*) = count(DISTINCT chunkId) AND count(*) FILTER ({trim('text')} = '') = 0
    AND count(*) FILTER (chunkSize <> 800 OR overlap <> 100) = 0 AS ok
FROM chunks_800""")
SQL["vector_file_check"] = with_(VECTORS, select=f"""
SELECT count(*) AS n_rows, CASE WHEN count(DISTINCT {_DIM}) = 1 THEN max({_DIM}) END AS dimension,
  count(*) - count(DISTINCT chunkId) AS duplicate_ids,
  count(*) FILTER (embedding IS NULL) AS missing_vectors,
  count(DISTINCT {_DIM}) = 1 AS consistent FROM stored""")

SQL["vector_complete"] = with_(VECTORS, select=f"""
SELECT *, n_rows = (SELECT count(*) FROM documents) AND duplicate_ids = 0 AND missing_vectors = 0 AND consistent AS complete
FROM (SELECT count(*) AS n_rows, CASE WHEN count(DISTINCT {_DIM}) = 1 THEN max({_DIM}) END AS dimension,
  count(*) - count(DISTINCT chunkId) AS duplicate_ids,
  count(*) FILTER (embedding IS NULL) AS missing_vectors, count(DISTINCT {_DIM}) = 1 AS consistent
  FROM stored)""")

# --- store ------------------------------------------------------------------------------------
UPDATES = (DOCS, C800, """good AS (
  SELECT * FROM docs WHERE documentId IN (SELECT 'doc-' || doc_id FROM labels WHERE quality = 1))""",
           chunks(300, 50, "good", "updates"))
SQL["upsert_chunks"] = with_(*UPDATES, select="""
SELECT chunkId AS "chunkId", chunkIndex AS "chunkIndex", text, chunkSize AS "chunkSize", overlap
FROM chunks_800 WHERE chunkId NOT IN (SELECT chunkId FROM updates)
UNION ALL SELECT chunkId, chunkIndex, text, chunkSize, overlap FROM updates""")
SQL["upsert_counts"] = with_(*UPDATES, select="""
SELECT count(*) FILTER (c.chunkId IS NULL) AS inserted, count(c.chunkId) AS matched,
  count(*) FILTER (c.chunkId IS NOT NULL AND (c.text <> u.text OR c.chunkSize <> u.chunkSize)) AS replaced
FROM updates u LEFT JOIN chunks_800 c ON c.chunkId = u.chunkId""")
SQL["experiment_swap"] = with_(*UPDATES, C300, select="""
SELECT 'chunk-300' AS experiment, o.n AS count_before, o.n AS deleted, w.n AS inserted,
  w.n AS count_after
FROM (SELECT count(*) AS n FROM chunks_300) o, (SELECT count(*) AS n FROM updates) w
UNION ALL SELECT 'chunk-800', count(*), 0, 0, count(*) FROM chunks_800""")

# --- retrieval ----------------------------------------------------------------------------------
SQL["topk_cosine"] = """
WITH cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
centroids AS (
  SELECT label, list(m ORDER BY pos) AS v
  FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
ranked AS (
  SELECT c.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS cosine
  FROM centroids c, embeddings e)
SELECT label, rank, vec_id, round(cosine, 6) AS cosine, round((1.0 + cosine) / 2.0, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank
      FROM ranked) WHERE rank <= 5"""
SQL["topk_lsh"] = """
WITH cells AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
centroids AS (
  SELECT label, list(m ORDER BY pos) AS v
  FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
planes AS (
  SELECT b, j, list(CASE WHEN substr(md5(b || ':' || j || ':' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END
                    ORDER BY d) AS plane
  FROM range(12) AS t(b), range(10) AS u(j), range(64) AS v(d) GROUP BY 1, 2),
asked AS (
  SELECT label, b, sum(CASE WHEN list_dot_product(list_transform(v, lambda x: floor(1024 * x)), plane) >= 0
                       THEN 1 << j ELSE 0 END)::INTEGER AS key FROM centroids, planes GROUP BY 1, 2),
stored AS (
  SELECT vec_id, b, sum(CASE WHEN list_dot_product(
           list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)), plane) >= 0
         THEN 1 << j ELSE 0 END)::INTEGER AS key FROM embeddings, planes GROUP BY 1, 2),
met AS (
  SELECT DISTINCT a.label, s.vec_id FROM asked a JOIN stored s ON a.b = s.b
  WHERE bit_count(xor(a.key, s.key)) <= 2),
ranked AS (
  SELECT m.label, m.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS cosine
  FROM met m JOIN centroids c ON c.label = m.label JOIN embeddings e ON e.vec_id = m.vec_id)
SELECT label, rank, vec_id, round(cosine, 6) AS cosine, round((1.0 + cosine) / 2.0, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank
      FROM ranked) WHERE rank <= 5"""
SQL["retrieve_all"] = with_(*FOUND, select="""
SELECT queryId AS "queryId", rank, chunkId AS "chunkId", documentId AS "documentId", title, source,
  sourceUrl AS "sourceUrl", category, chunkIndex AS "chunkIndex", text,
  round(cosine, 6) AS cosine, round(score, 6) AS score FROM found""")
SQL["retrieve_300"] = with_(*FOUND_300, select="""
SELECT queryId AS "queryId", rank, chunkId AS "chunkId", documentId AS "documentId",
  round(score, 6) AS score FROM found300""")
SQL["question_filter"] = f"""
SELECT conv_id, turn, question, {trim('question')} <> '' AS kept
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE ' ' || {NL} || ' ' END AS question
      FROM conversations)"""

# --- contexts, citations, answers -----------------------------------------------------------------
_CONTEXT = (f"string_agg('[' || rank || '] Source: ' || title || {NL} || text, "
            f"{NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank)")
SQL["build_context"] = with_(*FOUND, select=f"""
SELECT queryId AS id, {_CONTEXT} AS context FROM found GROUP BY 1""")
SQL["build_prompt"] = with_(*FOUND, select=f"""
SELECT f.queryId AS id, 'Answer from the excerpts.' || {NL} || {NL}
  || '--- Documentation Context ---' || {NL} || {_CONTEXT.replace("text,", "f.text,")}
  || {NL} || {NL} || '--- Question ---' || {NL} || any_value(b.text) AS prompt
FROM found f JOIN benchmark b ON f.queryId = 'Q' || b.item_id GROUP BY 1""")
SQL["citations"] = with_(*FOUND, select="""
SELECT queryId AS "queryId", row_number() OVER (PARTITION BY queryId ORDER BY score DESC, rank) AS place,
  title, sourceUrl AS "sourceUrl", documentId AS "documentId", round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY queryId, documentId ORDER BY score DESC, rank) AS n
      FROM found) WHERE n = 1""")
SQL["insufficient"] = f"""
SELECT conv_id, turn, contains(lower(CASE WHEN turn % 3 = 0 THEN text || ' {NO_CONTEXT.upper()}'
  ELSE text END), 'does not provide enough information') AS insufficient FROM conversations"""
SQL["answer_records"] = with_(*ALL_RECORDS, select=f"""
SELECT id, question, answer, insufficient, array_to_string({IDS.format('citations')}, ',') AS cited,
  array_to_string(list_transform(retrieved, lambda c: c.chunkId), ',') AS retrieved,
  retrievalMs AS "retrievalMs", generationMs AS "generationMs", totalMs AS "totalMs" FROM records""")
SQL["public_response"] = with_(*ALL_RECORDS, select="""
SELECT answer, array_to_string(list_transform(citations, lambda c: c.sourceUrl), ',') AS citations,
  insufficient, retrievalMs AS "retrievalMs", generationMs AS "generationMs", totalMs AS "totalMs"
FROM records""")
SQL["answer_lines"] = f"""
SELECT id, n AS line_no, lines[n] AS line FROM (
  SELECT id, lines, unnest(range(1, len(lines) + 1)) AS n FROM (
    SELECT conv_id || '-' || turn AS id,
      list_filter(string_split(text, {NL}), lambda l: {trim('l')} <> '') AS lines
    FROM conversations WHERE role = 'assistant'))"""
SQL["citation_grounding"] = with_(*ALL_RECORDS, select="""
SELECT id, citations[1].sourceUrl || '/gone' AS "sourceUrl" FROM records
WHERE len(citations) > 0 AND length(answer) > 700""")
SQL["citation_dups"] = with_(*ALL_RECORDS, select="""
SELECT id, citations[1].documentId AS "documentId" FROM records WHERE len(citations) > 0""")
SQL["case_check"] = with_(*ALL_RECORDS, QUESTIONS, select="""
SELECT id, concat_ws('; ',
    CASE WHEN has AND cited = 0 THEN 'citations expected, none given' END,
    CASE WHEN NOT has AND cited > 0 THEN 'no citations expected, some given' END,
    CASE WHEN NOT has AND NOT insufficient THEN 'insufficient expected' END,
    CASE WHEN has AND insufficient THEN 'insufficient not expected' END) AS failures,
  (has AND cited > 0 AND NOT insufficient) OR (NOT has AND cited = 0 AND insufficient) AS passed
FROM (SELECT r.id, q.scope = 'in_scope' AS has, r.insufficient, len(r.citations) AS cited
      FROM records r JOIN questions q ON q.id = r.id)""")

# --- runs ----------------------------------------------------------------------------------------
RUNS = """asked AS (
  SELECT 'Q' || c_custkey AS id, c_mktsegment AS category, c_name AS question,
    c_custkey AS position FROM customer),
earlier AS (
  SELECT 'Q' || user_id AS id, event_id AS attempt, value,
    CASE WHEN event_type = 'purchase' AND value > 100 THEN 'success' ELSE 'error' END AS status
  FROM events),
done AS (
  SELECT * EXCLUDE n FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS n
    FROM earlier WHERE status = 'success') WHERE n = 1),
todo AS (SELECT * FROM asked WHERE id NOT IN (SELECT id FROM done)),
fresh AS (
  SELECT 'Q' || o_custkey AS id, o_orderkey AS attempt, o_totalprice AS value,
    CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
  WHERE n = 1 AND 'Q' || o_custkey IN (SELECT id FROM todo))"""
SQL["resume_todo"] = with_(RUNS, select="SELECT * FROM todo")
SQL["resume_start"] = with_(RUNS, select="""
SELECT * FROM todo WHERE position >= (SELECT position FROM asked WHERE id = 'Q50')
ORDER BY position LIMIT 40""")
SQL["completed_results"] = with_(RUNS, select="SELECT * FROM done")
SQL["merge_results"] = with_(RUNS, select="""
SELECT r.id, r.attempt, r.status, r.value, a.position, r.is_new
FROM (SELECT *, 0 AS is_new FROM done UNION ALL BY NAME SELECT *, 1 AS is_new FROM fresh) r
JOIN asked a ON a.id = r.id""")
_CODE_OF = "TRY_CAST(nullif(regexp_extract({}, '\"code\":(\\d+)', 1), '') AS BIGINT)"
SQL["error_code"] = with_(RUN_LOG, select=f"""
SELECT event_id, {_CODE_OF.format("coalesce(message, 'no code')")} AS code,
  left(coalesce(message, 'no code'), 200) AS message FROM run_log""")
SQL["error_class"] = with_(RUN_LOG, select=f"""
SELECT event_id, {_CODE_OF.format('message')} AS code,
  contains(message, '429') OR contains(lower(message), 'quota') AS quota,
  regexp_matches(message, '429|500|502|503|504') AS transient
FROM run_log WHERE message IS NOT NULL""")
SQL["run_summary"] = with_(RUNS, select="""
SELECT *, previously_done + run_success + run_errors AS completed,
  total - previously_done - run_success - run_errors AS remaining
FROM (SELECT (SELECT count(*) FROM asked) AS total, (SELECT count(*) FROM done) AS previously_done,
  (SELECT count(*) FROM fresh WHERE status = 'success') AS run_success,
  (SELECT count(*) FROM fresh WHERE status = 'error') AS run_errors)""")
SQL["evaluation_results"] = with_(*ALL_RESULTS, select=f"""
SELECT id, category, scope, expectedSource AS "expectedSource",
  expectedSourceUrl AS "expectedSourceUrl", generatedAnswer AS "generatedAnswer", insufficient,
  retrievalLatencyMs AS "retrievalLatencyMs", generationLatencyMs AS "generationLatencyMs",
  totalLatencyMs AS "totalLatencyMs", status,
  array_to_string(list_transform(retrieved, lambda c: c.chunkId), ',') AS retrieved,
  array_to_string({IDS.format('citations')}, ',') AS cited,
  {_CODE_OF.format('message')} AS error_code, left(message, 200) AS error_message FROM results""")

# --- metrics ----------------------------------------------------------------------------------------
SQL["metrics_overview"] = with_(*ALL_RESULTS, select=f"""
SELECT total, completed, successful, failed, in_scope_completed, out_of_scope_completed,
  total - completed AS skipped, completed < total AS is_preliminary
FROM (SELECT (SELECT count(*) FROM benchmark) AS total, count(*) AS completed,
  count(*) FILTER ({OK}) AS successful, count(*) FILTER (status = 'error') AS failed,
  count(*) FILTER {IN} AS in_scope_completed, count(*) FILTER {OUT} AS out_of_scope_completed
  FROM results)""")
HITS = f"""hits AS (
  SELECT count(*) AS n, count(*) FILTER ({hit(1)}) AS hit1_raw, count(*) FILTER ({hit(3)}) AS hit3_raw,
    count(*) FILTER ({hit(5)}) AS hit5_raw FROM results WHERE {IN})"""
SQL["hit_at_k"] = with_(*ALL_RESULTS, HITS, select=(
    "SELECT *, " + ", ".join(f"{rate(f'hit{k}_raw', 'n')} AS hit{k}" for k in (1, 3, 5))
    + " FROM hits"))
SQL["hit_flags"] = with_(*ALL_RESULTS, select=(
    "SELECT id, " + ", ".join(f"{hit(k)} AS hit{k}" for k in (1, 3, 5)) + " FROM results"))
ANSWERED = f"({IN} AND NOT insufficient)"
PRECISION = f"""prec AS (
  SELECT {half_up('avg(share)')} AS precision, count(share) AS rows_with_citations FROM (
    SELECT len(list_filter({IDS.format('citations')},
      lambda d: list_contains({IDS.format('retrieved')}, d)))::DOUBLE / len(citations) AS share
    FROM results WHERE {ANSWERED} AND len(citations) > 0))"""
COVERAGE = f"""cov AS (
  SELECT count(*) FILTER (list_contains({IDS.format('citations')}, expectedSource)) AS coverage_hits,
    count(*) AS answered FROM results WHERE {ANSWERED})"""
OOS = f"""oos AS (
  SELECT count(*) FILTER (insufficient AND len(citations) = 0) AS correct, count(*) AS total
  FROM results WHERE {OUT})"""
SQL["citation_precision"] = with_(*ALL_RESULTS, PRECISION, select="SELECT * FROM prec")
SQL["citation_coverage"] = with_(
    *ALL_RESULTS, COVERAGE, select=f"SELECT *, {rate('coverage_hits', 'answered')} AS coverage FROM cov")
SQL["oos_rate"] = with_(
    *ALL_RESULTS, OOS, select=f"SELECT *, {rate('correct', 'total')} AS rate FROM oos")

_STOP = "[" + ", ".join(f"'{w}'" for w in fv.STOP_WORDS) + "]"


def words(x: str) -> str:
    # RE2 has an ASCII \b
    found = f"list_distinct(regexp_extract_all(lower({x}), '\\b[a-z]{{5,}}\\b'))"
    return f"list_filter({found}, lambda w: NOT list_contains({_STOP}, w))"


SQL["keywords"] = with_(DOCS, select=f"""
SELECT documentId AS "documentId", array_to_string(list_sort({words('text')}), ' ') AS keywords
FROM docs""")


def scored(source: str, keep: str) -> str:
    return f"""scored AS (
  SELECT {keep}, hits, total, CASE WHEN total > 0 THEN {half_up('hits::DOUBLE / total')} END AS score,
    CASE WHEN total = 0 THEN 'needs_manual_review' WHEN hits::DOUBLE / total >= 0.65 THEN 'correct'
      WHEN hits::DOUBLE / total >= 0.40 THEN 'partially_correct' ELSE 'incorrect' END AS label
  FROM (SELECT *, len(list_intersect(want, given)) AS hits, len(want) AS total
        FROM (SELECT *, {words('groundTruth')} AS want,
                {words("coalesce(generatedAnswer, '')")} AS given FROM {source})))"""


SQL["answer_score"] = with_("""pairs AS (
  SELECT a.conv_id, a.turn, u.text AS groundTruth, a.text AS generatedAnswer
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')""", scored("pairs", "conv_id, turn"),
    select="SELECT * FROM scored")
LABELS = scored(f"(SELECT * FROM results WHERE {IN})",
                "id, category, retrieved, expectedSource, insufficient") + """,
labelled AS (
  SELECT id, category, retrieved, expectedSource,
    CASE WHEN insufficient THEN 'needs_manual_review' ELSE label END AS label,
    CASE WHEN NOT insufficient THEN score END AS score,
    CASE WHEN NOT insufficient AND total > 0 THEN hits END AS hits,
    CASE WHEN NOT insufficient AND total > 0 THEN total END AS total
  FROM scored)"""
QUALITY = f"""quality AS (
  SELECT l.label, count(x.id) AS n, (SELECT count(*) FROM labelled) AS total,
    {rate('count(x.id)', '(SELECT count(*) FROM labelled)')} AS rate
  FROM (SELECT unnest(['correct', 'partially_correct', 'incorrect', 'needs_manual_review']) AS label) l
  LEFT JOIN labelled x ON x.label = l.label GROUP BY 1)"""
SQL["answer_labels"] = with_(
    *ALL_RESULTS, LABELS, select="SELECT id, label, score, hits, total FROM labelled")
SQL["answer_quality"] = with_(*ALL_RESULTS, LABELS, QUALITY, select="SELECT * FROM quality")


def stats(group: str, value: str) -> str:
    return (f"{group}, count(*) AS n, {half_up(f'sum({value})::DOUBLE / count(*)')} AS avg, "
            f"{half_up(f'quantile_cont({value}, 0.5)')} AS p50, "
            f"{half_up(f'quantile_cont({value}, 0.95)')} AS p95, "
            f"min({value}) AS min, max({value}) AS max")


LATENCY = f"""phases AS (
  SELECT 'retrieval' AS phase, retrievalLatencyMs AS ms FROM results WHERE {OK}
  UNION ALL SELECT 'generation', generationLatencyMs FROM results WHERE {OK}
  UNION ALL SELECT 'total', totalLatencyMs FROM results WHERE {OK}),
latency AS (SELECT {stats('phase', 'ms')} FROM phases WHERE ms IS NOT NULL GROUP BY 1)"""
SQL["latency_stats"] = with_(*ALL_RESULTS, LATENCY, select="SELECT * FROM latency")
SQL["latency_events"] = with_(
    RUN_LOG, select=f"SELECT {stats('event_type', 'ms')} FROM run_log GROUP BY 1")
CATEGORY = f"""categories AS (
  SELECT *, {rate('hit5_raw', 'questions')} AS hit5 FROM (
    SELECT category, count(*) AS questions, count(*) FILTER ({hit(5)}) AS hit5_raw, """ + ", ".join(
    f"count(*) FILTER (label = '{n}') AS {n}" for n in fv.ANSWER_LABELS) + """
    FROM labelled GROUP BY 1))"""
SQL["per_category"] = with_(*ALL_RESULTS, LABELS, CATEGORY, select="SELECT * FROM categories")


RAW_OF = {
    **{f"hit{k}": (f"hit{k}_raw", "n") for k in (1, 3, 5)}, "coverage": ("coverage_hits", "answered"),
    "out_of_scope_rate": ("out_of_scope_correct", "out_of_scope_total"), "rate": ("n", "total"),
}


def long(section: str, source: str, columns: list[str], prefix: str = "''") -> str:
    def raw(c: str) -> str:
        if c not in RAW_OF:
            return "NULL::VARCHAR"
        count, of = RAW_OF[c]
        return f"{count} || '/' || {'questions' if section == 'category' else of}"

    return "\nUNION ALL\n".join(
        f"SELECT '{section}' AS section, {prefix} || '{c}' AS metric, {c}::DOUBLE AS value, "
        f"{raw(c)} AS raw FROM {source}"
        for c in columns)


SQL["metrics_long"] = with_(
    *ALL_RESULTS, HITS, PRECISION, COVERAGE, OOS, LABELS, QUALITY, LATENCY, CATEGORY,
    f"""over AS (
  SELECT *, total - completed AS skipped FROM (
    SELECT (SELECT count(*) FROM questions) AS total, count(*) AS completed,
      count(*) FILTER ({OK}) AS successful, count(*) FILTER (status = 'error') AS failed,
      count(*) FILTER {IN} AS in_scope_completed, count(*) FILTER {OUT} AS out_of_scope_completed
    FROM results))""",
    f"""rates AS (SELECT *, {", ".join(f"{rate(f'hit{k}_raw', 'n')} AS hit{k}" for k in (1, 3, 5))}
  FROM hits)""",
    f"cov2 AS (SELECT *, {rate('coverage_hits', 'answered')} AS coverage FROM cov)",
    f"""oos2 AS (SELECT correct AS out_of_scope_correct, total AS out_of_scope_total,
  {rate('correct', 'total')} AS out_of_scope_rate FROM oos)""",
    select="\nUNION ALL\n".join([
        long("overview", "over", ["total", "completed", "successful", "failed", "skipped",
                                  "in_scope_completed", "out_of_scope_completed"]),
        long("retrieval", "rates", ["n", "hit1", "hit3", "hit5", "hit1_raw", "hit3_raw", "hit5_raw"]),
        long("citation", "prec", ["precision"]),
        long("citation", "cov2", ["coverage", "coverage_hits", "answered"]),
        long("citation", "oos2",
             ["out_of_scope_rate", "out_of_scope_correct", "out_of_scope_total"]),
        long("answers", "quality", ["n", "rate"], "label || '.'"),
        long("latency", "latency", ["n", "avg", "p50", "p95", "min", "max"], "phase || '.'"),
        long("category", "categories",
             ["questions", "hit5", "hit5_raw", *fv.ANSWER_LABELS], "category || '.'"),
    ]))

# --- experiments ------------------------------------------------------------------------------------------


def _experiment(name: str, found: str, factor: int, failed: str) -> str:
    return f"""SELECT '{name}' AS experiment, q.id, q.category, q.question, q.expectedSource,
    CASE WHEN l.event_id IS NULL OR NOT ({failed}) THEN coalesce(f.r, []) ELSE [] END AS retrieved,
    l.ms * {factor} AS latencyMs, CASE WHEN {failed} THEN 'failed' END AS error
  FROM questions q LEFT JOIN run_log l ON 'Q' || l.event_id = q.id
  LEFT JOIN (SELECT queryId, list({{'chunkId': chunkId, 'documentId': documentId, 'score': score}}
             ORDER BY rank) AS r FROM {found} GROUP BY 1) f ON f.queryId = q.id
  WHERE q.scope = 'in_scope'"""


EXPERIMENTS = (
    DOCS, C800, C300, top5(800, "found"), top5(300, "found300"), RUN_LOG, QUESTIONS,
    "rows_ AS (" + _experiment("chunk-300", "found300", 1, "l.event_type = 'error'")
    + "\nUNION ALL\n"
    + _experiment("chunk-800", "found", 2, "l.event_type = 'signup' AND l.ms > 5000") + ")",
    f"flagged AS (SELECT *, {', '.join(f'{hit(k)} AS hit{k}' for k in (1, 3, 5))} FROM rows_)",
)
EVALUATED = f"""evaluated AS (
  SELECT experiment, count(*) AS total, count(*) FILTER (error IS NULL) AS success,
    {', '.join(f'count(*) FILTER (hit{k}) AS hit{k}_raw' for k in (1, 3, 5))},
    {half_up("avg(latencyMs) FILTER (error IS NULL)")} AS latency_avg,
    {half_up("quantile_cont(latencyMs, 0.5) FILTER (error IS NULL)")} AS latency_p50,
    {half_up("quantile_cont(latencyMs, 0.95) FILTER (error IS NULL)")} AS latency_p95,
    min(latencyMs) FILTER (error IS NULL) AS latency_min,
    max(latencyMs) FILTER (error IS NULL) AS latency_max
  FROM flagged GROUP BY 1)"""
SQL["retrieval_eval"] = with_(*EXPERIMENTS, EVALUATED, select=(
    "SELECT *, " + ", ".join(
        f"{rate(f'hit{k}_raw', 'success')} AS hit{k}, {rate(f'hit{k}_raw', 'total')} AS hit{k}_of_total"
        for k in (1, 3, 5)) + " FROM evaluated"))
SQL["misses"] = with_(*EXPERIMENTS, select="""
SELECT experiment, id, left(question, 50) AS question, expectedSource AS "expectedSource",
  coalesce(retrieved[1].documentId, 'none') AS top_document FROM flagged WHERE NOT hit5""")
_METRICS = [(f"hit{k}", f"hit{k}_raw::DOUBLE / total * 100") for k in (1, 3, 5)] + [
    (f"latency_{c}", f"latency_{c}") for c in ("avg", "p50", "p95")]
SQL["exp_compare"] = with_(*EXPERIMENTS, EVALUATED, "cells AS (" + "\nUNION ALL\n".join(
    f"SELECT experiment, '{m}' AS metric, {x} AS v FROM evaluated" for m, x in _METRICS) + ")",
    select=f"""
SELECT metric, {half_up('a', 10)} AS first, {half_up('b', 10)} AS second,
  {half_up('a - b', 10)} AS difference
FROM (SELECT metric, max(v) FILTER (experiment = 'chunk-300') AS a,
        max(v) FILTER (experiment = 'chunk-800') AS b FROM cells GROUP BY 1)""")
SQL["exp_by_category"] = with_(*EXPERIMENTS, select=f"""
SELECT category, questions, first_hit5_raw, {rate('first_hit5_raw', 'questions')} AS first_hit5,
  second_hit5_raw, {rate('second_hit5_raw', 's')} AS second_hit5
FROM (SELECT category, count(*) FILTER (experiment = 'chunk-300') AS questions,
        count(*) FILTER (experiment = 'chunk-300' AND hit5) AS first_hit5_raw,
        count(*) FILTER (experiment = 'chunk-800') AS s,
        count(*) FILTER (experiment = 'chunk-800' AND hit5) AS second_hit5_raw
      FROM flagged GROUP BY 1)""")
SQL["exp_flips"] = with_(*EXPERIMENTS, select="""
SELECT a.id, a.hit1 AS first_hit1, a.hit5 AS first_hit5, b.hit1 AS second_hit1, b.hit5 AS second_hit5
FROM flagged a JOIN flagged b ON b.id = a.id
WHERE a.experiment = 'chunk-300' AND b.experiment = 'chunk-800'
  AND a.error IS NULL AND b.error IS NULL AND (a.hit1 <> b.hit1 OR a.hit5 <> b.hit5)""")
SQL["score_margin"] = with_(*EXPERIMENTS, select=f"""
SELECT experiment, id, expectedSource AS "expectedSource", retrieved[1].documentId AS top_document,
  round(retrieved[1].score, 6) AS top_score,
  nullif(list_position({IDS.format('retrieved')}, expectedSource), 0) AS expected_rank,
  round(best, 6) AS expected_score, round(retrieved[1].score - best, 6) AS margin
FROM (SELECT *, list_max(list_transform(list_filter(retrieved,
        lambda c: c.documentId = expectedSource), lambda c: c.score)) AS best FROM flagged)""")
SQL["failure_class"] = with_(*EXPERIMENTS, select="""
SELECT experiment, CASE WHEN error IS NOT NULL THEN 'error' WHEN hit1 THEN 'hit' WHEN hit5 THEN 'ranked_below' ELSE 'total_miss' END AS class,
  count(*) AS n FROM flagged GROUP BY 1, 2""")
SQL["topk_dominance"] = with_(*EXPERIMENTS, select="""
SELECT experiment, id, retrieved, documentId AS "documentId", chunks FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment, id ORDER BY chunks DESC, documentId) AS n
  FROM (SELECT experiment, id, n AS retrieved, d AS documentId, count(*) AS chunks
        FROM (SELECT experiment, id, len(retrieved) AS n, unnest(retrieved).documentId AS d FROM flagged)
        GROUP BY ALL)) WHERE n = 1""")
SQL["source_integrity"] = with_(QUESTIONS, select="""
SELECT id, expectedSource AS "expectedSource" FROM questions WHERE scope = 'in_scope'
  AND expectedSource NOT IN (SELECT 'doc-' || d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id)""")
SQL["question_dist"] = with_(QUESTIONS, select="""
SELECT CASE WHEN grouping(category) = 1 THEN 'Total' ELSE category END AS category, count(*) AS n,
  count(*) FILTER (scope = 'in_scope') AS in_scope,
  count(*) FILTER (scope = 'out_of_scope') AS out_of_scope
FROM questions GROUP BY ROLLUP (category)""")
