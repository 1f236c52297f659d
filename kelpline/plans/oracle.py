"""The same queries in SQL. The tables hold no CJK text, so tokens here are ASCII word runs."""

from __future__ import annotations

DOCS = """docs AS (SELECT doc_id, text, source AS dept, lang, substr(text, 1, 30) AS title,
    lpad(CAST(n_chars AS VARCHAR), 8, '0') AS date, 'doc/' || doc_id AS url FROM documents)"""


def _bm25_ctes(k: int, lower: bool = True, among: str = "true") -> str:
    tokens = "regexp_extract_all(text, '[A-Za-z0-9_]+')"
    asked = f"list_transform({tokens}, lambda t: lower(t))" if lower else tokens
    return f"""{DOCS}, corpus AS (SELECT * FROM docs),
    tok AS (SELECT doc_id, list_transform({tokens}, lambda t: lower(t)) AS toks FROM corpus),
    post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tok),
    tfs AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM post GROUP BY doc_id, term),
    size AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM tok),
    raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tfs, size GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT item_id AS query_id, unnest({asked}) AS term FROM benchmark) GROUP BY query_id, term),
    hits AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM asked JOIN idf USING (term) JOIN tfs USING (term), size GROUP BY query_id, doc_id),
    allowed AS (SELECT doc_id FROM corpus WHERE {among}),
    filled AS (SELECT b.item_id AS query_id, a.doc_id, round(coalesce(h.s, 0), 10) AS s
        FROM benchmark b CROSS JOIN allowed a LEFT JOIN hits h ON h.query_id = b.item_id AND h.doc_id = a.doc_id),
    top AS (SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, round(s, 6) AS score FROM filled
        WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, doc_id) QUALIFY row_number() OVER w <= {k})"""


def bm25(select: str, k: int = 10, lower: bool = True, among: str = "true") -> str:
    return f"WITH {_bm25_ctes(k, lower, among)} {select}"


_APART = "round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 10)"
_PLACE = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS INTEGER)"
_PAIRS = f"SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {_APART} AS distance FROM embeddings q, embeddings d"

KNN = f"""SELECT query_id, rank, doc_id, round(distance, 6) AS distance FROM (SELECT query_id, {_PLACE} AS rank, doc_id, distance FROM ({_PAIRS}{{join}} WHERE q.vec_id % 20 = 0{{keep}}))
WHERE rank <= {{k}}"""
KNN_AFTER = f"""WITH wide AS ({KNN.format(k=24, join="", keep="")}),
kept AS (SELECT w.* FROM wide w JOIN documents a ON a.doc_id = w.doc_id JOIN documents b ON b.doc_id = w.query_id WHERE a.source = b.source),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, doc_id, distance FROM kept)
SELECT * FROM ranked WHERE rank <= 8"""
KNN_EXACT = KNN.format(k=8, join=" JOIN documents a ON a.doc_id = d.vec_id, documents b", keep=" AND b.doc_id = q.vec_id AND a.source = b.source")



def _fused(k: int, cut: int, vectors: str = "true", among: str = "true") -> str:
    """Both lists of k, fused and cut."""
    return f"""WITH {_bm25_ctes(k, among=among)},
near AS (SELECT * FROM (SELECT query_id, {_PLACE} AS rank, doc_id FROM ({_PAIRS}
    WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND {vectors})) WHERE rank <= {k}),
lists AS (SELECT query_id, doc_id, rank, 0 AS list_no FROM near UNION ALL SELECT query_id, doc_id, rank, 1 FROM top),
best AS (SELECT query_id, doc_id, min(rank) AS best_rank, min({{'list_no': list_no, 'rank': rank}}) AS first FROM lists GROUP BY query_id, doc_id),
placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, first, doc_id) AS INTEGER) AS position,
    doc_id, best_rank, round(1 / (60 + best_rank), 8) AS fused FROM best QUALIFY position <= {cut})"""


HYBRID = f"{_fused(24, 24)} SELECT * FROM placed"

_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda t: lower(t))"
RERANK = bm25(
    f""", scored AS (SELECT t.query_id, t.rank, t.doc_id, round(
        len(list_intersect(list_distinct({_TOKENS.format("b.text")}), {_TOKENS.format("substr(d.text, 1, 300)")}))
        / len(list_distinct({_TOKENS.format("b.text")})), 6) AS rerank_score
      FROM top t JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = t.query_id),
    placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS position, doc_id, rerank_score FROM scored)
    SELECT * FROM placed WHERE position <= 8"""
)

RETRIEVE = f"""{_fused(8, 24)}, scored AS (SELECT p.query_id, p.position AS rank, p.doc_id, round(coalesce(
        len(list_intersect(list_distinct({_TOKENS.format("b.text")}), {_TOKENS.format("substr(coalesce(d.text, ''), 1, 300)")}))
        / nullif(len(list_distinct({_TOKENS.format("b.text")})), 0), 0), 6) AS rerank_score
      FROM placed p LEFT JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = p.query_id WHERE p.position <= 10),
    ordered AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS position, doc_id, rerank_score FROM scored)
    SELECT * FROM ordered WHERE position <= 8"""
RETRIEVE_IN = f"""{_fused(8, 24, "d.vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')", "dept = 'src1'")}
    SELECT query_id, position, doc_id FROM placed WHERE position <= 8"""

RETRIEVE_EVAL = f"{_fused(12, 9)} SELECT query_id, position, doc_id FROM placed"

CONTEXT = bm25(
    """, blocks AS (SELECT query_id, rank, '【文件名稱】' || d.url || chr(10) || '【文件類型】' || d.lang || chr(10) || '【頁碼】' || d.dept || chr(10)
        || '【來源網址】' || chr(10) || '【文件內容】' || chr(10) || substr(d.text, 1, 1200) AS block FROM top JOIN docs d USING (doc_id)),
    joined AS (SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id)
    SELECT query_id, CAST(length(context) AS INTEGER) AS chars, md5(context) AS digest FROM joined""",
    k=3,
)

ATTRIBUTION = bm25(
    r""", cand AS (SELECT t.query_id, t.rank, d.url, d.title, b.text AS answer,
        regexp_replace(regexp_replace(d.title, '^[\d.、\s]+', ''), '(?i)\.(docx?|pdf|odt|ods|xlsx?)$', '') AS key
      FROM top t JOIN docs d USING (doc_id) JOIN benchmark b ON b.item_id = t.query_id),
    told AS (SELECT *, contains(answer, url) AS linked, NOT contains(answer, url) AND length(key) >= 4 AND contains(answer, key) AS named FROM cand),
    agg AS (SELECT query_id, list(url ORDER BY rank) FILTER (named) AS extra, list(url ORDER BY rank) AS everything, bool_or(linked) AS linked,
        regexp_matches(any_value(answer), '查無|沒有查到明確答案|暫時沒有整理出|暫時無法整理出') AS silent FROM told GROUP BY query_id),
    fin AS (SELECT query_id, CASE WHEN coalesce(len(extra), 0) = 0 AND NOT linked AND NOT silent THEN everything[1:2] ELSE coalesce(extra, []) END AS s FROM agg)
    SELECT query_id, CAST(len(s) AS INTEGER) AS n_sources, array_to_string(s, ',') AS urls FROM fin""",
    k=3,
)

CHUNK_FIXED = """WITH cut AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 800) AS BIGINT))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CAST(length(substr(text, i * 800 + 1, 800)) AS INTEGER) AS chars, md5(substr(text, i * 800 + 1, 800)) AS digest FROM cut"""
TRANSLATED = """WITH cut AS (SELECT doc_id, text, list_transform(range(CAST(ceil(length(text) / 300) AS BIGINT)), lambda i: substr(text, i * 300 + 1, 300)) AS w FROM documents),
told AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[ aeiouAEIOU]') THEN '' ELSE translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END), chr(10)), '') END AS t FROM cut)
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM told"""
_TEXT_TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"
TOKEN_COUNTS = f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(len(list_distinct(t)) AS INTEGER) AS terms FROM (SELECT doc_id, {_TEXT_TOKENS} AS t FROM documents)"
POSTINGS = f"""SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS INTEGER) AS dl, unnest(t) AS term FROM
    (SELECT doc_id, {_TEXT_TOKENS} AS t FROM documents)) GROUP BY doc_id, dl, term"""

LEFT_JOIN = """SELECT d.doc_id, d.source, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)"""
UNMATCHED = "SELECT source, count(*) AS unmatched FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source"
_HALF = "CAST(sum(CAST(('0x' || substr(md5(coalesce(text, '')), {0}, 16)) AS UBIGINT)) AS VARCHAR)"
FINGERPRINT = f"""WITH parts AS (SELECT source, md5(count(*) || ':' || {_HALF.format(1)} || ':' || {_HALF.format(17)}) AS digest
    FROM documents GROUP BY source)
SELECT md5(string_agg(coalesce(source, '') || ':' || digest, '|' ORDER BY coalesce(source, '') || ':' || digest)) AS fingerprint FROM parts"""
DENSE = "SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS doc_id FROM pages"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
STRIP = rf"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace({_CLEAN}, '^\s+', ''), '\s+$', '') AS text FROM pages)
SELECT page_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM bare"""
TITLE_KEYS = r"""WITH t AS (SELECT page_id, html, string_split(url, '/')[-1] AS u FROM pages)
SELECT page_id, regexp_replace(regexp_replace(trim(u), '(?i)\.(pdf|docx?|odt|ods)$', ''), '\s+', '', 'g') AS title_norm,
    regexp_replace(regexp_replace(u, '^[\d.、\s]+', ''), '(?i)\.(docx?|pdf|odt|ods|xlsx?)$', '') AS cited,
    regexp_matches(html, '[一-鿿]') AS cjk FROM t"""

LATEST = f"""WITH {DOCS}, firsts AS (SELECT doc_id, title, date FROM docs QUALIFY row_number() OVER (PARTITION BY title ORDER BY date DESC, doc_id) = 1)
SELECT doc_id, title, date FROM firsts ORDER BY date DESC, doc_id LIMIT 6"""


def _count(text: str, words: tuple[str, ...]) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}" for w in words)


_WORDS = ("the", "token", "license", "tion", "the")
KEYWORD = f"""WITH {DOCS}, scored AS (SELECT doc_id, title, date, {_count("lower(title || ' ' || text)", _WORDS)} AS score, {_count("lower(text || title)", _WORDS)} AS gate FROM docs),
firsts AS (SELECT * FROM scored WHERE gate > 0 QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, date DESC, doc_id) = 1)
SELECT doc_id, score, date FROM firsts ORDER BY score DESC, date DESC, doc_id LIMIT 6"""
FORMS = f"""WITH {DOCS}, scored AS (SELECT doc_id, title, url, CAST(3 * contains(lower(title), 'the')::INTEGER + contains(lower(text), 'the')::INTEGER AS INTEGER) AS score FROM docs),
firsts AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY title, url ORDER BY doc_id) = 1)
SELECT doc_id, score FROM firsts ORDER BY score DESC, doc_id LIMIT 20"""


def _records(strict: str, loose: str, limits: str = "true") -> str:
    return f"""WITH {DOCS}, marked AS (SELECT doc_id, ({strict}) AND ({loose}) AS strict FROM docs WHERE {loose}),
totals AS (SELECT count(*) FILTER (strict) AS s, count(*) AS l FROM marked),
kept AS (SELECT doc_id, s, l, row_number() OVER (ORDER BY doc_id) AS place FROM marked, totals WHERE strict OR (s = 0 AND {limits}))
SELECT doc_id, CASE WHEN s > 0 THEN 'strict' ELSE 'relaxed' END AS mode, CASE WHEN s > 0 THEN s ELSE least(l, 15) END AS total
FROM kept WHERE place <= CASE WHEN s > 0 THEN 25 ELSE 15 END"""


RECORDS_STRICT = _records("contains(text, 'License/tion') OR contains(text, 'License') OR contains(text, 'tion')", "contains(text, 'the') AND (contains(text, '15') OR contains(text, '1926'))")
RECORDS_RELAXED = _records("contains(text, 'nosuchword')", "contains(text, 'License')")

ADMISSION = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
lists AS (SELECT user_id, list([us] ORDER BY us, event_id) AS l FROM e GROUP BY user_id),
folded AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a > x[1] - 21600000000)) < 2 THEN list_append(acc, x[1]) ELSE acc END) AS ok FROM lists)
SELECT event_id, e.user_id, list_contains(ok, us) AS admitted FROM e JOIN folded USING (user_id)"""
HISTORY = """SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8 AND text IS NOT NULL"""
LAST_USER = "SELECT conv_id, substr(max_by(text, turn), 1, 80) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"

FEEDBACK = """WITH a0 AS (SELECT 'm' || (event_id % 5000) AS message_id, event_id AS seq, 'd' || (user_id % 5) AS dept,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS session_id FROM events WHERE event_type IN ('view', 'purchase')),
answers AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1),
f0 AS (SELECT 'm' || (event_id * 7 % 6000) AS message_id, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'maybe' END AS rating FROM events WHERE event_type IN ('click', 'error', 'signup')),
feedback AS (SELECT message_id, max(seq) AS seq, max_by(rating, seq) AS rating, min(seq) AS first_seen FROM f0 GROUP BY message_id) """
_COUNTS = "count(*) FILTER (rating = 'up') AS up"
FEEDBACK_RATES = FEEDBACK + f"""SELECT *, up + down AS total, round(up / (up + down), 6) AS satisfaction FROM
(SELECT {_COUNTS}, count(*) FILTER (rating = 'down') AS down FROM feedback)"""
FEEDBACK_BY_DEPT = FEEDBACK + f"""SELECT dept, up, total - up AS down, total, round(up / total, 6) AS satisfaction FROM
(SELECT dept, {_COUNTS}, count(*) AS total FROM feedback JOIN answers USING (message_id) GROUP BY dept)"""
NEGATIVE = FEEDBACK + """SELECT f.message_id, f.first_seen, coalesce(a.dept, '?') AS dept FROM
(SELECT * FROM feedback WHERE rating = 'down' ORDER BY first_seen DESC LIMIT 10) f LEFT JOIN answers a USING (message_id)"""
USAGE = FEEDBACK + """SELECT dept, count(*) AS answers, count(DISTINCT nullif(session_id, '')) AS sessions, min(seq) AS first_seen FROM answers GROUP BY dept"""
NEAREST_RANK = """WITH r AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS n, v[1 + len(v) // 2] AS p50, v[1 + greatest(0, len(v) * 95 // 100 - 1)] AS p95, v[len(v)] AS max FROM r"""
NEAREST_RANK_ALL = """WITH r AS (SELECT list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL)
SELECT len(v) AS n, v[1 + len(v) // 2] AS p50, v[1 + greatest(0, len(v) * 95 // 100 - 1)] AS p95, v[len(v)] AS max FROM r"""
VERDICTS = """WITH j AS (SELECT source AS dept, CASE WHEN quality = 1 AND toxic = 0 THEN 'CORRECT' WHEN quality = 1 THEN 'PARTIAL'
    WHEN toxic = 0 THEN 'WRONG' ELSE 'JUDGE_ERROR' END AS verdict, CASE WHEN lang <> 'es' THEN (lang = 'en')::INTEGER END AS hit
    FROM documents JOIN labels USING (doc_id))
SELECT dept, CAST(grouping(dept) AS INTEGER) AS overall, count(*) AS n, count(*) FILTER (verdict = 'CORRECT') AS correct, count(*) FILTER (verdict = 'PARTIAL') AS partial,
    count(*) FILTER (verdict = 'WRONG') AS wrong, count(*) FILTER (verdict = 'JUDGE_ERROR') AS judge_error,
    round(count(*) FILTER (verdict = 'CORRECT') / count(*), 6) AS strict,
    round((count(*) FILTER (verdict = 'CORRECT') + 0.5 * count(*) FILTER (verdict = 'PARTIAL')) / count(*), 6) AS weighted,
    round(avg(hit), 6) AS tool_accuracy FROM j GROUP BY GROUPING SETS ((), (dept))"""


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(text, '{w}')::INTEGER" for w in words)


TOOLS = f"""WITH s AS (SELECT conv_id, turn, {_hits(("the ", "and", "ing"))} AS en, {_hits(("les", "aux", "ion"))} AS fr, {_hits(("ung", "lich", "der "))} AS de FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(en, fr, de) = 0 THEN 'tool_search' WHEN en >= fr AND en >= de THEN 'tool_en' WHEN fr >= de THEN 'tool_fr' ELSE 'tool_de' END AS tool FROM s"""
ADHERENCE = """WITH a AS (SELECT conv_id AS id, coalesce(toxic = 0, true) AS expected, coalesce(contains(lower(text), 'lich ') OR contains(lower(text), 'the ea'), false) AS refused, coalesce(text, '') AS answer
    FROM conversations LEFT JOIN labels ON doc_id = conv_id WHERE role = 'assistant')
SELECT id, count(*) FILTER (refused) AS refused, round(avg(CASE WHEN expected THEN CASE WHEN answer = '' OR refused THEN 0 ELSE 1 END ELSE refused::INTEGER END), 6) AS adherence FROM a GROUP BY id"""
YEARS = """WITH e AS (SELECT DISTINCT event_id % 3000 AS n, event_id % 4 AS form FROM events),
y AS (SELECT n, form, CASE WHEN n < 10 THEN NULL WHEN n < 1000 THEN CAST(n + 1911 AS VARCHAR) END AS strict,
    CASE WHEN n < 10 THEN NULL WHEN n < 1000 THEN CAST(n + 1911 AS VARCHAR) ELSE (n // 1000) || CAST(n % 1000 + 1911 AS VARCHAR) END AS compat,
    CASE WHEN n < 1000 THEN '' ELSE '民國 ' END AS lead FROM e)
SELECT CASE form WHEN 0 THEN n || '年' WHEN 1 THEN n || '學年度' WHEN 2 THEN '民國 ' || n || ' 年' ELSE 'no ' || n END AS query,
    CASE form WHEN 0 THEN coalesce(compat, n || '年') WHEN 1 THEN coalesce(compat || '度', n || '學年度') WHEN 2 THEN coalesce(lead || compat, '民國 ' || n || ' 年') ELSE 'no ' || n END AS compat,
    CASE form WHEN 0 THEN coalesce(strict, n || '年') WHEN 1 THEN coalesce(strict || '度', n || '學年度') WHEN 2 THEN coalesce(strict, '民國 ' || n || ' 年') ELSE 'no ' || n END AS strict FROM y"""

CORPUS = """WITH d AS (SELECT doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(doc_id AS VARCHAR) AS i, md5(coalesce(text, '')) AS d,
    CAST(doc_id % 7 AS VARCHAR) AS k, '2024 / 1 / ' || (doc_id % 28 + 1) AS day FROM documents WHERE doc_id IS NOT NULL),
rows AS (
    SELECT 0 AS part, path, 0 AS nth, 'ope' AS dept, 'news' AS type, '最新消息' AS page, 'N' || i AS title, day AS date, 'http://u/' || i AS url, '' AS category,
        '## ' || day || chr(10) || '**[N' || i || '](http://u/' || i || ')**' || chr(10) || 'body ' || d AS text FROM d
    UNION ALL SELECT 0, path, 1, 'ope', 'news', '最新消息', '最新消息', '', '', '', 'plain ' || d FROM d
    UNION ALL SELECT 1, path, 0, 'ope', 'faq', '常見問題', 'Q' || i || '?', '', '', '', 'Q: Q' || i || '?' || chr(10) || chr(10) || 'A:' || chr(10) || 'A ' || d FROM d
    UNION ALL SELECT 3, path, 0, 'ope', 'page', 'P' || k, 'P' || k, '', '', '', 'page ' || d FROM d
    UNION ALL SELECT 3, path, 1, 'ope', 'page', 'P' || k || '_2', 'P' || k || '_2', '', '', '', 'twice' FROM d
    UNION ALL SELECT 3, path, 2, 'ope', 'grade', '競賽成績', '成績紀錄：Ann G', '', '', '',
        '【競賽成績紀錄】學年度：' || i || '，賽事名稱：G，競賽項目：R，名次：1，參賽學生/隊伍：Ann' FROM d
    UNION ALL SELECT 4, path, 0, 'ope', 'form', 'Page 1', 'F' || i || '.doc', '', 'https://u/' || i, '表單', 'form ' || d FROM d
    UNION ALL SELECT 4, path, 1, 'ope', 'regulation', 'Page 1', 'R' || i, '', '', '法規', 'R' || i || chr(10) || '文件類型：法規' || chr(10) || '來源網址：' FROM d
    UNION ALL SELECT 5, path, 0, 'ge', 'correction', '系統修正紀錄', '使用者糾正資訊', '', '', '',
        '## 修正紀錄：x' || chr(10) || '- **所屬處室**：GE（x）' || chr(10) || 'right ' || d FROM d
    UNION ALL SELECT 5, path, 1, 'ope', 'correction', '系統修正紀錄', '使用者糾正資訊', '', '', '', '## 修正紀錄：y' || chr(10) || 'no dept ' || i FROM d
    UNION ALL SELECT 8, path, 0, 'ge', CASE WHEN id % 2 = 0 THEN 'form' ELSE 'regulation' END, 'Page 1', 'A' || i || '.pdf', CASE WHEN id % 2 = 0 THEN 'd' ELSE '' END,
        CASE WHEN id % 2 = 0 THEN 'http://m/' || i ELSE '' END, CASE WHEN id % 2 = 0 THEN '表單' ELSE '法規' END, 'rule ' || d FROM d)
SELECT row_number() OVER (ORDER BY part, path, nth) - 1 AS doc_id, dept, type, page, title, date, url, category, text FROM rows"""
LINES = """SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, 'A' || doc_id || '.pdf' AS title, 'Page 1' AS page, 'rule ' || md5(coalesce(text, '')) AS text
    FROM documents WHERE doc_id IS NOT NULL"""
JSONL = """WITH lines AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events WHERE event_id % 10 <> 4)
SELECT seq, CASE WHEN event_id % 10 = 3 THEN 'corrupt' WHEN event_id % 2 = 0 THEN 'answer' ELSE 'feedback' END AS kind,
    CASE WHEN event_id % 10 = 3 THEN '{broken ' ELSE '' END || 'm' || event_id AS what,
    CASE event_id % 10 WHEN 6 THEN CAST(1.5 AS DOUBLE) WHEN 8 THEN 2.25 END AS latency_s, CASE event_id % 10 WHEN 7 THEN 2 END AS n_reasons FROM lines"""
CORRECTIONS = """SELECT CASE WHEN toxic = 1 THEN 'ge' ELSE 'ope' END AS dept, 't' || doc_id AS topic,
    CAST(length('## 修正紀錄：2024-05-06 07:08:09') + 1 + length('- **所屬處室**：' || CASE WHEN toxic = 1 THEN 'ge（通識教育中心）' ELSE 'ope（體育室）' END) + 1
        + length('- **相關問題/主題**：t' || doc_id) + 1 + length('- **正確資訊**：a') + 2 AS INTEGER) AS chars FROM labels WHERE quality = 1"""
VALIDATED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'up' ELSE 'down' END AS rating, 'm' || event_id AS message_id, 'other,outdated' AS reasons,
    CAST(least(event_id % 700, 500) AS INTEGER) AS chars FROM events WHERE event_id % 4 IN (0, 1) AND event_id % 6 <> 5"""
COMPLETENESS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 ELSE CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0
    ELSE round_even(CAST('0.' || (event_id % 1000) AS DOUBLE), 4) END END AS completeness FROM events"""

_REQUESTS = f"""{DOCS}, spoken AS (SELECT item_id AS i, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
requests AS (SELECT i AS request_id, regexp_extract_all(lower(substr(text, 1, 40)), '[A-Za-z0-9]+') AS toks, CASE WHEN i % 3 = 0 THEN 'src1' END AS want,
    CASE WHEN i % 5 <> 0 THEN ' ' || coalesce(w[1], '') || ' ' || coalesce(w[2], '') ELSE '' END AS words,
    CASE WHEN i % 7 = 0 THEN 'nosuchword' WHEN i % 7 <> 1 THEN coalesce(w[1], '') || '/' || coalesce(w[3], '') ELSE '' END AS keyword,
    CASE i % 4 WHEN 0 THEN '15' WHEN 1 THEN 'x1' ELSE '' END AS year, CASE WHEN i % 2 = 0 THEN coalesce(w[2], '') ELSE '' END AS name FROM spoken)"""
BULK_NEWS = f"""WITH {_REQUESTS}, low AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS scored, lower(coalesce(text, '') || coalesce(title, '')) AS gated FROM docs),
met AS (SELECT request_id, doc_id, title, date, CAST(list_sum(list_transform(toks, lambda t: (length(scored) - length(replace(scored, t, ''))) // length(t))) AS BIGINT) AS score
    FROM requests JOIN low ON (want IS NULL OR want = dept) AND len(list_filter(toks, lambda t: contains(gated, t))) > 0),
one_each AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY request_id, title ORDER BY score DESC, date DESC, doc_id) = 1)
SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS position, doc_id, score, date FROM one_each
WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, date DESC, doc_id) QUALIFY row_number() OVER w <= 6"""
BULK_FORMS = f"""WITH {_REQUESTS}, met AS (SELECT request_id, doc_id, title, dept AS url,
        3 * CAST(contains(lower(title), lower(trim(words))) AS INTEGER) + CAST(contains(lower(text), lower(trim(words))) AS INTEGER) AS score FROM requests JOIN docs ON words <> ''
    UNION ALL SELECT request_id, doc_id, title, dept, 0 FROM requests, (SELECT * FROM docs ORDER BY doc_id LIMIT 20) WHERE words = ''),
one_each AS (SELECT m.* FROM met m JOIN requests USING (request_id) WHERE score > 0 OR words = '' QUALIFY row_number() OVER (PARTITION BY request_id, title, url ORDER BY doc_id) = 1)
SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS position, doc_id, CAST(score AS INTEGER) AS score FROM one_each
WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20"""
BULK_RECORDS = f"""WITH {_REQUESTS}, marked AS (SELECT request_id, doc_id, keyword <> '' AND (year <> '' OR name <> '') AS drops,
        (name = '' OR contains(text, name)) AND (year = '' OR year = '15' AND (contains(text, '15') OR contains(text, '1926'))) AS loose,
        keyword = '' OR len(list_filter(list_append(list_filter(string_split(keyword, '/'), lambda p: length(p) >= 2), keyword), lambda p: contains(text, p))) > 0 AS has
    FROM requests, docs),
counted AS (SELECT *, count_if(has) OVER (PARTITION BY request_id) AS strict_total, count(*) OVER (PARTITION BY request_id) AS loose_total FROM marked WHERE loose AND (has OR drops)),
kept AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY doc_id) AS place FROM counted WHERE has OR strict_total = 0)
SELECT request_id, CAST(place AS INTEGER) AS position, doc_id, CASE WHEN strict_total > 0 THEN 'strict' ELSE 'relaxed' END AS mode,
    CAST(CASE WHEN strict_total > 0 THEN strict_total ELSE least(loose_total, 15) END AS BIGINT) AS total FROM kept WHERE place <= CASE WHEN strict_total > 0 THEN 25 ELSE 15 END"""
