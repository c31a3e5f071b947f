"""The registered queries stated once more, as SQL for an independent engine.

Each statement is written from the rule and not from the Spark expressions: sequence rules are
stated as joins and window functions over unnested rows.
"""

from __future__ import annotations

from vakanz.functions.stopwords import BUILT_IN
from vakanz.plans.vocabulary import entries

_STOP = ",".join(f"'{w}'" for w in BUILT_IN)
_IS_STOP = f"IN ({_STOP})"

_STRIP = (
    "regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), "
    r"'(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"
)
_TAG = """'<([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"'']|"[^"]*"|''[^'']*'')*)>([^<]*)'"""


def _decode(x: str) -> str:
    for name, value in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">")):
        x = f"replace({x}, '&{name};', '{value}')"
    return f"replace({x}, '&amp;', '&')"


def _tokens(x: str, stop: bool = True) -> str:
    found = rf"list_transform(regexp_extract_all({x}, '\p{{L}}{{2,}}'), lambda t: lower(t))"
    return f"list_filter({found}, lambda t: t NOT {_IS_STOP})" if stop else found


def _words(x: str) -> str:
    return (
        f"list_filter(string_split({x}, ' '), "
        f"lambda w: length(w) > 5 AND w <> 'None' AND w NOT {_IS_STOP})"
    )


_CLEAN = (
    r"list_filter(list_transform({x}, lambda l: lower(trim(regexp_replace(regexp_replace("
    r"l, '[^\p{{L}} ]', ' ', 'g'), ' {{2,}}', ' ', 'g')))), lambda l: length(l) > 3)"
)


def _sanitized(x: str) -> str:
    clean = _CLEAN.format(x=x)
    return f"CASE WHEN {x}[1] <> '' AND len({clean}) > 1 THEN {clean} END"


# Elements of the pages, one row each, with their leading text.
_PAGE_NODES = f"""
tags AS (
  SELECT page_id, unnest(range(len(regexp_extract_all(h, {_TAG}, 1)))) AS ord,
         lower(unnest(regexp_extract_all(h, {_TAG}, 1))) AS tag,
         unnest(regexp_extract_all(h, {_TAG}, 2)) AS attrs,
         unnest(regexp_extract_all(h, {_TAG}, 3)) AS raw
  FROM (SELECT page_id, {_STRIP.format(x="replace(replace(trim(html), chr(10), ''), chr(13), '')")} AS h
        FROM pages)),
nodes AS (
  SELECT page_id, ord, tag, attrs, {_decode('raw')} AS text FROM tags
  WHERE tag NOT IN ('br', 'hr', 'img', 'input', 'meta', 'link') AND length({_decode('raw')}) > 3)"""

# From headings(id, hno, text) and content rows(id, rno, text), both numbered from 1.
_SECTIONS = f"""
firsts AS (SELECT id, text, min(rno) AS rno FROM rows GROUP BY id, text),
starts AS (SELECT id, hno, text, rno AS start FROM headings JOIN firsts USING (id, text)),
bounds AS (
  SELECT *, lead(start) OVER (PARTITION BY id ORDER BY hno) AS stop,
         lead(start) OVER (PARTITION BY id ORDER BY hno) IS NULL AS is_last
  FROM starts),
raw AS (
  SELECT b.id, b.hno, list(r.text ORDER BY r.rno) AS lines
  FROM bounds b JOIN rows r ON r.id = b.id AND r.rno >= b.start
       AND r.rno < CASE WHEN b.is_last THEN b.start + 11 ELSE b.stop END
  WHERE length(b.text) > 5 AND length(b.text) < 40
  GROUP BY b.id, b.hno),
clean AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY len(lines) DESC, hno) AS place,
         {_sanitized('lines')} AS s FROM raw),
pairs AS (
  SELECT id, place, s[1] AS heading, array_to_string(s[2:], ' ') AS content FROM clean
  WHERE list_max(list_transform(s, lambda l: length(l))) > 20),
sections AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY min(place)) - 1 AS section_no, heading,
         arg_max(content, place) AS content
  FROM pairs GROUP BY id, heading)"""

_PAGE_SECTIONS = f"""WITH {_PAGE_NODES},
rows AS (SELECT page_id AS id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rno, text FROM nodes),
headings AS (SELECT page_id AS id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS hno, text
             FROM nodes WHERE tag IN ('h1', 'b')),{_SECTIONS}"""

# Sections of the posting pages made from the documents: per line a heading and a paragraph.
_DOC_SECTIONS = f"""WITH doc_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS ord
  FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 20 NOT IN (6, 7, 8)),
parts AS (
  SELECT doc_id, 2 * ord AS ord, 'b' AS tag, substr(line, 1, 30) AS text FROM doc_lines
  UNION ALL SELECT doc_id, 2 * ord + 1, 'p', line FROM doc_lines),
rows AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rno, text
         FROM parts WHERE length(text) > 3),
headings AS (SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS hno, text
             FROM parts WHERE length(text) > 3 AND tag = 'b'),{_SECTIONS},
usable AS (SELECT id, count(*) AS n_sections FROM sections GROUP BY id HAVING count(*) > 1)"""

_POSTING_FIELDS = """
  lower('https://Jobs.example.org/' || md5(text)) AS url,
  lower(substr(string_split(text, chr(10))[1], 1, 40)) AS title,
  lower(source) AS organization,
  TRY_CAST('2018-' || lpad(CAST(length(text) % 14 AS VARCHAR), 2, '0') || '-15' AS DATE) AS date_posted,
  lang AS educational_requirements,
  CASE WHEN lang = 'fr' THEN lower(source) ELSE lower(source) || ',it software' END AS industry,
  'full_time,' || lower(lang) AS employment_type,
  CASE WHEN lang = 'en' THEN 'two years' END AS experience_requirements"""

_LISTING = """WITH sec AS (
  SELECT lang AS search_term, CAST(doc_id AS INTEGER) AS page_no,
         unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS ord
  FROM documents),
found AS (
  SELECT search_term, page_no,
         CAST(row_number() OVER (PARTITION BY page_no ORDER BY ord) - 1 AS INTEGER) AS pos,
         '/job/' || md5(first_line) || '?a=1&b=2' AS url, md5(first_line) AS job_id
  FROM (SELECT *, CASE WHEN length(line) >= 8 THEN line
                       WHEN ord % 5 = 3 AND length(inner_line) >= 8 THEN inner_line END AS first_line
        FROM (SELECT *, lead(line) OVER (PARTITION BY page_no ORDER BY ord) AS inner_line FROM sec))
  WHERE length(line) < 8 OR length(line) >= 40)"""

_ANCHORS = f"""WITH {_PAGE_NODES.split('nodes AS')[0].rstrip().rstrip(',')},
anchors AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS pos,
         {_decode('''regexp_extract(attrs, 'href="([^"]*)"', 1)''')} AS url
  FROM tags WHERE tag = 'a' AND contains(attrs, 'href=')),
ids AS (SELECT *, nullif(regexp_extract(url, '[0-9a-z]{{5,}}'), '') AS job_id FROM anchors)"""

_HEADED = """headed AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS heading,
         array_to_string(string_split(text, chr(10))[2:], chr(10)) AS content
  FROM documents)"""

_TERMS = "terms(intent, q, d, p, w) AS (VALUES " + ", ".join(
    f"('{i}', '{t}', {d}, {p}, CAST({w} AS DOUBLE))" for i, t, d, p, w in entries()
) + ")"

# Edit distance counts letters: every letter outside ASCII stands in as one unused ASCII sign.
_LETTERS = "äöüßéèêëçñáàâíìîïóòôúùûœæ¡ÄÖÜÉÈ"
_SIGNS = "0123456789!#$%&()*+,-./:;<=>?@["


def _ascii(x: str) -> str:
    return f"translate({x}, '{_LETTERS}', '{_SIGNS[: len(_LETTERS)]}')"


_EXPANDED = f"""{_HEADED},
{_TERMS},
toks AS (SELECT doc_id, {_tokens('heading')} AS t FROM headed),
bag AS (SELECT doc_id, len(any_value(t)) AS dl, term, count(*) AS tf
        FROM (SELECT doc_id, t, unnest(t) AS term FROM toks) GROUP BY doc_id, term),
vocab AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
expanded AS (
  SELECT intent, q || '~' || d || '/' || p AS query_term, term, df, d = 0 AS exact, w
  FROM vocab JOIN terms
    ON (d = 0 AND term = q AND q NOT {_IS_STOP})
    OR (d > 0 AND left(term, p) = left(q, p) AND abs(length(term) - length(q)) <= d
        AND levenshtein({_ascii('term')}, {_ascii('q')}) <= d))"""

_SCORED = f"""{_EXPANDED},
size AS (SELECT CAST(2 * count(*) AS DOUBLE) AS n, sum(len(t)) / CAST(2 * count(*) AS DOUBLE) AS avglen FROM toks),
found AS (SELECT intent, CAST(count(DISTINCT term) AS DOUBLE) AS total FROM expanded GROUP BY intent),
hits AS (
  SELECT doc_id, intent, query_term, term, exact, w,
         CASE WHEN exact THEN w * (ln(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (dl / avglen))) END AS s
  FROM bag JOIN expanded USING (term), size),
sums AS (
  SELECT doc_id, intent, coalesce(sum(s), 0) AS exact_sum, count(DISTINCT term) AS m FROM hits
  GROUP BY doc_id, intent),
fuzzy AS (
  SELECT doc_id, intent, sum(w) AS fuzzy_sum
  FROM (SELECT DISTINCT doc_id, intent, query_term, w FROM hits WHERE NOT exact) GROUP BY doc_id, intent),
scored AS (
  SELECT doc_id, intent,
         CAST(round((exact_sum + coalesce(fuzzy_sum, 0) + (m - 1) / ((total - 1) * (total - 1))) * (total - 1) / total * 1000000) AS BIGINT) AS micro
  FROM sums JOIN found USING (intent) LEFT JOIN fuzzy USING (doc_id, intent) WHERE total > 1)"""

_KEPT = f"""{_SCORED},
ranked AS (
  SELECT intent, micro, row_number() OVER (PARTITION BY intent ORDER BY micro DESC) - 1 AS r,
         count(*) OVER (PARTITION BY intent) AS n
  FROM scored),
cutoffs AS (SELECT intent, micro AS cutoff FROM ranked WHERE r = CAST(floor(n * 0.5) AS BIGINT)),
kept AS (SELECT doc_id, intent, micro FROM scored JOIN cutoffs USING (intent) WHERE micro >= cutoff)"""

_COUNTED = f"""{_KEPT},
words AS (
  SELECT intent, doc_id, micro, unnest(w) AS term, unnest(range(len(w))) AS pos
  FROM (SELECT intent, doc_id, micro, {_words('content')} AS w FROM kept JOIN headed USING (doc_id))),
counts AS (
  SELECT intent, term, count(*) AS cnt, min(row(-micro, doc_id, pos)) AS seen FROM words
  GROUP BY intent, term)"""

_RANKED = """ranks AS (
  SELECT *, row_number() OVER (PARTITION BY intent ORDER BY cnt DESC, seen) - 1 AS rnk,
         count(*) OVER (PARTITION BY intent) AS n
  FROM counts),
sliced AS (
  SELECT intent, term, cnt, rnk FROM ranks
  WHERE rnk >= CAST(floor(n * CAST(0.0025 AS DOUBLE)) AS BIGINT)
    AND rnk < CAST(floor(n * CAST(0.20 AS DOUBLE)) AS BIGINT))"""

_LINES = """paragraphs AS (
  SELECT doc_id, unnest(range(len(l))) AS paragraph_number, unnest(l) AS paragraph_heading
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

_INDEX_COUNTS = f"""{_LINES},
c AS (SELECT (SELECT count(*) FROM documents) AS postings, (SELECT count(*) FROM paragraphs) AS paragraphs),
counts AS (SELECT postings, paragraphs, round_even(CAST(paragraphs AS DOUBLE) / postings, 2) AS avg_paragraphs FROM c)"""

_INVERTED = f"""
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf
FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term, doc_id"""


def oracle_sql() -> dict[str, str]:
    found = {
        "link_extract": f"{_ANCHORS} SELECT page_id, pos, url, job_id FROM ids",
        "link_rejects": f"""{_ANCHORS}
            SELECT 'links' AS stage, CAST(page_id AS VARCHAR) AS key, 'no job id in link' AS reason,
                   count(*) AS n
            FROM ids WHERE job_id IS NULL GROUP BY page_id""",
        "link_first_per_id": f"""{_ANCHORS}
            SELECT job_id, page_id, pos, url FROM ids WHERE job_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY page_id, pos) = 1""",
        "page_url_ids": """
            SELECT regexp_extract(url, '[0-9]+') AS job_id, page_id, url FROM pages
            WHERE regexp_matches(url, '[0-9]')
            QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '[0-9]+') ORDER BY page_id) = 1""",
        "listing_links": f"""{_LISTING}
            SELECT *, CASE WHEN url IS NULL THEN 'no link in section' END AS reason FROM found""",
        "listing_first_links": f"""{_LISTING}
            SELECT search_term, job_id, page_no, pos, url FROM found WHERE job_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY search_term, job_id ORDER BY page_no, pos) = 1""",
        "result_counts": """
            SELECT o_custkey, CAST(CASE WHEN count(*) BETWEEN 10 AND 9999 THEN count(*) END AS INTEGER) AS found
            FROM orders GROUP BY o_custkey""",
        "page_plan": """
            WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
            SELECT l_suppkey, n, CAST(page_no AS INTEGER) AS page_no,
                   'https://jobs.example.org/?q=Supplier ' || l_suppkey || '&stpage=1&page=' || page_no AS url
            FROM c, range(41) AS pages(page_no)
            WHERE n BETWEEN 10 AND 9999 AND page_no >= least(n // 25, 10) AND page_no <= least(CAST(ceil(n / 25.0) AS BIGINT), 40)""",
        "page_nodes": f"""WITH {_PAGE_NODES}
            SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS pos, tag, text
            FROM nodes""",
        "page_headings": f"""WITH {_PAGE_NODES}
            SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INTEGER) AS pos,
                   text AS heading
            FROM nodes WHERE tag IN ('h1', 'b')""",
        "page_sections": f"""{_PAGE_SECTIONS}
            SELECT id AS page_id, CAST(section_no AS INTEGER) AS section_no, heading, content FROM sections""",
        "postings_parsed": f"""{_DOC_SECTIONS}
            SELECT doc_id AS page_id, {_POSTING_FIELDS},
                   length(text) / CAST(8 AS DOUBLE) AS latitude, -length(text) / CAST(16 AS DOUBLE) AS longitude
            FROM documents JOIN usable ON id = doc_id""",
        "posting_sections": f"""{_DOC_SECTIONS}
            SELECT id AS page_id, CAST(section_no AS INTEGER) AS section_no, heading, content
            FROM sections JOIN usable USING (id)""",
        "posting_rejects": f"""{_DOC_SECTIONS}
            SELECT 'postings' AS stage, CAST(doc_id AS VARCHAR) AS key,
                   CASE WHEN doc_id % 20 IN (6, 7, 8) AND lang = 'de' THEN 'no usable structured data'
                        WHEN doc_id % 20 = 6 THEN 'malformed structured data'
                        WHEN doc_id % 20 = 7 THEN 'no description'
                        WHEN doc_id % 20 = 8 THEN 'no usable structured data'
                        ELSE 'fewer than two sections' END AS reason
            FROM documents WHERE doc_id NOT IN (SELECT id FROM usable)""",
        "paragraph_rows": f"""{_DOC_SECTIONS}
            SELECT CAST(id AS VARCHAR) AS posting_id, CAST(section_no AS INTEGER) AS paragraph_number,
                   heading AS paragraph_heading, content AS paragraph_content
            FROM sections JOIN usable USING (id)""",
        "styled_headings": """
            WITH l AS (
              SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents)
            SELECT doc_id AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS pos,
                   substr(line, 1, 30) AS heading
            FROM l WHERE length(substr(line, 1, 30)) > 3""",
        "stored_links": f"""{_LISTING}
            SELECT CASE search_term WHEN 'de' THEN '007' WHEN 'en' THEN 'a/b' WHEN 'es' THEN '2024-01-01' ELSE 'koch' END AS search_term, url
            FROM (SELECT * FROM found WHERE job_id IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY search_term, job_id ORDER BY page_no, pos) = 1)""",
        "stored_postings": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, lang, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id)
            SELECT url, title FROM f WHERE lang <> 'de' GROUP BY url, title, lang, organization""",
        "added_postings": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, lang, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id)
            SELECT url, title, CAST(CASE WHEN lang <> 'de' THEN 0 ELSE 1 END AS INTEGER) AS run
            FROM f GROUP BY url, title, lang, organization""",
        "stage_reuse": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, lang, n_sections, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id WHERE lang = 'de'),
            u AS (SELECT any_value(n_sections) AS n FROM f GROUP BY url, title, lang, organization)
            SELECT 'links' AS stage, count(*) AS n FROM documents WHERE lang = 'de'
            UNION ALL SELECT 'postings', count(*) FROM u
            UNION ALL SELECT 'paragraphs', CAST(sum(n) AS BIGINT) FROM u""",
        "stored_index": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, lang, n_sections, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id),
            u AS (SELECT any_value(n_sections) AS n FROM f GROUP BY url, title, lang, organization)
            SELECT count(*) AS postings, CAST(sum(n) AS BIGINT) AS paragraphs,
                   round_even(CAST(sum(n) AS DOUBLE) / count(*), 2) AS avg_paragraphs FROM u""",
        "result_rejects": """
            SELECT 'counts' AS stage, CAST(o_custkey AS VARCHAR) AS key, 'no result count' AS reason
            FROM orders GROUP BY o_custkey HAVING count(*) NOT BETWEEN 10 AND 9999""",
        "posting_dedup": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, lang, n_sections, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id)
            SELECT min(doc_id) AS page_id, url, title, CAST(any_value(n_sections) AS INTEGER) AS n_sections
            FROM f GROUP BY url, title, lang, organization""",
        "posting_export": f"""{_DOC_SECTIONS},
            f AS (SELECT doc_id, {_POSTING_FIELDS} FROM documents JOIN usable ON id = doc_id),
            body AS (SELECT id, string_agg(heading || chr(10) || content, chr(10) || chr(10) ORDER BY section_no) AS b
                     FROM sections GROUP BY id)
            SELECT doc_id AS page_id,
                   substr(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 1, 20) AS file_stem,
                   'URL: ' || url || chr(10) || 'Titel: ' || title || chr(10) || 'Unternehmen: ' || organization || chr(10)
                   || 'Veröffentlichung: ' || coalesce(CAST(date_posted AS VARCHAR), 'None') || chr(10)
                   || 'Bildungs-Voraussetzungen: ' || educational_requirements || chr(10)
                   || 'Branche: ' || industry || chr(10) || 'Beschäftigungsverhältnis: ' || employment_type || chr(10)
                   || 'Berufserhfarung: ' || coalesce(experience_requirements, 'None') || chr(10)
                   || 'Anzeigentext:' || chr(10) || b || chr(10) AS value
            FROM f JOIN body ON id = doc_id""",
        "content_dedup": """
            SELECT md5('=' || text) AS fp, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""",
        "json_fields": """
            SELECT event_id, props ->> '$.k' AS k_text, CAST(props ->> '$.k' AS DOUBLE) AS k_number,
                   props ->> '$.k' AS k_joined, CAST(NULL AS VARCHAR) AS absent
            FROM events""",
        "line_sanitize": f"""
            WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
            s AS (SELECT doc_id, {_sanitized('l')} AS s FROM l)
            SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS line FROM s WHERE s IS NOT NULL""",
        "analyzer_tokens": f"""
            WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents)
            SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM t""",
        "word_filter": f"""
            SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS words,
                   CAST(len({_words('text')}) AS INTEGER) AS terms FROM documents""",
        "stop_word_join": f"""
            SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text', False)}) AS token FROM documents)
            WHERE token NOT {_IS_STOP} GROUP BY token""",
        "inverted_index": _INVERTED,
        "term_stats": f"""
            SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({_INVERTED}) GROUP BY term""",
        "headings_by_doc": f"""WITH {_LINES}
            SELECT doc_id, source, CAST(paragraph_number AS INTEGER) AS paragraph_number, paragraph_heading
            FROM documents LEFT JOIN paragraphs USING (doc_id)""",
        "field_exists": """
            SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id)
            WHERE quality IS NOT NULL GROUP BY lang""",
        "index_counts": f"WITH {_INDEX_COUNTS} SELECT * FROM counts",
        "index_info": f"""WITH {_INDEX_COUNTS}
            SELECT CAST(0 AS INTEGER) AS line_no, 'The Index contains ' || postings || ' Documents' AS value FROM counts
            UNION ALL
            SELECT 1, 'On Average every Document contains ' || avg_paragraphs || ' Paragraphs' FROM counts""",
        "fuzzy_expand": f"WITH {_EXPANDED} SELECT * FROM expanded",
        "ranked_search": f"WITH {_SCORED} SELECT doc_id, intent, micro / CAST(1000000 AS DOUBLE) AS score FROM scored",
        "search_status": f"""WITH {_SCORED}
            SELECT DISTINCT intent, CASE WHEN total IS NULL THEN 'empty' WHEN total = 1 THEN 'insufficient' ELSE 'ok' END AS status
            FROM terms LEFT JOIN found USING (intent)""",
        "score_cutoff": f"WITH {_KEPT} SELECT intent, cutoff / CAST(1000000 AS DOUBLE) AS cutoff FROM cutoffs",
        "median_cut": f"WITH {_KEPT} SELECT doc_id, intent, micro / CAST(1000000 AS DOUBLE) AS score FROM kept",
        "term_counts": f"WITH {_COUNTED} SELECT intent, term, cnt FROM counts",
        "term_counts_null_bucket": f"""WITH {_KEPT},
            w AS (SELECT intent, unnest(string_split(content, ' ')) AS w FROM kept JOIN headed USING (doc_id))
            SELECT intent, CASE WHEN length(w) > 5 AND w <> 'None' AND w NOT {_IS_STOP} THEN w END AS term, count(*) AS cnt
            FROM w GROUP BY 1, 2""",
        "term_profile": f"WITH {_COUNTED}, {_RANKED} SELECT * FROM sliced",
        "rank_slice": f"""WITH
            words AS (
              SELECT intent, doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos
              FROM (SELECT lang AS intent, doc_id, {_words('text')} AS w FROM documents)),
            counts AS (SELECT intent, term, count(*) AS cnt, min(row(doc_id, pos)) AS seen FROM words GROUP BY intent, term),
            {_RANKED}
            SELECT intent AS lang, term, cnt, rnk FROM sliced""",
        "report_lines": f"""WITH {_COUNTED}, {_RANKED}
            SELECT CASE intent WHEN 'tasks' THEN 'task_frequency' WHEN 'requirements' THEN 'requirements_frequency'
                   ELSE 'benefits_frequency' END AS report,
                   rnk AS line_no, term || ',' || cnt AS value
            FROM sliced
            UNION ALL
            SELECT CASE intent WHEN 'tasks' THEN 'task_frequency' WHEN 'requirements' THEN 'requirements_frequency'
                   ELSE 'benefits_frequency' END, 0, 'Für diese Anfrage waren zu wenig Dokumente vorhanden,0'
            FROM found WHERE total = 1""",
    }
    found["stored_reports"] = f"SELECT report, unnest(string_split(value, chr(10))) AS value FROM ({found['report_lines']})"
    found["stored_headings"] = found["headings_by_doc"]
    found["stored_search"], found["job_reports"] = found["ranked_search"], found["stored_reports"]
    for intent in ("tasks", "requirements", "benefits"):
        found[f"{intent}_profile"] = (
            f"WITH {_COUNTED}, {_RANKED} SELECT term, cnt, rnk FROM sliced WHERE intent = '{intent}'"
        )
    return found
