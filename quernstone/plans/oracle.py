"""SQL of the queries in catalogue.py for DuckDB, over the same tables."""

from __future__ import annotations

from quernstone.functions.text import STOPWORDS
from quernstone.operators.cluster import INDICATORS, TOPICS, WEB_WORDS

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"
_SPACES = "[ \\t\\n\\f\\r]+"


def terms_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9''-]+'), lambda r: lower(r)), lambda r: length(r) >= 2 AND regexp_matches(r, '[a-z]') AND NOT list_contains({_STOP}, r))"


def _chain(text: str, steps: list[tuple[str, str]], options: str = "g") -> str:
    for pattern, to in steps:
        text = "regexp_replace({}, '{}', {}, '{}')".format(text, pattern.replace("'", "''"), to, options)
    return text


def _squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '{_SPACES}', ' ', 'g'))"


_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"


def _part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{_URL}', {group})"


def _host(url: str) -> str:
    return f"regexp_replace(regexp_replace(lower({_part(url, 2)}), '^[^@]*@', ''), ':[0-9]*$', '')"


def _normal(url: str) -> str:
    scheme, authority, path = f"lower({_part(url, 1)})", f"lower({_part(url, 2)})", _part(url, 3)
    return (
        f"CASE WHEN regexp_matches({url}, '{_URL}') THEN {scheme} || '://' || CASE {scheme} WHEN 'http' THEN regexp_replace({authority}, ':80$', '') WHEN 'https' THEN regexp_replace({authority}, ':443$', '') ELSE {authority} END"
        f" || CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/$', '') END || {_part(url, 4)} ELSE {url} END"
    )


def _resolve(link: str, page: str) -> str:
    origin = f"{_part(page, 1)} || '://' || {_part(page, 2)}"
    folder = f"coalesce(nullif(regexp_replace({_part(page, 3)}, '[^/]*$', ''), ''), '/')"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} WHEN starts_with({link}, '//') THEN {_part(page, 1)} || ':' || {link} WHEN starts_with({link}, '/') THEN {origin} || {link}"
        f" WHEN starts_with({link}, '?') THEN {origin} || {_part(page, 3)} || {link} WHEN starts_with({link}, '#') THEN {origin} || {_part(page, 3)} || {_part(page, 4)} || {link} WHEN {link} = '' THEN {page} ELSE {origin} || {folder} || {link} END"
    )


_LATEST = "pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(CAST(crawled_at AS TIMESTAMP), TIMESTAMP '0001-01-01') DESC) AS rn FROM docs WHERE id IS NOT NULL) WHERE rn = 1)"
_HTML = _LATEST + ", html AS (SELECT id, url, '<html><head><title>' || coalesce(title, '') || '</title></head><body>' || coalesce(content_markdown, '') || '</body></html>' AS html FROM pages)"


def _corpus(source: str = "SELECT doc_id, text FROM documents", name: str = "") -> str:
    """CTEs of an index: toks, tokens, post, info, terms, n."""
    return f"""toks{name} AS (SELECT doc_id, {terms_sql("text")} AS t FROM ({source})),
tokens{name} AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks{name}),
post{name} AS (SELECT term, doc_id, list_sort(list(pos)) AS positions, count(*) AS tf FROM tokens{name} GROUP BY ALL),
info{name} AS (SELECT doc_id, len(t) AS token_count, len(list_distinct(t)) AS length FROM toks{name}),
terms{name} AS (SELECT term, count(*) AS df FROM post{name} GROUP BY term),
n{name} AS (SELECT count(*) AS n FROM info{name})"""


_D = "WITH " + _corpus()
_STORED = """info AS (SELECT doc_id, arg_max({'url': url, 'title': title, 'token_count': token_count, 'at_': at_}, row(coalesce(at_, TIMESTAMP '0001-01-01'), coalesce(token_count, -1))) AS i
  FROM (SELECT *, CAST(indexed_at AS TIMESTAMP) AS at_ FROM doc_info WHERE doc_id IS NOT NULL) GROUP BY doc_id),
post AS (SELECT term, doc_id, list_sort(list_distinct(flatten(list(positions)))) AS positions FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL AND positions IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) AS n FROM info)"""


def _tfidf(words: dict[str, int], tf: str) -> str:
    """CTE tfidf(doc_id, score) over post and n."""
    names = ", ".join(f"'{w}'" for w in words)
    times = "CASE term " + " ".join(f"WHEN '{w}' THEN {k}" for w, k in words.items()) + " END"
    return f"""q AS (SELECT term, ln(n / df) AS idf FROM (SELECT term, count(*) AS df FROM post WHERE term IN ({names}) GROUP BY term), n),
tfidf AS (SELECT doc_id, sum({tf} * idf * {times}) AS score FROM post JOIN q USING (term) GROUP BY doc_id)"""


def _boolean(must: list[str], should: list[str], bad: list[str], post: str = "post") -> str:
    def inside(words: list[str]) -> str:
        return "term IN (" + ", ".join(f"'{w}'" for w in words) + ")"

    every = inside([*must, *should, *bad])
    wanted = [f"count(DISTINCT term) FILTER (WHERE {inside(must)}) = {len(must)}"] if must else []
    wanted += [f"bool_or({inside(should)})"] if should else []
    return f"SELECT doc_id FROM {post} WHERE {every} GROUP BY doc_id HAVING ({' OR '.join(wanted)})" + (f" AND NOT bool_or({inside(bad)})" if bad else "")


_NAV_TITLE = "CASE WHEN contains(lower(coalesce(title, '')), '{0}') OR contains(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g'), '{1}') THEN 1 ELSE 0 END"
_DEPTH = "length(regexp_extract({0}, '^.*?://(.*)$', 1)) - length(replace(regexp_extract({0}, '^.*?://(.*)$', 1), '/', ''))"
_LABEL = f"regexp_replace(lower(split_part(regexp_replace({_host('url')}, '^www\\.', ''), '.', 1)), '[^a-z0-9]', '', 'g')"


def _pagerank(rounds: int) -> str:
    out = """e AS (SELECT src, dst, count(*) AS w FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
o AS (SELECT src, sum(w) AS a FROM e GROUP BY src), s AS (SELECT e.src, dst, w / a AS share FROM e JOIN o USING (src)),
nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), nn AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS score FROM nodes, nn)"""
    for i in range(rounds):
        out += f", r{i + 1} AS (SELECT id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(got, 0) AS score FROM nodes LEFT JOIN (SELECT dst AS id, sum(share * score) AS got FROM s JOIN r{i} ON src = id GROUP BY dst) USING (id), nn)"
    return out


def _snippet(body: str, words: list[str], length: int, before: int) -> str:
    places = ", ".join(f"nullif(strpos(lower(b), '{w}'), 0)" for w in words)
    return f"""SELECT doc_id, CASE WHEN length(b) = 0 OR inner_ = '' THEN '' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || inner_ || (CASE WHEN e < length(b) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT *, trim(substr(b, s + 1, e - s)) AS inner_ FROM (SELECT *, least(s + {length}, length(b)) AS e FROM (SELECT doc_id, b, greatest(coalesce(least({places}) - 1, 0) - {before}, 0) AS s FROM (SELECT doc_id, trim({body}) AS b FROM documents))))"""


_CANDIDATES = _LATEST + """, cand AS (SELECT id AS parent, depth + 1 AS depth, unnest(links) AS url FROM pages), pri AS (SELECT *, CASE WHEN contains(url, '/docs/') THEN 0 ELSE 1 END AS priority FROM cand WHERE url IS NOT NULL),
dedup AS (SELECT nurl AS url, m.parent AS parent, m.depth AS depth, m.priority AS priority FROM (SELECT nurl, arg_min({'parent': parent, 'depth': depth, 'priority': priority}, row(priority, depth, parent)) AS m FROM (SELECT *, """ + _normal("url") + """ AS nurl FROM pri) GROUP BY nurl))"""

_SENTENCES = f"list_filter(string_split(regexp_replace({_squeeze('text')}, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda s: s <> '')"
_KEY_TERMS = f"""kw AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w) AND w NOT IN ({', '.join(f"'{w}'" for w in WEB_WORDS)}))) AS term FROM documents),
kc AS (SELECT doc_id, term, count(*) AS count FROM kw GROUP BY ALL), kt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS place FROM kc QUALIFY place <= 10)"""
_MARKDOWN = [
    ("(?m)^[ ]{0,3}(```|~~~)[^\\n]*$", "' '"), ("<[a-zA-Z][a-zA-Z0-9+.-]*:[^<>\\s]*>", "' '"), ("<!--[^>]*-->", "' '"), ("</?[a-zA-Z][^<>]*>", "' '"), ("!?\\[([^\\[\\]]*)\\]\\([^()]*\\)", "'\\1'"),
    ("(?m)^[ ]{0,3}#{1,6}[ \\t]+", "' '"), ("(?m)^[ ]{0,3}>[ ]?", "' '"), ("(?m)^[ \\t]*[-*+][ \\t]+", "' '"), ("(?m)^[ ]{0,3}([-*_][ \\t]*){3,}$", "' '"), ("\\*\\*([^*\\n]+)\\*\\*", "'\\1'"), ("\\*([^*\\n]+)\\*", "'\\1'"), ("`([^`\\n]*)`", "'\\1'"),
]
_SANITIZE = [("(?is)<script[^>]*>.*?</script>", "''"), ("(?is)<style[^>]*>.*?</style>", "''"), ("(?s)<!--.*?-->", "''"), ("</?[A-Za-z!][^<>]*>", "''")]


def _escaped(text: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        text = f"replace({text}, '{sign}', '{name}')"
    return text


_BODY = _chain("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)", [(f"(?is)<{t}[^>]*>.*?</{t}>", "' '") for t in ("script", "style", "noscript")])
_PLAIN_BODY = _squeeze(f"regexp_replace({_BODY}, '<[^>]*>', ' ', 'g')")
_TITLE = _squeeze("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g')")
_CONTENT = _chain("coalesce(content_markdown, '')", _MARKDOWN)
_LINE_TRIM = "regexp_replace(x, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')"
_CLEAN_BASE = _chain("content_markdown", [("\\[([^\\]]+)\\]\\([^)]+\\)", "'\\1'"), ("\\n---+\\n", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)")])
_CLEAN_BAD = f"(len(string_split({_LINE_TRIM}, 'http')) - 1 > 3 OR regexp_matches({_LINE_TRIM}, '^[\\[/\\] \\t>-]+$') OR {_LINE_TRIM} = '404' OR contains(lower({_LINE_TRIM}), 'couldn''t find the page') OR (contains(lower({_LINE_TRIM}), 'helpful') AND length({_LINE_TRIM}) < 50))"
_TOPIC = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in TOPICS.items()) + " END"

_HALF = "SELECT doc_id, text || ' ' || text AS text FROM documents WHERE doc_id % 2 = 0"
_TWO = "WITH " + _corpus() + ", " + _corpus(_HALF, "2")
_COUNTS = "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM ({}) GROUP BY term"

_LEVENSHTEIN = "CASE WHEN {0} = {1} THEN 1.0 ELSE greatest(0.0, 1 - levenshtein({0}, {1}) / greatest(strlen({0}), strlen({1}))) END"
_PAIRS = "pairs AS (SELECT DISTINCT w[1] AS a, w[2] AS b FROM (SELECT string_split(lower(p_name), ' ') AS w FROM part) WHERE len(w) > 1 AND w[1] <> '' AND w[2] <> '')"


def _similar(words: list[str], threshold: float, n: int) -> str:
    out = " UNION ALL ".join(f"SELECT '{w}' AS query, term, levenshtein('{w}', term) AS distance, {_LEVENSHTEIN.format(repr(w), 'term')} AS similarity FROM terms" for w in words)
    return f"sim AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, term) AS place FROM ({out}) WHERE similarity >= {threshold} QUALIFY place <= {n})"


SQL: dict[str, str] = {
    "tokenize_documents": _D + " SELECT doc_id, term, pos FROM tokens",
    "postings_build": _D + " SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM post",
    "postings_pages": "WITH " + _LATEST + f""", toks AS (SELECT id AS doc_id, list_concat({terms_sql('title')}, {terms_sql("coalesce(nullif(" + _squeeze(_CONTENT) + ", ''), '') || ' ' || coalesce(url, '')")}) AS t FROM pages),
tokens AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, CAST(sum(pos) AS BIGINT) AS pos_sum FROM tokens GROUP BY term""",
    "doc_info_build": _D + " SELECT doc_id, token_count, length FROM info",
    "index_stats": _D + " SELECT (SELECT n FROM n) AS documents, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings, round(sum(df) / count(*), 6) AS avg_postings FROM terms",
    "top_terms_df": _D + " SELECT term, df FROM terms ORDER BY df DESC, term LIMIT 10",
    "index_validate": "WITH " + _STORED + """ SELECT 'orphan_posting' AS problem, doc_id, count(*) AS n FROM post WHERE doc_id NOT IN (SELECT doc_id FROM info) GROUP BY doc_id
UNION ALL SELECT 'no_terms', doc_id, 0 FROM info WHERE doc_id NOT IN (SELECT doc_id FROM post)""",
    "index_delete": _D + " " + _COUNTS.format("SELECT * FROM post WHERE doc_id % 2 <> 0"),
    "index_upsert": _TWO + " " + _COUNTS.format("SELECT * FROM post WHERE doc_id % 2 <> 0 UNION ALL SELECT * FROM post2"),
    "index_merge": _TWO + " SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT * FROM post UNION ALL SELECT * FROM post2) GROUP BY term",
    "search_and": _D + " " + _boolean(["driver", "packet"], [], []),
    "search_or": _D + " " + _boolean([], ["driver", "packet", "datei"], []),
    "search_not": _D + " " + _boolean(["driver"], [], ["packet"]),
    "search_mixed": _D + " " + _boolean([], ["driver", "packet", "kernel"], ["cache"]),
    "postings_set_operations": _D + """, a AS (SELECT doc_id, term, tf FROM post WHERE term = 'driver'), b AS (SELECT doc_id, term, tf FROM post WHERE term = 'packet')
SELECT 'intersect' AS operation, * FROM a WHERE doc_id IN (SELECT doc_id FROM b) UNION ALL SELECT 'union', * FROM a UNION ALL SELECT 'union', * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT 'difference', * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)""",
    "phrase_compat": _D + " " + _boolean(["rule", "thumb"], [], []),
    "phrase_exact": _D + " SELECT a.doc_id, a.pos FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'rule' AND b.term = 'thumb'",
    "proximity": _D + " SELECT DISTINCT a.doc_id, a.pos FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 6 WHERE a.term = 'driver' AND b.term = 'packet'",
    "tfidf_topk": _D + ", " + _tfidf({"driver": 2, "packet": 1}, "tf") + " SELECT doc_id, round(score, 6) AS score FROM tfidf ORDER BY round(score, 6) DESC, doc_id LIMIT 20",
    "doc_vectors": _D + " SELECT doc_id, term, round(tf * ln(n / df), 6) AS weight FROM post JOIN terms USING (term), n",
    "cosine_query": _D + """, v AS (SELECT doc_id, term, tf * ln(n / df) AS w FROM post JOIN terms USING (term), n), q AS (SELECT term, ln(n / df) AS w FROM terms, n WHERE term IN ('driver', 'packet'))
SELECT doc_id, round(dot / (norm * (SELECT sqrt(sum(w * w)) FROM q)), 6) AS cosine FROM (SELECT doc_id, sum(v.w * q.w) AS dot FROM v JOIN q USING (term) GROUP BY doc_id) JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id) USING (doc_id)""",
    "title_extract": "WITH " + _HTML + f" SELECT id, {_TITLE} AS title FROM html",
    "body_text": "WITH " + _HTML + f" SELECT id, {_PLAIN_BODY} AS body FROM html",
    "page_extract": "WITH " + _HTML + f" SELECT id, coalesce(nullif({_TITLE}, ''), url) AS title, length(coalesce(nullif({_PLAIN_BODY}, ''), nullif({_TITLE}, ''), url)) AS chars FROM html",
    "markdown_plain": "WITH " + _LATEST + f" SELECT id, {_squeeze(_chain('content_markdown', _MARKDOWN))} AS plain FROM pages",
    "markdown_normal": "WITH " + _LATEST + " SELECT id, regexp_replace(" + _chain("content_markdown", [("\\r\\n?", "chr(10)"), ("(?m)[ \\t]+$", "''"), ("\\n{3,}", "chr(10) || chr(10)")]) + ", '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS markdown FROM pages",
    "sanitize_titles": "WITH " + _LATEST + f" SELECT id, {_escaped(_chain('title', _SANITIZE))} AS title, md5({_escaped(_chain('content_markdown', _SANITIZE))}) AS content_md5 FROM pages",
    "page_links": "WITH " + _HTML + f""", hrefs AS (SELECT id, url, unnest(h) AS link, generate_subscripts(h, 1) AS k FROM (SELECT id, url, regexp_extract_all(html, '(?i)<a[ \\t\\n][^>]*?href[ ]*=[ ]*["'']([^"'']*)["'']', 1) AS h FROM html WHERE url IS NOT NULL)),
res AS (SELECT id, k, {_resolve('trim(link)', 'url')} AS r FROM hrefs), nor AS (SELECT id, {_normal('r')} AS link, min(k) AS k FROM res WHERE regexp_matches(r, '(?i)^https?://') GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS place, link FROM nor""",
    "embedded_links": "WITH " + _HTML + f""", quoted AS (SELECT id, url, replace(unnest(h), '\\/', '/') AS link, generate_subscripts(h, 1) AS k FROM (SELECT id, url, regexp_extract_all(html, '["'']((?:https?:)?(?:\\\\?/){{1,2}}[A-Za-z0-9_.~:/?#@!$&*+,;=%\\\\-]+)["'']', 1) AS h FROM html WHERE url IS NOT NULL)),
res AS (SELECT id, k, {_resolve('trim(link)', 'url')} AS r FROM quoted),
good AS (SELECT * FROM res WHERE regexp_matches(r, '(?i)^https?://') AND NOT regexp_matches(lower({_part('r', 3)}), '^/(img|images|contentimages|productimages|js|css|fonts|assets|static)/') AND regexp_extract(lower({_part('r', 3)}), '(\\.[^./]*)$', 1) NOT IN ('.js', '.css', '.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg', '.ico', '.woff', '.woff2', '.ttf', '.otf', '.eot', '.map', '.pdf', '.zip', '.gz', '.mp4', '.mov', '.webm', '.mp3', '.wav')),
nor AS (SELECT id, {_normal('r')} AS link, min(k) AS k FROM good GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS place, link FROM nor""",
    "url_normalize": "WITH " + _LATEST + f" SELECT url, normal, sha256(normal) AS hash FROM (SELECT url, {_normal('url')} AS normal FROM (SELECT unnest(links) AS url FROM pages))",
    "url_parts": f"SELECT DISTINCT url, {_DEPTH.format('url')} AS depth, coalesce({_LABEL}, '') AS label, {_part('url', 3)} IN ('', '/') AS home, coalesce(nullif({_part('url', 2)}, ''), url) AS domain, NOT regexp_matches(lower({_part('url', 3)}), '^/(img|images|contentimages|productimages|js|css|fonts|assets|static)/') AND regexp_extract(lower({_part('url', 3)}), '(\\.[^./]*)$', 1) NOT IN ('.js', '.css', '.png', '.html.gz', '.pdf', '.zip', '.gz', '.map') AS navigable FROM docs",
    "url_filters": "WITH " + _LATEST + f""" SELECT id, ({_host('url')} = 'test' OR ends_with({_host('url')}, '.test') OR {_host('url')} = 'docs.sovubumeta.example' OR ends_with({_host('url')}, '.docs.sovubumeta.example')) AS allowed,
starts_with({_part('url', 3)}, '/blog') OR starts_with({_part('url', 3)}, '/shop/') AS disallowed, {_host('url')} = 'sovubumeta.example' OR ends_with({_host('url')}, '.sovubumeta.example') AS matches FROM pages WHERE url IS NOT NULL""",
    "text_types": "SELECT event_id, event_type <> 'error' AS text_like FROM events",
    "export_names": "WITH " + _LATEST + f""", w AS (SELECT id, list_filter(list_transform(string_split({_part('url', 3)}, '/'), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> '') AS p FROM pages WHERE url IS NOT NULL)
SELECT id, CASE WHEN len(p) = 0 THEN 'index' ELSE array_to_string(p, '-') END AS slug, (CASE WHEN len(p) = 0 THEN 'index' ELSE array_to_string(p, '-') END) || '-' || substr(id, 1, 12) || '.md' AS file_name FROM w""",
    "domain_export": "WITH " + _LATEST + ", " + _STORED + f""", hit AS (SELECT doc_id, i.url AS url FROM info WHERE {_host('i.url')} = 'sovubumeta.example' OR ends_with({_host('i.url')}, '.sovubumeta.example')),
w AS (SELECT doc_id, list_filter(list_transform(string_split({_part('url', 3)}, '/'), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> '') AS p FROM hit)
SELECT w.doc_id, (CASE WHEN len(p) = 0 THEN 'index' ELSE array_to_string(p, '-') END) || '-' || substr(w.doc_id, 1, 12) || '.md' AS file_name, length(content_markdown) AS chars, content_markdown IS NULL AS missing FROM w LEFT JOIN pages ON pages.id = w.doc_id""",
    "export_totals": "WITH " + _LATEST + ", " + _STORED + f" SELECT count(*) AS matched, count(content_markdown) AS written, count(*) - count(content_markdown) AS skipped_missing FROM info LEFT JOIN pages ON pages.id = info.doc_id WHERE {_host('i.url')} = 'test' OR ends_with({_host('i.url')}, '.test')",
    "fuzzy_terms": _D + ", " + _similar(["paket", "drivre"], 0.6, 10) + " SELECT query, term, distance, round(similarity, 6) AS similarity, place FROM sim",
    "fuzzy_search": _D + ", " + _similar(["pakcet"], 0.7, 10) + " SELECT DISTINCT doc_id FROM post WHERE term IN (SELECT term FROM sim)",
    "suggest": _D + ", " + _similar(["driver", "paket"], 0.6, 5) + """, s AS (SELECT term, min(row(CASE query WHEN 'driver' THEN 0 ELSE 1 END, place)) AS o FROM sim WHERE term <> query GROUP BY term)
SELECT row_number() OVER (ORDER BY o) - 1 AS place, term FROM s ORDER BY o LIMIT 5""",
    "jaro_pairs": "WITH " + _PAIRS + " SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro FROM pairs",
    "jaro_winkler_pairs": "WITH " + _PAIRS + " SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM pairs",
    "levenshtein_pairs": "WITH " + _PAIRS + f" SELECT a, b, levenshtein(a, b) AS distance, round({_LEVENSHTEIN.format('a', 'b')}, 6) AS similarity FROM pairs",
    "pagerank_fixed": "WITH " + _pagerank(5) + " SELECT id, round(score, 9) AS score FROM r5",
    "pagerank_shares": "WITH " + _pagerank(3) + " SELECT id, round(score / (SELECT sum(score) FROM r3), 9) AS share, round(1 + 0.5 * score / (SELECT max(score) FROM r3), 6) AS boosted FROM r3",
    "link_degrees": "SELECT id, CAST(sum(o) AS BIGINT) AS out_links, CAST(sum(i) AS BIGINT) AS in_links FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst, 0, 1 FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY id",
    "links_resolved": "WITH " + _LATEST + f", l AS (SELECT id AS src, sha256({_normal('link')}) AS dst FROM (SELECT id, unnest(links) AS link FROM pages) WHERE link IS NOT NULL), k AS (SELECT DISTINCT sha256({_normal('url')}) AS dst FROM pages WHERE url IS NOT NULL) SELECT src, count(*) AS links, count(*) FILTER (WHERE dst IN (SELECT dst FROM k)) AS known FROM l GROUP BY src",
    "bfs_depth": "WITH " + _LATEST + """, e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL), l0 AS (SELECT DISTINCT id FROM pages WHERE depth = 0),
l1 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM l0) AND dst NOT IN (SELECT id FROM l0)),
l2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM l1) AND dst NOT IN (SELECT id FROM l0) AND dst NOT IN (SELECT id FROM l1))
SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2""",
    "snippet_content": _snippet("text", ["driver", "packet"], 220, 80),
    "snippet_phrase": """SELECT doc_id, (CASE WHEN s > 0 THEN '...' ELSE '' END) || substr(text, s + 1, least(s + 200, length(text)) - s) || (CASE WHEN least(s + 200, length(text)) < length(text) THEN '...' ELSE '' END) AS snippet
FROM (SELECT doc_id, text, CASE WHEN strpos(lower(text), 'rule of thumb') > 0 THEN greatest(strpos(lower(text), 'rule of thumb') - 51, 0) ELSE 0 END AS s FROM documents)""",
    "snippet_title": "WITH " + _LATEST + " SELECT id, CASE WHEN length(title) > 30 THEN substr(title, 1, 30) || '...' ELSE title END AS snippet, length(substr(array_to_string(string_split(content_markdown, chr(10))[1:20], chr(10)), 1, 600)) AS preview FROM pages",
    "paginate": "SELECT position, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents) WHERE position > 40 AND position <= 60",
    "url_dedupe": "WITH " + _CANDIDATES + " SELECT url, parent, depth, priority FROM dedup",
    "admission": "WITH " + _CANDIDATES.replace("cand WHERE url IS NOT NULL", "cand WHERE url IS NOT NULL AND depth <= 3") + f" SELECT url, depth, priority FROM dedup WHERE url NOT IN (SELECT {_normal('url')} FROM pages WHERE url IS NOT NULL) ORDER BY priority, depth, url LIMIT 100",
    "frontier_order": "WITH " + _CANDIDATES + " SELECT url, priority, depth FROM dedup ORDER BY priority, depth, url LIMIT 50",
    "politeness_schedule": "WITH " + _CANDIDATES + f" SELECT host, count(*) AS urls, (count(*) - 1) * 1000 AS last_ms, count(*) AS slots FROM (SELECT {_host('url')} AS host FROM dedup) GROUP BY host",
    "backoff_fold": """WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS domain, event_id, CAST(ts AS TIMESTAMP) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts IS NOT NULL),
walk AS (SELECT domain, event_id, ts, k, 86400 AS backoff FROM ev WHERE k = 1
UNION ALL SELECT e.domain, e.event_id, e.ts, e.k, CASE WHEN epoch_us(e.ts) - epoch_us(w.ts) < CAST(w.backoff AS BIGINT) * 1000000 THEN least(w.backoff * 2, 1382400) ELSE 86400 END FROM walk w JOIN ev e ON e.domain = w.domain AND e.k = w.k + 1)
SELECT domain, event_id, backoff FROM walk""",
    "retry_policy": """WITH r AS (SELECT event_id, [429, 503, 500, 404, 0][event_id % 5 + 1] AS status, CAST(user_id % 5 AS INT) AS attempt, CASE WHEN value > 15 THEN CAST(floor(value) AS BIGINT) END AS after_, event_type FROM events)
SELECT event_id, attempt < 3 AND (status = 429 OR status BETWEEN 500 AND 599 OR status = 0) AS retry, coalesce(after_, (attempt + 1) * CASE status WHEN 429 THEN 30 WHEN 503 THEN 10 ELSE 5 END) AS delay,
CASE WHEN status = 429 THEN 'rate-limited' WHEN status = 403 THEN 'blocked' WHEN status = 503 THEN 'rate-limited' WHEN event_type = 'view' THEN 'blocked' END AS block FROM r""",
    "robots_filter": "WITH " + _LATEST + f", h AS (SELECT DISTINCT url, {_host('url')} AS host, {_part('url', 3)} AS path FROM pages WHERE url IS NOT NULL) SELECT url FROM h WHERE NOT (host = 'bozokuluro.test') AND NOT (host = 'docs.sovubumeta.example' AND starts_with(path, '/posts/') AND NOT starts_with(path, '/posts/s'))",
    "crawl_counters": f"SELECT {_host('url')} AS host, count(*) FILTER (WHERE NOT coalesce(depth > 3, false)) AS crawled, count(*) FILTER (WHERE coalesce(depth > 3, false)) AS failed FROM docs WHERE url IS NOT NULL GROUP BY 1",
    "seed_sets": "SELECT * FROM (VALUES ('general', 10), ('programming', 18), ('academic', 17)) t(set_name, urls)",
    "gap_encode": _D + """, g AS (SELECT term, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS g FROM tokens)
SELECT term, count(*) AS n, CAST(sum(CASE WHEN g < 128 THEN 1 WHEN g < 16384 THEN 2 WHEN g < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS bytes, round(sum(CASE WHEN g < 128 THEN 1 WHEN g < 16384 THEN 2 WHEN g < 2097152 THEN 3 ELSE 4 END) / (count(*) * 4), 6) AS ratio, CAST(floor(count(*) * 3 / 2) AS INT) AS estimate FROM g GROUP BY term""",
    "clean_documents": "WITH " + _LATEST + f""" SELECT id, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(string_split({_CLEAN_BASE}, chr(10)), lambda x: {_LINE_TRIM} = '' OR NOT {_CLEAN_BAD}), lambda x: CASE WHEN regexp_matches(x, '^[ \\t\\r\\f]*$') THEN '' ELSE x END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS clean FROM pages""",
    "documents_long_enough": "SELECT doc_id FROM documents WHERE length(text) >= 900 AND len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r*|-]+', ' ', 'g')), ' ')) >= 120",
    "key_terms": "WITH " + _KEY_TERMS + " SELECT doc_id, term, count, place FROM kt",
    "key_points": f"""WITH s AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS i FROM (SELECT doc_id, {_SENTENCES}[1:50] AS p FROM documents)),
c AS (SELECT *, greatest(0, 10 - i) + CASE WHEN length(sentence) > 50 AND length(sentence) < 180 THEN 5 ELSE 0 END + {' + '.join(f"CASE WHEN contains(lower(sentence), '{w}') THEN 2 ELSE 0 END" for w in INDICATORS)} + CASE WHEN ends_with(sentence, '?') THEN 0 ELSE 2 END AS score FROM s WHERE length(sentence) BETWEEN 30 AND 250)
SELECT doc_id, sentence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM c QUALIFY place <= 5""",
    "topics": "WITH " + _KEY_TERMS + f""", f AS (SELECT doc_id, arg_min({_TOPIC.replace('(t,', '(term,')}, place) FILTER (WHERE place <= 5 AND {_TOPIC.replace('(t,', '(term,')} IS NOT NULL) AS topic, arg_min(term, place) AS first FROM kt GROUP BY doc_id)
SELECT doc_id, coalesce(topic, upper(substr(first, 1, 1)) || substr(first, 2)) AS topic FROM f""",
    "content_titles": """SELECT doc_id, coalesce(trim(regexp_replace(list_filter(list_transform(string_split(trim(text), chr(10))[1:10], lambda x: trim(x)), lambda x: starts_with(x, '# ') OR starts_with(x, '## '))[1], '^##? ', '')), 'Note ' || CAST(doc_id AS VARCHAR)) AS title FROM documents""",
    "cluster_terms": f"""WITH kw AS (SELECT doc_id % 10 AS cluster, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda w: NOT list_contains({_STOP}, w) AND w NOT IN ({', '.join(f"'{w}'" for w in WEB_WORDS)}))) AS term FROM documents),
kt AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, term) AS place FROM (SELECT cluster, term, count(*) AS count FROM kw GROUP BY ALL) QUALIFY place <= 10),
f AS (SELECT cluster, string_agg(term, ',' ORDER BY place) AS key_terms, arg_min({_TOPIC.replace('(t,', '(term,')}, place) FILTER (WHERE place <= 5 AND {_TOPIC.replace('(t,', '(term,')} IS NOT NULL) AS topic, arg_min(term, place) AS first FROM kt GROUP BY cluster),
s AS (SELECT doc_id % 10 AS cluster, count(*) AS docs, array_to_string(list_sort(list(doc_id))[1:10], ',') AS sources FROM documents GROUP BY 1)
SELECT cluster, docs, key_terms, coalesce(topic, upper(substr(first, 1, 1)) || substr(first, 2)) AS topic, sources FROM s JOIN f USING (cluster)""",
    "stream_new_urls": f"SELECT DISTINCT {_normal('url')} AS url FROM docs WHERE url IS NOT NULL",
}

_BM25 = _D + """, m AS (SELECT sum(token_count) / count(*) AS mean FROM info), q AS (SELECT term, ln(n / df) AS idf FROM terms, n WHERE term IN ('driver', 'packet', 'kernel')),
b AS (SELECT doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * token_count / mean))), 6) AS score FROM post JOIN q USING (term) JOIN info USING (doc_id), m GROUP BY doc_id)"""
SQL["bm25_all"] = _BM25 + " SELECT doc_id, score FROM b"
SQL["bm25_topk"] = _BM25 + " SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20"
SQL["search_flagship"] = _D + ", " + _tfidf({"driver": 1, "packet": 1}, "tf") + f""", hit AS ({_boolean(['driver', 'packet'], [], [])}),
sc AS (SELECT doc_id, 0.7::DOUBLE * score / (1 + score) + 0.1::DOUBLE / greatest(coalesce({_DEPTH.format('url')}, 0), 1) AS score FROM hit JOIN tfidf USING (doc_id) JOIN documents USING (doc_id))
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS position, doc_id, round(score, 6) AS score FROM sc ORDER BY score DESC, doc_id LIMIT 10"""
_NAV = f"CASE WHEN {_LABEL} IN ({{}}) THEN 0.2::DOUBLE + CASE WHEN {_part('url', 3)} IN ('', '/') THEN 0.8::DOUBLE ELSE 0 END ELSE 0 END"
SQL["navigational_rank"] = "WITH " + _LATEST + f""" SELECT id, round({_NAV.format("'docs', 'blog', 'docsblog'")}, 6) AS boost, round(1.5::DOUBLE * ({_NAV_TITLE.format('tuning', 'tuning')} + {_NAV_TITLE.format('first look', 'firstlook')}) / 2, 6) AS title_boost, round(0.1::DOUBLE / greatest(coalesce({_DEPTH.format('url')}, 0), 1), 6) AS depth_boost FROM pages"""


def _combined(must: list[str], should: list[str], words: list[str], pagerank: bool) -> str:
    nav = _NAV.format(", ".join(f"'{w}'" for w in [*words, "".join(words)]))
    titles = " + ".join(_NAV_TITLE.format(w, w) for w in words)
    pr = "0.3::DOUBLE * coalesce(pr.score / (1 + pr.score), 0)" if pagerank else "0"
    age = "(epoch_us(TIMESTAMP '2024-03-01') - epoch_us(at_)) / 86400e6"
    fresh = f"CASE WHEN {age} < 30 THEN 0.1::DOUBLE * (1 - {age} / 30) ELSE 0 END" if pagerank else "0"
    return "WITH " + _STORED + ", " + (_pagerank(3) + ", " if pagerank else "") + _tfidf(dict.fromkeys(words, 1), "len(positions)") + f""", hit AS ({_boolean(must, should, [])}), rows_ AS (SELECT doc_id, i.url AS url, i.title AS title, i.at_ AS at_ FROM info WHERE doc_id IN (SELECT doc_id FROM hit)),
sc AS (SELECT doc_id, title, round(0.7::DOUBLE * coalesce(t.score / (1 + t.score), 0) + {pr} + 1.5::DOUBLE * ({titles}) / {len(words)} + 0.1::DOUBLE / greatest(coalesce({_DEPTH.format('url')}, 0), 1) + coalesce({fresh}, 0) + coalesce({nav}, 0), 6) AS score
FROM rows_ LEFT JOIN tfidf t USING (doc_id){' LEFT JOIN r3 pr ON pr.id = doc_id' if pagerank else ''})"""


SQL["combined_rank"] = _combined(["packet", "driver"], [], ["packet", "driver"], True) + " SELECT doc_id, score FROM sc"
SQL["ranked_results"] = _combined([], ["packet", "driver"], ["packet", "driver"], False) + " SELECT position, doc_id, score, CASE WHEN length(title) > 200 THEN substr(title, 1, 200) || '...' ELSE title END AS snippet FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM sc) WHERE position <= 50"
