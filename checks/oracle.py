"""The same results in plain SQL, written against the raw tables."""

from __future__ import annotations

from checks.fixtures import BOXES, RUN_TS, WORDS
from newscorpus import values
from newscorpus.functions.density import Weights
from newscorpus.functions.markup import COMMON_ENTITIES

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Names that HTML decodes without their semicolon too. Some given pages end on a cut "&amp".
UNTERMINATED = ["&nbsp;", "&lt;", "&gt;", "&quot;", "&copy;", "&middot;", "&amp;"]


def decode(x: str) -> str:
    for entity, char in COMMON_ENTITIES.items():
        if entity in UNTERMINATED:
            x = f"regexp_replace({x}, '{entity}?', {quoted(char)}, 'g')"
        else:
            x = f"replace({x}, {quoted(entity)}, {quoted(char)})"
    return rf"regexp_replace({x}, '(\x{{A0}}|&nbsp;)+', ' ', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '[ \t\n\r\f\x0B\x{{A0}}]+', ' ', 'g')"


# What stands between a tag's name and its end, quoted values in one piece.
ATTRS = r"""(?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*"""


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '</?[a-zA-Z!?]{ATTRS}>', ' ', 'g')"


def readable(x: str) -> str:
    return f"trim({collapse(decode(strip_tags(x)))})"


def drop(x: str, tags: list[str]) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in tags:
        x = rf"regexp_replace({x}, '(?is)<{tag}(\s{ATTRS})?>.*?</{tag}\s*>', ' ', 'g')"
    return x


def main(x: str) -> str:
    return (
        rf"regexp_replace({drop(x, values.DROP_TAGS)}, "
        rf"'(?is)^.*?<article(\s{ATTRS})?>(.*)</article\s*>.*$', '\2')"
    )


def marked(x: str, tags: list[str]) -> str:
    names = "|".join(sorted({*tags, *values.BLOCK_LEVEL}))
    x = (
        rf"regexp_replace({x}, '(?i)<(/?({names}))([\s/]{ATTRS})?>', "
        r"chr(1) || '\1' || chr(2), 'g')"
    )
    return collapse(decode(f"chr(2) || {strip_tags(x)}"))


def listed(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def sql_in(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


P = """p AS (
  SELECT page_id, url, html, regexp_extract(url, '^[^/]+//[^/]+/([^/?#]+)', 1) AS section_key,
         md5(url) AS article_key
  FROM pages)"""


def blocks(source: str, key: str, text: str, tags: list[str]) -> str:
    """CTEs b (all blocks), n (with text) from ``source``."""
    return f"""
pieces AS (SELECT {key}, string_split({marked(text, tags)}, chr(1)) AS parts FROM {source}),
cut AS (
  SELECT {key}, unnest(parts) AS piece, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos
  FROM pieces),
b AS (
  SELECT {key}, pos,
         CASE WHEN lower(split_part(piece, chr(2), 1)) IN {sql_in(tags)}
              THEN lower(split_part(piece, chr(2), 1)) ELSE '' END AS tag,
         trim(split_part(piece, chr(2), 2)) AS text
  FROM cut),
n AS (SELECT * FROM b WHERE text <> '')"""


PAGE_BLOCKS = f"{P},{blocks('p', 'page_id', main('html'), values.CLEAN_TAGS)}"


def tagged(headings: list[str]) -> str:
    return f"CASE WHEN tag IN {sql_in(headings)} THEN 'h2' ELSE 'p' END"


def cleaned(words: list[str]) -> str:
    """CTE c: what clean_corpus gives."""
    return f"""{PAGE_BLOCKS},
u AS (SELECT * FROM n WHERE NOT {listed("text", words)}),
d AS (
  SELECT page_id, pos, {tagged(values.CLEAN_HEADINGS)} AS tag, text FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS copy FROM u)
  WHERE copy = 1),
raw_n AS (SELECT page_id, count(*) AS k FROM n GROUP BY page_id),
kept_n AS (SELECT page_id, count(*) AS k FROM u GROUP BY page_id),
bodies AS (
  SELECT page_id, count(*) AS k,
         string_agg('<' || tag || '>' || text || '</' || tag || '>', chr(10) ORDER BY pos) AS body
  FROM d GROUP BY page_id),
c AS (
  SELECT page_id, url, section_key, article_key, coalesce(raw_n.k, 0) AS n_raw,
         coalesce(bodies.k, 0) AS n_blocks, coalesce(body, '') AS body,
         CAST(strlen(coalesce(body, '')) AS BIGINT) AS n_bytes,
         coalesce(raw_n.k, 0) - coalesce(kept_n.k, 0) AS n_unwanted,
         coalesce(kept_n.k, 0) - coalesce(bodies.k, 0) AS n_repeated
  FROM p LEFT JOIN raw_n USING (page_id) LEFT JOIN kept_n USING (page_id)
         LEFT JOIN bodies USING (page_id))"""


def dense(source: str, text: str, weights: Weights = Weights()) -> str:
    """CTEs s (all blocks with their worth), r (the best run of each page) and k (its blocks) from ``source``."""
    linked = rf"""regexp_replace(regexp_replace({main(text)}, '(?i)<a(\s{ATTRS})?>', chr(3), 'g'), '(?i)</a\s*>', chr(4), 'g')"""
    inside = "CASE WHEN contains(p, chr(4)) THEN split_part(p, chr(4), 1) ELSE split_part(p, chr(1), 1) END"
    again = rf"regexp_replace({inside}, '(\x01[^\x02]*\x02)', chr(4) || '\1' || chr(3), 'g')"
    rest = f"replace(substr(p, length({inside}) + 1), chr(4), '')"
    w = weights
    return rf"""
m AS (SELECT page_id, {marked(linked, values.CLEAN_TAGS)} AS t FROM {source}),
even AS (
  SELECT page_id, string_split(array_to_string(list_transform(string_split(t, chr(3)), lambda p, i:
    CASE WHEN i = 1 THEN replace(p, chr(4), '') ELSE chr(3) || {again} || chr(4) || {rest} END), ''), chr(1)) AS parts FROM m),
piece AS (
  SELECT page_id, unnest(parts) AS piece, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos FROM even),
named AS (
  SELECT page_id, pos, lower(split_part(piece, chr(2), 1)) AS name, split_part(piece, chr(2), 2) AS raw FROM piece),
texts AS (
  SELECT page_id, pos, name, trim({collapse("translate(raw, chr(3) || chr(4), '')")}) AS text,
    length(trim({collapse(r"regexp_replace(raw, '\x03[^\x04]*\x04', ' ', 'g')")})) AS n_plain FROM named),
counts AS (
  SELECT page_id, pos, CASE WHEN name IN {sql_in(values.CLEAN_TAGS)} THEN name ELSE '' END AS tag, text, length(text) AS n_chars,
    greatest(length(text) - n_plain, 0) AS link_chars, length(text) - length(translate(text, '{values.SENTENCE_MARKS}', '')) AS n_marks,
    CAST(CASE WHEN ltrim(name, '/') NOT IN {sql_in(values.CONTAINERS)} THEN 0 WHEN name LIKE '/%' THEN -1 ELSE 1 END AS BIGINT) AS step
  FROM texts),
s AS (
  SELECT *, CASE WHEN text = '' THEN 0 ELSE
    {w.char} * (n_chars - link_chars) + {w.mark} * n_marks - {w.link} * link_chars - {w.block} END AS score FROM counts),
deep AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM s),
toll AS (
  SELECT *, {w.level} * coalesce(abs(depth - lag(depth) OVER (PARTITION BY page_id ORDER BY pos)), 0) AS toll FROM deep WHERE text <> ''),
worth AS (SELECT *, sum(score - toll) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM toll),
runs AS (
  SELECT a.page_id, a.pos AS first, b.pos AS last, CAST(b.total - a.total + a.score AS BIGINT) AS run_score
  FROM worth a JOIN worth b ON a.page_id = b.page_id AND a.pos <= b.pos),
r AS (
  SELECT * FROM runs WHERE run_score > 0
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY run_score DESC, last, first DESC) = 1),
since AS (
  SELECT r.page_id, coalesce(max(pos) FILTER (tag NOT IN {sql_in(values.CLEAN_HEADINGS)} OR link_chars * 2 > n_chars), -1) AS since
  FROM r LEFT JOIN worth ON worth.page_id = r.page_id AND pos < first GROUP BY r.page_id),
k AS (
  SELECT page_id, pos, tag, text FROM worth JOIN r USING (page_id) JOIN since USING (page_id) WHERE pos > since AND pos <= last)"""


BOXED = rf"{P}, boxed AS (SELECT page_id, section_key, regexp_replace(html, '(?i)<(/?)({BOXES})([\s>])', '<\1div\3', 'g') AS html FROM p)"

CLEANED = cleaned(WORDS)

DATES = """dates AS (
  SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS published_at,
         o_orderdate + INTERVAL 40 DAY AS fetched_at
  FROM orders)"""

PAGE_LINKS = """some_links AS (
  SELECT section_key, page_id // 25 AS page_no, page_id % 25 AS pos, url, article_key
  FROM p WHERE page_id % 3 <> 0),
page_links AS (
  SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY page_no, pos, url) - 1 AS rank
  FROM (SELECT * FROM some_links UNION ALL
        SELECT section_key, page_no + 1000000000, pos, url, article_key
        FROM some_links WHERE (page_no * 25 + pos) % 6 = 1))"""

RANKED = """ranked AS (
  SELECT c.*, published_at, fetched_at, rank,
         strftime(coalesce(published_at, fetched_at), '%Y-%m') AS month
  FROM c JOIN dates USING (page_id) LEFT JOIN (
    SELECT section_key, article_key, min(rank) AS rank FROM page_links
    GROUP BY section_key, article_key) USING (section_key, article_key))"""


def placed(source: str) -> str:
    order = "ORDER BY rank NULLS LAST, fetched_at, article_key"
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""compiled AS (
  SELECT *, row_number() OVER (PARTITION BY section_key, month {order}) AS position,
    CAST(coalesce(sum(n_blocks) OVER (PARTITION BY section_key, month {order} {frame}), 0) AS BIGINT) AS start_block,
    CAST(coalesce(sum(n_bytes) OVER (PARTITION BY section_key, month {order} {frame}), 0) AS BIGINT) AS start_byte
  FROM {source})"""


COMPILED = f"{CLEANED}, {DATES}, {PAGE_LINKS}, {RANKED}, {placed('ranked')}"

DIM = """dim(section_key, name_native, name_english, path) AS (VALUES
  ('en', 'English', 'English', '/category/en/'),
  ('FR', 'Français', 'French', '/category/fr/'),
  ('de', 'Deutsch', 'German', '/category/misc/de/'))"""

CAPITAL = "upper(k.section_key[1]) || lower(k.section_key[2:])"


def named(source: str) -> str:
    """CTE named: rows of ``source`` with section name and path."""
    return f"""named AS (
  SELECT k.*, coalesce(dim.name_english, {CAPITAL}) AS section_name,
         coalesce(dim.path, '/category/' || lower(k.section_key) || '/') AS section_path
  FROM {source} k LEFT JOIN dim ON lower(k.section_key) = lower(dim.section_key))"""


def manifest(source: str) -> str:
    return f""", {DIM}, totals AS (
  SELECT section_key, month, CAST(grouping(section_key, month) AS BIGINT) AS level,
         count(*) AS n_articles, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
         min(published_at) AS first_date, max(published_at) AS last_date
  FROM {source} GROUP BY ROLLUP (section_key, month)), {named("totals")}
SELECT section_key, month, level,
       CASE WHEN level = 0 THEN section_name || '/{values.OUTPUT_PREFIX}_' || section_name || '_' || month
       END AS file_name, n_articles, n_bytes, n_bytes / 1048576.0::DOUBLE AS size_mib, first_date, last_date
FROM named"""


LINKS = rf"""found AS (
  SELECT section_key, page_id AS page_no, unnest(items) AS item,
         CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT *, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM p)),
links AS (
  SELECT section_key, page_no, pos, {decode('''regexp_extract(item, 'href="([^"]*)"', 1)''')} AS url,
         {readable("regexp_extract(item, '(?s)<a[^>]*>(.*?)</a>', 1)")} AS title
  FROM found),
firsts AS (
  SELECT section_key, page_no, pos, url, title FROM (
    SELECT *, row_number() OVER (PARTITION BY section_key, url ORDER BY page_no, pos) AS sighting
    FROM links) WHERE sighting = 1)"""

LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS section_key, event_id, ts, event_type <> 'error' AS ok,
         CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 0 ELSE 1 END AS n_links,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_no
  FROM events)"""

OUTCOMES = f"""{LOG}, attempts AS (
  SELECT CAST(CAST(section_key AS BIGINT) % 14 AS VARCHAR) AS section_key,
         CASE WHEN CAST(section_key AS BIGINT) % 50 <> 0 THEN '/a/' || section_key ELSE '' END AS url,
         page_no AS attempt, ok
  FROM log WHERE page_no <= 4),
tries AS (
  SELECT section_key, url, min(CASE WHEN ok THEN attempt END) AS first_ok, max(attempt) AS made
  FROM attempts GROUP BY section_key, url),
outcomes AS (
  SELECT section_key, url, first_ok IS NOT NULL AS success,
         coalesce(first_ok, made) - 1 AS n_retries,
         CAST([0, 2, 5, 9.5][least(coalesce(first_ok - 1, made), 3) + 1] AS DOUBLE) AS wait_seconds
  FROM tries)"""

CACHED = "cached AS (SELECT DISTINCT section_key, article_key FROM p WHERE page_id % 2 = 0)"

DAY = "CAST(DATE '2020-01-01' + CAST(page_id % 1500 AS INTEGER) AS DATE)"

BYLINED = f"""bylined AS (
  SELECT *, strftime({DAY}, '%Y-%m-%d') AS day, page_id % 4 AS kind FROM p)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("read_pages", f"WITH {P} SELECT page_id, url, section_key, length(html) AS n_chars FROM p")
oracle(
    "read_sections",
    f"""WITH {P}, {DIM}, k AS (SELECT section_key AS s, count(*) AS n_pages FROM p GROUP BY s)
SELECT dim.*, n_pages FROM dim LEFT JOIN k ON lower(dim.section_key) = s""",
)
oracle(
    "write_corpus",
    f"WITH {CLEANED} SELECT section_key, article_key, url, n_blocks, n_bytes FROM c",
)
oracle("write_manifest", f"WITH {COMPILED}{manifest('compiled')}")
oracle(
    "read_progress",
    f"""WITH {P}, urls AS (
  SELECT page_id, section_key, page_id % 4 AS kind,
         regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS all_urls FROM p),
items AS (
  SELECT page_id, section_key, kind, unnest(all_urls) AS url,
         generate_subscripts(all_urls, 1) AS n FROM urls),
unique_items AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY n) AS copy FROM items)
  WHERE copy = 1 OR kind < 2)
SELECT page_id, section_key,
       row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, url,
       CASE WHEN kind = 0 THEN upper(url) END AS title
FROM unique_items""",
)
oracle(
    "read_progress_ledger",
    """SELECT o_orderkey, 'c' || o_custkey AS section_key, o_orderstatus = 'F' AS completed,
       o_orderkey AS n_links, o_orderdate AS updated_at FROM orders""",
)
oracle(
    "normalize_section",
    f"""WITH {P}, {DIM}, k0 AS (
  SELECT page_id, CASE WHEN page_id % 2 = 1 THEN upper(section_key) ELSE section_key END AS section_key
  FROM p), {named("k0")} SELECT * FROM named""",
)
oracle(
    "select_sections",
    f"WITH {P} SELECT page_id, section_key FROM p WHERE section_key IN ('en', 'de')",
)
oracle(
    "listing_frontier",
    f"""WITH {P}, {DIM}, k0 AS (SELECT DISTINCT section_key FROM p), {named("k0")}
SELECT section_key, CAST(n AS BIGINT) AS page_no,
       '{values.BASE_URL}' || section_path || CASE WHEN n = 1 THEN '' ELSE 'page/' || n || '/' END AS url
FROM named, generate_series(1, 5) AS t(n)""",
)
oracle(
    "article_key",
    f"WITH {P} SELECT page_id, url, article_key, article_key[1:8] AS short_key FROM p",
)
for key, width in (("key_collisions", 8), ("key_collisions_narrow", 3)):
    oracle(
        key,
        f"""WITH {P}, k AS (
  SELECT DISTINCT section_key, article_key[1:{width}] AS short_key, url FROM p),
g AS (SELECT section_key, short_key, count(*) AS n_urls FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT section_key, short_key, url, n_urls FROM k JOIN g USING (section_key, short_key)""",
    )
oracle(
    "strip_chrome",
    f"""SELECT page_id, regexp_replace({drop("html", ["script", "style"])}, '(?s)<div class="ad">.*?</div>', '', 'g') AS html
FROM pages""",
)
oracle(
    "scope_container",
    f"""SELECT page_id, CASE WHEN contains(html, '<div class="ad">')
  THEN regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) ELSE html END AS html
FROM (SELECT page_id, {drop("html", ["script", "style"])} AS html FROM pages)""",
)
oracle("extract_links", f"WITH {P}, {LINKS} SELECT * FROM links WHERE url <> ''")
oracle("dedup_links", f"WITH {P}, {LINKS} SELECT * FROM firsts")
oracle(
    "discovery_rank",
    f"""WITH {P}, {LINKS}
SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY page_no, pos) - 1 AS rank FROM firsts""",
)
oracle(
    "listing_stop",
    f"""WITH {LOG}, stretches AS (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY section_key ORDER BY page_no) AS stretch
  FROM log),
counted AS (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
    PARTITION BY section_key, stretch ORDER BY page_no) AS in_a_row FROM stretches),
stops AS (
  SELECT section_key, min(page_no) AS stop_page,
         arg_min(CASE WHEN ok THEN 'no links' ELSE 'errors' END, page_no) AS stop_reason
  FROM counted WHERE in_a_row = 4 OR (ok AND n_links = 0) GROUP BY section_key)
SELECT section_key, page_no, event_id, ok, stop_page, stop_reason
FROM log LEFT JOIN stops USING (section_key)
WHERE (stop_page IS NULL OR page_no < stop_page) AND page_no <= 60""",
)
STOPS = """stretches AS (
  SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY section_key ORDER BY page_no) AS stretch
  FROM tried),
counted AS (
  SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (
    PARTITION BY section_key, stretch ORDER BY page_no) AS in_a_row FROM stretches),
stops AS (
  SELECT section_key, min(page_no) AS stop_page,
         arg_min(CASE WHEN ok THEN 'no links' ELSE 'errors' END, page_no) AS stop_reason
  FROM counted WHERE in_a_row = 4 OR (ok AND n_links = 0) GROUP BY section_key)"""
oracle(
    "listing_stop_uncapped",
    f"""WITH {LOG}, tried AS (SELECT * FROM log), {STOPS}
SELECT section_key, page_no, event_id, stop_page, stop_reason FROM log LEFT JOIN stops USING (section_key)
WHERE stop_page IS NULL OR page_no < stop_page""",
)
oracle(
    "listing_stop_attempts",
    f"""WITH {LOG}, tried AS (
  SELECT section_key, (page_no + 1) // 2 AS page_no, bool_or(ok) AS ok, max(n_links) FILTER (ok) AS n_links
  FROM log GROUP BY ALL), {STOPS}
SELECT * FROM stops""",
)
oracle("extract_links_decoys", f"WITH {P}, {LINKS} SELECT * FROM links WHERE url <> ''")
oracle(
    "discovery_counts",
    f"""WITH {P}, {LINKS}
SELECT section_key, page_no, count(*) AS n_links, CAST(grouping(section_key, page_no) AS BIGINT) AS level
FROM firsts GROUP BY ROLLUP (section_key, page_no)""",
)
oracle(
    "stamp_run",
    f"WITH {P} SELECT page_id, section_key, TIMESTAMP '{RUN_TS}' AS discovered_at FROM p",
)
oracle(
    "pending_articles",
    f"""WITH {P}, {PAGE_LINKS}, {CACHED}
SELECT section_key, page_no, pos, url, rank, article_key FROM (
  SELECT *, row_number() OVER (PARTITION BY section_key, article_key ORDER BY page_no, pos) AS sighting
  FROM page_links) WHERE sighting = 1 AND (section_key, article_key) NOT IN (SELECT * FROM cached)""",
)
oracle("fetch_outcomes", f"WITH {OUTCOMES} SELECT * FROM outcomes")
oracle(
    "fetch_summary",
    f"""WITH {OUTCOMES}
SELECT section_key, count(*) FILTER (success AND url <> '') AS n_success, count(*) AS n_total,
       CAST(grouping(section_key) AS BIGINT) AS level
FROM outcomes GROUP BY ROLLUP (section_key)""",
)
oracle(
    "attach_provenance",
    f"""WITH {P} SELECT page_id, url, section_key AS category, CAST({DAY} AS TIMESTAMP) AS scraped_date FROM p""",
)
oracle(
    "parse_provenance",
    f"""WITH {P} SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN url END AS url,
  CASE WHEN page_id % 5 <> 0 THEN section_key END AS category,
  CASE WHEN page_id % 5 <> 0 THEN {DAY} + TIME '10:20:30' END AS scraped_date FROM p""",
)
oracle(
    "attach_url",
    f"""WITH {P}, {PAGE_LINKS}
SELECT page_id, section_key, article_key, coalesce(l.url, '{values.BASE_URL}') AS url
FROM p LEFT JOIN (SELECT DISTINCT section_key, article_key, url FROM page_links) l
  USING (section_key, article_key)""",
)
oracle(
    "unchanged_rerun",
    f"""WITH {P}, {PAGE_LINKS}, {CACHED}
SELECT section_key, count(c.article_key) AS n_cached, count(*) - count(c.article_key) AS n_todo
FROM page_links l LEFT JOIN cached c USING (section_key, article_key) GROUP BY section_key""",
)
oracle(
    "needs_cleaning",
    f"""WITH t AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE {main("html")} END AS html FROM pages)
SELECT * FROM t WHERE NOT contains(lower(html), '<html')""",
)
oracle("main_content", f"SELECT page_id, {main('html')} AS content FROM pages")
oracle("decode_entities", f"SELECT page_id, {decode('html')} AS html FROM pages")
oracle("score_blocks", f"WITH {P},{dense('p', 'html')} SELECT * FROM s")
oracle(
    "main_run",
    f"""WITH {BOXED},{dense('boxed', 'html')}
SELECT page_id, coalesce(any_value(run_score), 0) AS run_score, count(k.pos) AS n_blocks, min(k.pos) AS first_pos,
  md5(coalesce(string_agg(tag || ':' || text, chr(10) ORDER BY k.pos), '')) AS digest
FROM boxed LEFT JOIN r USING (page_id) LEFT JOIN k USING (page_id) GROUP BY page_id""",
)
oracle(
    "extraction_agreement",
    f"""WITH {BOXED},{dense('boxed', 'html')},{blocks('p', 'page_id', main('html'), values.CLEAN_TAGS)},
sides AS (
  SELECT page_id, text, max(run) AS run, max(tags) AS tags FROM (
    SELECT page_id, text, 1 AS run, 0 AS tags FROM k UNION ALL SELECT page_id, text, 0, 1 FROM n)
  GROUP BY ALL)
SELECT section_key, CAST(sum(run) AS BIGINT) AS n_run, CAST(sum(tags) AS BIGINT) AS n_tags, CAST(sum(run * tags) AS BIGINT) AS n_both
FROM sides JOIN p USING (page_id) GROUP BY section_key""",
)
oracle(
    "drop_listed",
    f"""WITH {PAGE_BLOCKS},
words AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS word FROM documents),
rare AS MATERIALIZED (SELECT word FROM words WHERE length(word) >= 10 GROUP BY word HAVING count(DISTINCT doc_id) = 1),
texts AS MATERIALIZED (SELECT DISTINCT text FROM n),
gone AS (SELECT text FROM texts WHERE EXISTS (SELECT 1 FROM rare WHERE contains(texts.text, rare.word)))
SELECT * FROM n WHERE text NOT IN (SELECT text FROM gone)""",
)
oracle(
    "progress_rejects",
    """WITH d AS (
  SELECT o_orderkey, o_orderkey % 10 AS kind,
    format('{{"c{}_completed": true, "c{}_count": {}}}', o_custkey, o_custkey, o_orderkey) AS whole FROM orders),
t AS (
  SELECT o_orderkey, CASE kind WHEN 1 THEN left(whole, length(whole) - 9) WHEN 2 THEN '[' || whole || ']' WHEN 3 THEN ' '
    WHEN 4 THEN NULL ELSE whole END AS doc FROM d)
SELECT o_orderkey, CASE WHEN trim(doc) = '' THEN 'empty' WHEN NOT json_valid(doc) THEN 'not JSON' ELSE 'not an object' END AS reason
FROM t WHERE doc IS NOT NULL AND (NOT json_valid(doc) OR json_type(doc) <> 'OBJECT')""",
)
oracle(
    "read_tree",
    f"WITH {P} SELECT section_key, article_key AS short_key, md5(html) AS digest FROM p WHERE section_key IN ('en', 'de')",
)
oracle(
    "resolve_sections",
    f"""WITH {P}, {DIM}, w AS (SELECT DISTINCT section_key AS k FROM p UNION SELECT 'world' UNION SELECT 'factcheck')
SELECT k AS section_key, coalesce(name_english, upper(left(k, 1)) || lower(substr(k, 2))) AS section_name,
  coalesce(path, '/category/' || k || '/') AS section_path FROM w LEFT JOIN dim ON lower(dim.section_key) = k""",
)
oracle(
    "statistics_report",
    f"""WITH {CLEANED} SELECT section_key, count(*) AS n_articles, CAST(sum(n_bytes) AS BIGINT) AS n_bytes,
  CAST(sum(n_blocks) AS BIGINT) AS n_blocks, true AS texts_near, true AS median_near FROM c WHERE n_blocks > 0 GROUP BY section_key""",
)
oracle(
    "repeated_lines",
    f"""WITH {CLEANED}, l AS (SELECT section_key, unnest(string_split(body, chr(10))) AS line FROM c)
SELECT section_key, line, count(*) AS n_least, count(*) AS n_most FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) > 1""",
)
oracle("explode_blocks", f"WITH {PAGE_BLOCKS} SELECT * FROM b")
oracle("drop_empty_blocks", f"WITH {PAGE_BLOCKS} SELECT * FROM n")
oracle("drop_blocklisted", f"WITH {PAGE_BLOCKS} SELECT * FROM n WHERE NOT {listed('text', WORDS)}")
oracle(
    "dedup_blocks",
    f"""WITH {PAGE_BLOCKS} SELECT page_id, pos, tag, text FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY pos) AS copy FROM n) WHERE copy = 1""",
)
oracle(
    "dedup_document_lines",
    f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
tidy AS (SELECT doc_id, CAST(2 * n - 1 AS BIGINT) AS pos, 'p' AS tag, trim({collapse("line")}) AS text FROM lines)
SELECT doc_id, pos, tag, text FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS copy FROM tidy WHERE text <> '')
WHERE copy = 1""",
)
oracle(
    "tag_blocks",
    f"WITH {PAGE_BLOCKS} SELECT page_id, pos, {tagged(values.CLEAN_HEADINGS)} AS tag, text FROM n",
)
oracle(
    "assemble_articles",
    f"""WITH {PAGE_BLOCKS}, t AS (SELECT page_id, pos, {tagged(values.CLEAN_HEADINGS)} AS tag, text FROM n),
a AS (SELECT page_id, count(*) AS n_blocks, string_agg('<' || tag || '>' || text || '</' || tag || '>',
        chr(10) ORDER BY pos) AS body FROM t GROUP BY page_id)
SELECT page_id, body, n_blocks, CAST(strlen(body) AS BIGINT) AS n_bytes FROM a""",
)
oracle(
    "cleaning_rejects",
    f"""WITH {P}, short AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '(?s)<h1>.*?</h1>')
    WHEN page_id % 11 = 0 THEN '<article> </article>' ELSE html END AS html FROM p),
{blocks("short", "page_id", main("html"), values.CLEAN_TAGS)},
counts AS (
  SELECT page_id, count(text) AS n_raw, count(text) FILTER (NOT {listed("text", ["###", "e"])}) AS kept
  FROM short LEFT JOIN n USING (page_id) GROUP BY page_id)
SELECT page_id, n_raw, n_raw AS n_unwanted,
       CASE WHEN n_raw = 0 THEN 'no text' ELSE 'only unwanted blocks' END AS reason
FROM counts WHERE kept = 0""",
)
oracle("clean_corpus", f"WITH {CLEANED} SELECT * FROM c")
for key in ("clean_inline_spans", "clean_decoys"):
    oracle(key, f"WITH {CLEANED} SELECT page_id, body, n_raw, n_unwanted, n_repeated FROM c")
oracle(
    "article_date_attribute",
    f"""SELECT page_id, 'દિવસ' AS date_text, {DAY} + TIME '06:07:08' AS published_at FROM pages""",
)
oracle(
    "article_title_decoys",
    f"""SELECT page_id, {readable("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages""",
)
oracle(
    "article_title",
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'untitled' ELSE
  {readable("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} END AS title FROM pages""",
)
AUTHOR = """CASE WHEN kind IN (1, 2) AND length(section_key) + page_id % 60 + CASE WHEN page_id % 60 > 0 THEN 1 ELSE 0 END < 50
  THEN trim(section_key || ' ' || repeat('x', CAST(page_id % 60 AS INTEGER))) ELSE 'staff' END"""
oracle("article_author", f"WITH {P}, {BYLINED} SELECT page_id, {AUTHOR} AS author FROM bylined")
DATE_TEXT = f"""CASE kind WHEN 0 THEN '{values.DEFAULT_DATE}'
  WHEN 2 THEN strftime({DAY}, '%B %-d, %Y') ELSE day END"""
oracle(
    "article_date",
    f"""WITH {P}, {BYLINED} SELECT page_id, {DATE_TEXT} AS date_text,
  CASE WHEN kind > 0 THEN CAST({DAY} AS TIMESTAMP) END AS published_at FROM bylined""",
)


def escaped(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {quoted(char)}, {quoted(entity)})"
    return x


# The spliced elements hold no paragraph and no heading, so the body is that of the plain page.
oracle(
    "render_articles",
    f"""WITH {P}, {BYLINED},{blocks("p", "page_id", drop("html", ["script", "style"]), values.LAYOUT_TAGS)},
kept AS (SELECT * FROM n WHERE tag <> '' AND NOT {listed("text", values.LAYOUT_BLOCKLIST)}),
bodies AS (
  SELECT page_id, count(*) AS n_blocks, string_agg(
    CASE WHEN tag = 'p' THEN '<p>' || {escaped("text")} || '</p>'
    ELSE '<h2>' || {escaped("text")} || '</h2>' END, chr(10) ORDER BY pos) AS body
  FROM kept GROUP BY page_id)
SELECT page_id, coalesce(n_blocks, 0) AS n_blocks,
  concat_ws(chr(10), '<!DOCTYPE html>', '<html lang="gu">', '<head><meta charset="UTF-8"></head>',
    '<body>', '<header>',
    '<h1>Article Title: ' || {escaped(readable("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} || '</h1>',
    '<p><b>Author:</b> ' || {AUTHOR.replace("'staff'", quoted(values.DEFAULT_AUTHOR))} || '</p>',
    '<p><b>Date:</b> ' || {DATE_TEXT} || '</p>', '</header>', coalesce(body, ''), '</body>', '</html>') AS page
FROM bylined LEFT JOIN bodies USING (page_id)""",
)
oracle(
    "publication_month",
    f"WITH {DATES} SELECT page_id, strftime(coalesce(published_at, fetched_at), '%Y-%m') AS month FROM dates",
)
oracle("canonical_stem", f"WITH {P} SELECT page_id, article_key AS stem FROM p")
oracle(
    "order_articles",
    f"""WITH {CLEANED}, {DATES}, {PAGE_LINKS}, {RANKED}
SELECT page_id, section_key, rank, row_number() OVER (
  PARTITION BY section_key ORDER BY rank NULLS LAST, fetched_at, article_key) AS position FROM ranked""",
)
oracle(
    "compile_monthly",
    f"""WITH {COMPILED}
SELECT page_id, section_key, month, rank, position, start_block, start_byte FROM compiled""",
)
oracle(
    "compile_body",
    f"""WITH {COMPILED}
SELECT section_key, month, start_byte // 20000 AS part_no, count(*) AS n_articles,
       string_agg(body, chr(10) ORDER BY position) AS body
FROM compiled GROUP BY section_key, month, part_no""",
)
oracle("archive_manifest", f"WITH {COMPILED}{manifest('compiled')}")
oracle(
    "cover_rows",
    f"""WITH {COMPILED}, {DIM}, k0 AS (
  SELECT section_key, month, count(*) AS n_articles FROM compiled GROUP BY ALL), {named("k0")}
SELECT section_key, month, section_name, n_articles, concat_ws(chr(10), '{values.ARCHIVE_TITLE}',
  'Category: ' || section_name, 'Month: ' || month, 'Total Articles: ' || n_articles,
  'Archived on: {RUN_TS}') AS cover FROM named""",
)
oracle(
    "output_name",
    f"""WITH {COMPILED}, {DIM}, {named("compiled")}
SELECT page_id, section_name || '/Demo_' || section_name || '_' || month AS output_name FROM named""",
)
oracle(
    "skip_unreadable",
    f"""WITH {CLEANED}, {DATES}, {PAGE_LINKS}, {RANKED},
readable AS (SELECT * FROM ranked WHERE page_id % 5 <> 0 AND n_bytes > 0), {placed("readable")}
SELECT page_id, section_key, month, position FROM compiled""",
)
oracle(
    "compile_offsets",
    f"WITH {COMPILED} SELECT page_id, section_key, month, position, start_block FROM compiled",
)
# The links of the given listing pages lead to none of the given pages: all ranks are missing.
oracle(
    "run_archive",
    f"""WITH {cleaned(values.CLEAN_BLOCKLIST)}, {DATES}, kept AS (
  SELECT c.*, published_at, strftime(coalesce(published_at, fetched_at), '%Y-%m') AS month
  FROM c JOIN dates USING (page_id) WHERE n_bytes > 0){manifest("kept")}""",
)
ARCHIVED = f"""{cleaned(values.CLEAN_BLOCKLIST)}, {DATES}, listed AS (
  SELECT section_key, article_key, row_number() OVER (PARTITION BY section_key ORDER BY page_id) - 1 AS rank
  FROM p WHERE page_id % 3 <> 0),
ranked AS (
  SELECT c.*, published_at, fetched_at, rank, strftime(coalesce(published_at, fetched_at), '%Y-%m') AS month
  FROM c JOIN dates USING (page_id) LEFT JOIN listed USING (section_key, article_key) WHERE n_bytes > 0),
{placed('ranked')}"""
oracle(
    "run_archive_positions",
    f"""WITH {ARCHIVED} SELECT section_key, article_key, month, rank, position, start_byte,
  {readable("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, '{values.DEFAULT_DATE}' AS date_text
FROM compiled JOIN (SELECT page_id, html FROM p) USING (page_id)""",
)
oracle(
    "run_archive_parts",
    f"""WITH {ARCHIVED}
SELECT section_key, month, start_byte // 20000 AS part_no, count(*) AS n_articles,
       string_agg(body, chr(10) ORDER BY position) AS body
FROM compiled GROUP BY section_key, month, part_no""",
)
oracle(
    "run_archive_covers",
    f"""WITH {ARCHIVED}, {DIM}, k0 AS (
  SELECT section_key, month, count(*) AS n_articles FROM compiled GROUP BY ALL), {named("k0")}
SELECT section_key, month, section_name, n_articles, concat_ws(chr(10), '{values.ARCHIVE_TITLE}',
  'Category: ' || section_name, 'Month: ' || month, 'Total Articles: ' || n_articles,
  'Archived on: {RUN_TS}') AS cover FROM named""",
)
oracle(
    "run_archive_ledger",
    f"""WITH {P} SELECT section_key, true AS completed, count(*) FILTER (page_id % 3 <> 0) AS n_links,
  TIMESTAMP '{RUN_TS}' AS updated_at FROM p GROUP BY section_key""",
)
LEDGER = """latest AS (
  SELECT CAST(o_custkey AS VARCHAR) AS section_key, o_orderstatus = 'F' AS completed,
         o_orderkey AS n_links, o_orderdate AS updated_at
  FROM (SELECT *, row_number() OVER (
          PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders)
  WHERE age = 1)"""
oracle("update_ledger", f"WITH {LEDGER} SELECT * FROM latest")
oracle(
    "resume_sections",
    f"WITH {LEDGER} SELECT section_key FROM latest WHERE NOT completed OR section_key IN ('5', '10', '40')",
)
oracle(
    "stream_clean",
    f"WITH {cleaned(values.CLEAN_BLOCKLIST)} SELECT page_id, section_key, article_key, n_blocks, n_bytes FROM c",
)
oracle(
    "stream_section_counts",
    f"""WITH {P}, {DATES} SELECT section_key, strftime(fetched_at, '%Y-%m') AS month, count(*) AS n_articles
FROM p JOIN dates USING (page_id) GROUP BY ALL""",
)
oracle(
    "stream_ledger",
    f"""WITH {P} SELECT section_key, section_key IN ('en', 'de') AS completed, count(*) AS n_links,
  TIMESTAMP '{RUN_TS}' AS updated_at FROM p GROUP BY section_key""",
)
oracle(
    "script_share",
    r"""SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '\p{Latin}')) AS n_script,
  length(text) - length(replace(text, chr(65533), '')) AS n_replacement,
  len(regexp_extract_all(text, '\p{Latin}'))::DOUBLE / nullif(length(text), 0) AS share FROM documents""",
)
oracle(
    "repeat_tokens",
    f"WITH {CLEANED} SELECT page_id, len(regexp_extract_all(body, '(?:& ?){{2,}}')) AS n_runs FROM c",
)
oracle(
    "residual_markup",
    f"""WITH {cleaned(values.CLEAN_BLOCKLIST)},
t AS (SELECT page_id, sum(len(regexp_extract_all(text, '<[a-zA-Z/][^>]*>'))) AS n_tags,
             bool_or({listed("text", WORDS)}) AS has_listed FROM d GROUP BY page_id)
SELECT page_id, CAST(coalesce(n_tags, 0) AS BIGINT) AS n_tags, coalesce(has_listed, false) AS has_listed
FROM c LEFT JOIN t USING (page_id)""",
)
oracle(
    "corpus_report",
    f"""WITH {CLEANED}
SELECT section_key, count(*) FILTER (n_blocks > 0) AS n_articles,
       count(*) FILTER (n_blocks = 0) AS n_rejects, CAST(sum(n_raw) AS BIGINT) AS blocks_seen,
       CAST(sum(n_blocks) AS BIGINT) AS blocks_kept, CAST(sum(n_unwanted) AS BIGINT) AS blocks_unwanted,
       CAST(sum(n_repeated) AS BIGINT) AS blocks_repeated
FROM c GROUP BY section_key""",
)
