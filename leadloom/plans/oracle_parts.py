"""SQL twins of the derived tables and rules, as parts that the queries' SQL is put together from."""

from __future__ import annotations

from leadloom.functions import constants as K
from leadloom.sources import fixtures as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def some(items) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def like(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def every(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {q(pattern)}, {group})"


SITE_PAGES = f"""site_pages AS (
  SELECT page_id, domain, ({array(X.SLUGS)})[((n - 1) % {len(X.SLUGS)}) + 1] AS slug,
         html || replace(({array(X.SNIPPETS)})[(page_id % {len(X.SNIPPETS)}) + 1], '{{h}}', domain) AS html
  FROM (SELECT page_id, domain, html, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS n
        FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#]+)', 1) AS domain, html FROM pages)))"""

NORM = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '/+$', ''), '^.*//', ''), '/.*$', ''), '^www\\.', '')"

CANDIDATES = f"""candidates AS (
  SELECT page_id AS seq, (page_id % 4)::INTEGER AS batch_file, {NORM("regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)")} AS domain,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS name,
         CASE regexp_extract(url, '//[^/]+/([a-z]{{2}})/', 1) WHEN 'es' THEN 'ES' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' ELSE 'GB' END AS country,
         (['hotel', 'clinic', 'trades'])[(page_id % 3) + 1] AS vertical, (page_id % 35)::INTEGER AS branches, page_id % 5 <> 0 AS linked
  FROM pages)"""

LEDGER = f"""{CANDIDATES}, ledger_lines AS (
  SELECT m, CASE kind
           WHEN 'email' THEN day::VARCHAR || ' | Info@' || domain || ' | lead | step 1 | ' || run_id || ' | <m' || m || '@smtp-relay.example>'
           WHEN 'slug' THEN day::VARCHAR || ' | - | [[' || replace(domain, '.', '-') || ']] | step 1 | ' || run_id || ' | wa:97150' || lpad((m % 1000)::VARCHAR, 7, '0')
           WHEN 'disqualified' THEN domain || '|' || day::VARCHAR || '|' || run_id || '|score<82'
           ELSE day::VARCHAR || ' | ' || domain || ' | hard_bounce | x' END AS line,
         day AS entry_date, run_id, domain, kind
  FROM (SELECT m, domain, (DATE '2024-01-01' + (m % 60)::INTEGER) AS day, 'r' || (m % 3) AS run_id,
               CASE WHEN m % 7 = 0 THEN 'email' WHEN m % 7 = 1 THEN 'slug' WHEN m % 7 = 2 THEN 'disqualified' WHEN m % 11 = 3 THEN 'bounce_domain' END AS kind
        FROM (SELECT domain, min(seq) AS m FROM candidates GROUP BY domain)) WHERE kind IS NOT NULL)"""

COMPANIES = """companies AS (
  SELECT s_suppkey AS company_id, s_name AS name, 'supplier-' || s_suppkey || '.example.com' AS domain, n_name AS country, (2 + s_suppkey % 20)::INTEGER AS headcount
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PEOPLE = f"""{COMPANIES}, people AS (
  SELECT p.*, c.name AS company, c.domain AS company_domain, c.country AS company_country, c.headcount
  FROM (SELECT c_custkey AS person_id,
               replace(({array(X.URLS)})[(c_custkey % 4) + 1], '{{k}}', (CASE WHEN c_custkey % 25 = 24 THEN c_custkey - 1 ELSE c_custkey END)::VARCHAR) AS profile_url,
               ({array(X.TITLES)})[(c_custkey % 9) + 1] AS title, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS degree, c_custkey % 10 = 0 AS open_profile,
               CASE WHEN c_custkey % 13 > 0 THEN (c_custkey * 7) % 140 END AS last_activity_days, c_custkey % 6 AS mutuals,
               c_custkey % (SELECT count(*) FROM supplier) AS company_id FROM customer) p
  LEFT JOIN companies c USING (company_id))"""

SEND_EVENTS = """send_events AS (
  SELECT event_id, user_id * 16 + event_id % 16 AS profile, ts, CASE event_type WHEN 'view' THEN 'attempting' WHEN 'signup' THEN 'sent' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'dm_sent' END AS status,
         '<' || event_id || '@relay.example>' AS message_id, event_id % 17 = 0 AS dry_run, 'u' || user_id || '@example.com' AS address
  FROM events)"""

GEO = f"""geo_points AS (SELECT vec_id AS id, 40 + embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lon FROM embeddings),
places(pos, place, lat, lon, half) AS (VALUES {", ".join(f"({i}, {q(n)}, {a}::DOUBLE, {o}::DOUBLE, {h}::DOUBLE)" for i, (n, a, o, h) in enumerate(X.PLACES))})"""

PROFILE = lambda c: f"(CASE WHEN regexp_extract(lower({c}), '^(?:https?://)?(?:[a-z0-9-]+\\.)*linkedin\\.com/in/([^/?#\\s]+)', 1) <> '' THEN 'https://www.linkedin.com/in/' || regexp_extract(lower({c}), '^(?:https?://)?(?:[a-z0-9-]+\\.)*linkedin\\.com/in/([^/?#\\s]+)', 1) END)"
KEY = lambda c: f"nullif(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g'), '')"


# ---- addresses ---------------------------------------------------------------
def _deobfuscate(c: str) -> str:
    c = f"regexp_replace(regexp_replace({c}, '%40', '@', 'g'), '%2[eE]', '.', 'g')"
    for code, char in (("&#64;", "@"), ("&#x40;", "@"), ("&commat;", "@"), ("&#46;", "."), ("&#x2e;", "."), ("&period;", ".")):
        c = f"replace({c}, {q(code)}, {q(char)})"
    c = f"regexp_replace({c}, '\\s*[\\[({{]\\s*[aA][tT]\\s*[\\])}}]\\s*', '@', 'g')"
    return f"regexp_replace({c}, '\\s*[\\[({{]\\s*[dD][oO][tT]\\s*[\\])}}]\\s*', '.', 'g')"


_WRITTEN = every("replace(regexp_replace(" + _deobfuscate("html") + ", '%[0-9A-Fa-f]{2}', ' ', 'g'), chr(160), ' ')", K.EMAIL)
_LINKED = f"list_filter(list_transform({every('html', '(?i)' + K.MAILTO, 1)}, lambda x: regexp_replace(regexp_replace(x, '%40', '@', 'g'), '%2[eE]', '.', 'g')), lambda x: contains(x, '@'))"
EMAILS = f"""{SITE_PAGES}, emails AS (
  SELECT DISTINCT domain, regexp_replace(regexp_replace(lower(e), '^(%20)+', ''), '^\\.+', '') AS email
  FROM (SELECT domain, unnest(list_concat({_WRITTEN}, {_LINKED})) AS e FROM site_pages))"""


def root(c: str) -> str:
    base = f"regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '^[^@]*@', ''), ':.*$', ''), '^www\\.', '')"
    parts = f"list_filter(string_split({base}, '.'), lambda x: x <> '')"
    return (
        f"(CASE WHEN len({parts}) < 2 THEN {base} WHEN len({parts}) >= 3 AND ({parts})[-2] IN {some(K.SECOND_LEVEL)} AND length(({parts})[-1]) = 2 "
        f"THEN array_to_string(({parts})[-3:], '.') ELSE array_to_string(({parts})[-2:], '.') END)"
    )


def _own() -> str:
    base = "split_part(d, '.', 1)"
    hits = ["e = d"] + [f"e = {base} || {q(t)}" for t in K.VARIANT_TLDS]
    for s in K.GROUP_SUFFIXES:
        hits += [f"(ends_with({base}, {q(s)}) AND length({base}) > {len(s) + 2} AND e = left({base}, length({base}) - {len(s)}) || {q(t)})" for t in K.GROUP_TLDS]
    return "(" + " OR ".join(hits) + ")"


_LOCAL, _DOM = "split_part(email, '@', 1)", "split_part(email, '@', -1)"
_JUNK = " OR ".join([f"len(string_split(email, '@')) <> 2 OR length({_LOCAL}) < 3 OR {_LOCAL} IN {some(K.PLACEHOLDER_LOCALS)}"] + [like("email", p) for p in K.JUNK])
CLASSED = f"""{EMAILS}, classed AS (
  SELECT domain, email, e, d, {_own()} AS own,
         CASE WHEN {_JUNK} THEN 'junk' WHEN {_LOCAL} IN {some(K.ROLE_LOCALS)} THEN 'role' WHEN {_DOM} IN {some(K.FREEMAIL)} THEN 'personal' ELSE 'person' END AS email_class
  FROM (SELECT domain, email, {root("email")} AS e, {root("domain")} AS d FROM emails))"""
BEST = f"""{CLASSED}, best AS (
  SELECT domain, email AS best_email, email_class, n_emails FROM (
    SELECT *, count(*) OVER (PARTITION BY domain) AS n_emails, row_number() OVER (PARTITION BY domain ORDER BY rank, length(email), email) AS rn
    FROM (SELECT *, CASE email_class WHEN 'person' THEN CASE WHEN own THEN 0 ELSE 3 END WHEN 'role' THEN CASE WHEN own THEN 1 ELSE 4 END ELSE 2 END AS rank
          FROM classed WHERE email_class <> 'junk')) WHERE rn = 1)"""


# ---- signals -----------------------------------------------------------------
def _number(x: str) -> str:
    return f"(CASE WHEN {like(x, '^\\d+$')} THEN {x}::BIGINT WHEN {like(x, '^\\d{1,3}([.,]\\d{3})+$')} THEN regexp_replace({x}, '[.,]', '', 'g')::BIGINT ELSE 0 END)"


def _numbers(patterns) -> str:
    return "greatest(" + ", ".join(f"coalesce(list_max(list_transform({every('h', p, 1)}, lambda x: {_number('x')})), 0)" for p in patterns) + ", 0)"


_TEXT_IN = (
    f"coalesce(list_max(list_transform(list_filter(range(1, len({every('h', K.REVIEW_TEXT_IN, 1)}) + 1), lambda i: ({every('h', K.REVIEW_TEXT_IN, 1)})[i] NOT IN {some(K.VOID_TAGS)}), "
    f"lambda i: {_number('(' + every('h', K.REVIEW_TEXT_IN, 2) + ')[i]')})), 0)"
)
_FLAGS = [f"in_{k}" for k in K.INTAKE] + ["five", "four", "chat"] + [f"tracker_{k}" for k in K.TRACKERS]
SITES = f"""{SITE_PAGES}, page_flags AS (
  SELECT domain, slug, length(trim(h)) AS chars, {", ".join(f"{like('h', v)} AS in_{k}" for k, v in K.INTAKE.items())},
         coalesce(list_max(list_transform({every("h", K.ROOMS, 1)}, lambda x: x::BIGINT)), 0) AS rooms, {like("h", K.FIVE_STAR)} AS five, {like("h", K.FOUR_STAR)} AS four,
         list_filter({array(K.SCALE_WORDS)}, lambda w: contains(h, w)) AS scale, {_numbers(K.REVIEWS["reviews_jsonld"])} AS r_jsonld,
         greatest({_numbers(K.REVIEWS["reviews_microdata"])}, {_TEXT_IN}) AS r_microdata, {_numbers(K.REVIEWS["reviews_text"])} AS r_text,
         {", ".join(f"{like('h', v)} AS tracker_{k}" for k, v in K.TRACKERS.items())}, {like("h", K.CHAT)} AS chat, {every("h", K.HREFLANG, 1)} AS langs
  FROM (SELECT domain, slug, lower(html) AS h FROM site_pages WHERE length(html) >= 500)),
sites AS (
  SELECT domain, count(*) AS n_pages, (sum(chars) + count(*) - 1)::BIGINT AS chars, list_sort(list(DISTINCT slug)) AS slugs, {", ".join(f"bool_or({f}) AS {f}" for f in _FLAGS)},
         {", ".join(f"max({c}) AS {c}" for c in ("rooms", "r_jsonld", "r_microdata", "r_text"))}, list_distinct(flatten(list(scale))) AS scale, list_distinct(flatten(list(langs))) AS langs
  FROM page_flags GROUP BY domain)"""
INTAKE = "CASE WHEN in_platform THEN 'modern_booking' WHEN in_pdf_menu THEN 'pdf_menu' WHEN in_whatsapp AND NOT in_book THEN 'whatsapp' WHEN in_form AND NOT in_book THEN 'contact_form' WHEN in_book THEN 'booking_form_manual' ELSE 'phone_led' END"
SCALE = f"""CASE WHEN rooms >= 80 OR (rooms >= 50 AND (five OR four)) OR (five AND len(scale) >= 1) OR len(scale) >= 3 THEN 'high'
  WHEN rooms >= 40 OR four OR five OR (len(scale) >= 1 AND len(list_filter(scale, lambda w: w NOT IN {some(K.WEAK_WORDS)})) > 0) THEN 'medium' ELSE 'low' END"""
REVIEWS = f"least(greatest(r_jsonld, r_microdata, r_text), {K.REVIEW_CLAMP})"
TRACKERS = "(" + " + ".join(f"tracker_{k}::BIGINT" for k in K.TRACKERS) + ")"
LOAD = f"(CASE WHEN chat THEN {K.CHAT_POINTS} ELSE 0 END + CASE WHEN len(langs) >= 2 THEN {K.LANGUAGE_POINTS} ELSE 0 END + CASE WHEN n_pages >= {K.MANY_PAGES} THEN {K.PAGES_POINTS} ELSE 0 END + CASE WHEN branches >= {K.MANY_BRANCHES} THEN {K.BRANCH_POINTS} ELSE 0 END)"
_POINTS = "CASE " + " ".join(f"WHEN {REVIEWS} >= {a} THEN {b}" for a, b in K.REVIEW_POINTS) + " ELSE 0 END"
TRAFFIC = f"""{SITES}, first_candidate AS (SELECT domain, min(seq) AS seq FROM candidates GROUP BY domain),
site_candidates AS (SELECT s.*, c.seq, c.name, c.country, c.vertical, c.branches FROM sites s JOIN first_candidate f USING (domain) JOIN candidates c ON c.seq = f.seq),
traffic AS (SELECT *, CASE WHEN chars < {K.JUDGED_FROM} THEN 'unknown' WHEN traffic_score >= {K.HIGH_FROM} THEN 'high' WHEN traffic_score >= {K.MEDIUM_FROM} THEN 'medium' ELSE 'low' END AS traffic_tier
  FROM (SELECT *, {REVIEWS} AS reviews, {TRACKERS} AS trackers, {LOAD} AS load,
               CASE WHEN chars < {K.JUDGED_FROM} THEN 0 ELSE {_POINTS} + least({TRACKERS} * {K.TRACKER_POINTS}, {K.TRACKER_MAX}) + {LOAD} END AS traffic_score FROM site_candidates))"""
LEADS = f"""{CANDIDATES}, {TRAFFIC}, {BEST[len(SITE_PAGES) + 2 :]}, leads AS (
  SELECT t.*, {INTAKE} AS intake, CASE WHEN vertical IN {some(K.HOTEL_VERTICALS)} THEN {SCALE} ELSE 'na' END AS hotel_volume, b.best_email, b.email_class, b.n_emails,
         CASE b.email_class WHEN 'person' THEN 90 WHEN 'role' THEN 82 ELSE 78 END + CASE WHEN branches BETWEEN 5 AND 15 THEN 5 WHEN branches BETWEEN 16 AND 30 THEN 3 ELSE 0 END
         + CASE WHEN b.n_emails >= 2 AND (list_contains(slugs, 'contact') OR list_contains(slugs, 'team')) THEN 1 ELSE 0 END AS score
  FROM traffic t JOIN best b USING (domain) WHERE NOT in_platform)"""
