"""Queries over whole rules: suppression, shared contacts, challenges, noted sends, drafts, dry sources, covers; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.operators import candidates as C
from leadloom.operators import contacts, drafts, geo, pages
from leadloom.operators import lifecycle as L
from leadloom.operators import people as P
from leadloom.sources import fixtures as X

from . import chain_queries as Q
from . import oracle_parts as O
from . import page_queries as G
from . import record_queries as R
from . import site_queries as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- suppression ------------------------------------------------------------------
_BARRED = f"""{O.LEDGER}, {O.PEOPLE}, notes AS (SELECT line FROM ledger_lines UNION ALL SELECT '- (' || profile_url || ') asked not to be written to, u' || person_id || '@Example.com' FROM people WHERE person_id % 10 = 3),
  barred AS (SELECT DISTINCT 'email' AS key_type, lower(unnest(regexp_extract_all(line, {O.q(K.EMAIL)}))) AS key_value FROM notes
    UNION SELECT 'profile', {O.PROFILE("u")} FROM (SELECT unnest(regexp_extract_all(line, {O.q(K.PROFILE_LINK)})) AS u FROM notes) WHERE {O.PROFILE("u")} IS NOT NULL)"""


def _barred(s, d):
    p = X.people(s, d).where("person_id % 10 = 3")
    note = F.concat(F.lit("- ("), "profile_url", F.lit(") asked not to be written to, u"), F.col("person_id").cast("string"), F.lit("@Example.com"))
    return C.suppression_keys(X.ledger_lines(s, d).select("line").union(p.select(note.alias("line"))))


@query(f"WITH {_BARRED} SELECT key_type, key_value FROM barred")
def scan_suppression_keys(s, d):
    return _barred(s, d)


@query(f"""WITH {_BARRED} SELECT person_id AS lead_id, CASE WHEN {O.PROFILE("profile_url")} IN (SELECT key_value FROM barred WHERE key_type = 'profile') THEN 'profile'
  WHEN 'u' || person_id || '@example.com' IN (SELECT key_value FROM barred WHERE key_type = 'email') THEN 'email' END AS suppressed FROM people""")
def suppress_profiles(s, d):
    p = X.people(s, d).select(F.col("person_id").alias("lead_id"), F.col("profile_url").alias("url"), F.concat(F.lit("U"), F.col("person_id").cast("string"), F.lit("@example.com")).alias("email"))
    return P.suppress_profiles(p, _barred(s, d)).select("lead_id", "suppressed")


# ---- contacts and pages -------------------------------------------------------------
@query(f"""WITH {O.CLASSED}, held AS (SELECT *, count(*) FILTER (WHERE NOT own) OVER (PARTITION BY email) AS n FROM classed WHERE email_class <> 'junk'), h AS (SELECT *, NOT own AND n >= 2 AS bad FROM held)
  SELECT domain, email AS held, CASE WHEN NOT bad THEN email END AS email, CASE WHEN bad THEN 'none' ELSE email_class END AS email_class, CASE WHEN bad THEN 'off-domain address shared by ' || n || ' unrelated leads' END AS drop_reason FROM h""")
def clear_shared_contacts(s, d):
    """Each site's addresses as leads of their own: those that several sites show and none owns are cleared."""
    leads = contacts.classify_emails(S._emails(s, d)).where("email_class <> 'junk'").withColumn("held", F.col("email"))
    return contacts.clear_shared_offdomain(leads).select("domain", "held", "email", "email_class", "drop_reason")


_STATUS = "CASE page_id % 23 WHEN 0 THEN 429 WHEN 1 THEN 999 WHEN 2 THEN 503 ELSE 200 END"
_URLS, _PHRASES = ("/login", "spam-farm", "[?&]utm_"), ("unusual traffic", "the was", "that is")
_VISIBLE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"""WITH f AS (SELECT page_id, url, {_STATUS} AS status, trim(lower(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'))) AS t FROM pages),
  r AS (SELECT page_id, CASE WHEN status = 429 THEN 'HTTP 429 (rate limited)' WHEN status = 999 THEN 'HTTP 999 (blocked)' WHEN status >= 500 THEN 'HTTP ' || status END AS s,
    CASE WHEN {" OR ".join(f"regexp_matches(url, '(?i){u}')" for u in _URLS)} THEN 'challenge/redirect URL: ' || url END AS u, CASE {" ".join(f"WHEN contains(t, '{p}') THEN 'challenge page text: ' || chr(34) || '{p}' || chr(34)" for p in _PHRASES)} END AS x FROM f)
  SELECT page_id, CASE WHEN s IS NOT NULL THEN 'status' WHEN u IS NOT NULL THEN 'url' ELSE 'text' END AS rule, coalesce(s, u, x) AS reason FROM r WHERE coalesce(s, u, x) IS NOT NULL""")
def challenged_pages(s, d):
    status = F.when(F.col("page_id") % 23 == 0, 429).when(F.col("page_id") % 23 == 1, 999).when(F.col("page_id") % 23 == 2, 503).otherwise(200)
    return pages.challenged_pages(X.table(s, d, "pages").withColumn("status", status), list(_URLS), list(_PHRASES))


# ---- sends --------------------------------------------------------------------------
_OUT = f"""{O.SEND_EVENTS}, o AS (SELECT event_id, CASE WHEN status = 'sent' THEN 'sent' ELSE 'error' END AS result, dry_run, CASE WHEN profile % 3 = 0 THEN 'phone' ELSE 'email' END AS channel, CASE WHEN event_id % 29 <> 0 THEN message_id END AS message_id,
    upper(address) AS email, 'r' || event_id % 2 AS run, '+96650' || profile % 1000 AS phone FROM send_events),
  led AS (SELECT 'message' AS t, message_id AS v FROM send_events WHERE event_id % 31 = 0 UNION ALL SELECT 'email_run', 'u' || c_custkey || '@example.com|r1' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'phone', '96650' || c_custkey % 1000 FROM customer WHERE c_custkey % 7 = 0)"""


@query(f"""WITH {_OUT}, g AS (SELECT *, lower(email) || '|' || run AS er, regexp_replace(phone, '[^0-9]', '', 'g') AS dg FROM o WHERE result = 'sent' AND NOT dry_run AND (channel = 'phone' OR message_id IS NOT NULL)),
  k AS (SELECT event_id, channel, CASE WHEN channel = 'phone' THEN dg ELSE er END AS key FROM g WHERE CASE WHEN channel = 'phone' THEN dg NOT IN (SELECT v FROM led WHERE t = 'phone') ELSE message_id NOT IN (SELECT v FROM led WHERE t = 'message') AND er NOT IN (SELECT v FROM led WHERE t = 'email_run') END)
  SELECT min(event_id) AS event_id, channel FROM k GROUP BY channel, key""")
def noted_sends(s, d):
    """What is appended to the send ledger, by its own keys of messages, addresses in a run, and phones; message ids are unique here."""
    e, n = X.send_events(s, d), F.col("event_id")
    text = lambda a, v: F.concat(F.lit(a), v.cast("string"))
    out = e.select(
        "event_id", F.when(F.col("status") == "sent", "sent").otherwise("error").alias("result"), "dry_run", F.when(F.col("profile") % 3 == 0, "phone").otherwise("email").alias("channel"), F.when(n % 29 != 0, F.col("message_id")).alias("message_id"),
        F.upper("address").alias("email"), text("r", n % 2).alias("run"), text("+96650", F.col("profile") % 1000).alias("phone"),
    )
    k = F.col("c_custkey")
    c = X.table(s, d, "customer")
    key = lambda df, t, v: df.select(F.lit(t).alias("key_type"), v.alias("key_value"))
    led = key(e.where(n % 31 == 0), "message", F.col("message_id")).union(key(c.where(k % 5 == 0), "email_run", F.concat(text("u", k), F.lit("@example.com|r1")))).union(key(c.where(k % 7 == 0), "phone", text("96650", k % 1000)))
    return L.noted_sends(out, led, "event_id").select("event_id", "channel")


@query(f"WITH {R._DAYS} SELECT count(*) FILTER (WHERE day < DATE '{R.TODAY}') + 1 AS campaign_day FROM days WHERE n > 0 AND day <= DATE '{R.TODAY}'")
def campaign_day_today(s, d):
    return L.campaign_day_on(R._days(s, d), R.TODAY)


# ---- drafts -----------------------------------------------------------------------
_OPENERS = {"phone_led": "I tried to call {name} – in {dialect}", "form": "the form of your {vertical} asked a lot", "chat": "your chat in {country} was closed"}
_VERTICALS, _DIALECTS = {"hotel": "hotel", "clinic": "medical clinic"}, {"ES": "Spanish", "FR": "French", "DE": "German"}
_SUBJECT, _BODY = "{name} — a question", "Hello {salutation},\n\n{opener}.\nWe work for a {vertical} in {country}.\n\nAnna — team"
_LEAD = f"""{O.CANDIDATES}, lead AS (SELECT seq, CASE WHEN seq % 6 = 0 THEN left(name, 20) || ' - ' || domain WHEN seq % 6 = 1 THEN left(name, 12) || ' LLC' ELSE name END AS name, country AS country_code, vertical,
  (['form', 'chat', 'none'])[seq % 4 + 1] AS signal, 'Ann' AS first_name, CASE WHEN seq % 3 = 0 THEN '' ELSE 'Stone' END AS last_name, CASE WHEN seq % 2 = 0 THEN 'Ms.' END AS title, '44' || seq AS to_phone FROM candidates)"""
_SHORT = "trim(regexp_replace(trim(regexp_replace(name, '\\s+[-–—|]\\s.*$', '')), '(?i)[\\s,]+(llc|fze|co|group)\\.?$', ''))"


def _case(table: dict, col: str, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in table.items()) + f" ELSE {O.q(default)} END"


_FILLED = f"""{_LEAD}, nm AS (SELECT *, CASE WHEN length({_SHORT}) <= 40 THEN {_SHORT} ELSE regexp_replace(left({_SHORT}, 41), '\\s+\\S*$', '') END AS short, {_case(K.COUNTRY_NAMES, "country_code", "?")} AS cn, {_case(_VERTICALS, "vertical", "business")} AS vn, {_case(_DIALECTS, "country_code", "English")} AS dn,
    CASE WHEN last_name <> '' AND title IS NOT NULL THEN title || ' ' || last_name ELSE first_name END AS salutation FROM lead),
  op AS (SELECT *, replace(replace(replace(replace({_case(_OPENERS, "signal", _OPENERS["phone_led"])}, '{{name}}', short), '{{country}}', cn), '{{vertical}}', vn), '{{dialect}}', dn) AS opener FROM nm),
  tx AS (SELECT *, regexp_replace('Hello ' || salutation || ',' || chr(10) || chr(10) || opener || '.' || chr(10) || 'We work for a ' || vn || ' in ' || cn || '.' || chr(10) || chr(10) || 'Anna — team', '\\s*[—–]\\s*', ', ', 'g') AS body_text FROM op)"""


def _draft_leads(s, d):
    c, n = X.candidates(s, d), F.col("seq")
    name = F.when(n % 6 == 0, F.concat(F.left("name", F.lit(20)), F.lit(" - "), "domain")).when(n % 6 == 1, F.concat(F.left("name", F.lit(12)), F.lit(" LLC"))).otherwise(F.col("name"))
    return c.select(
        "seq", name.alias("name"), F.col("country").alias("country_code"), "vertical", F.get(F.array(F.lit("form"), F.lit("chat"), F.lit("none")), (n % 4).cast("int")).alias("signal"), F.lit("Ann").alias("first_name"),
        F.when(n % 3 == 0, "").otherwise("Stone").alias("last_name"), F.when(n % 2 == 0, "Ms.").alias("title"), F.concat(F.lit("44"), n.cast("string")).alias("to_phone"),
    )


@query(f"""WITH {_FILLED} SELECT seq, short AS name, salutation, regexp_replace(short || ' — a question', '\\s*[—–]\\s*', ', ', 'g') AS subject, body_text,
  '<p>' || replace(replace(body_text, chr(10) || chr(10), '</p>' || chr(1) || '<p>'), chr(10), '<br>') || '</p>' AS html, 'cold-outreach,r7,' || vertical || ',' || country_code AS tags FROM tx""")
def render_drafts(s, d):
    r = drafts.render_drafts(_draft_leads(s, d), _OPENERS, _VERTICALS, _DIALECTS, _SUBJECT, _BODY, "r7", ("phone_led", "business", "English"))
    return r.select("seq", "name", "salutation", "subject", "body_text", F.replace("body_html", F.lit("\n"), F.lit("\x01")).alias("html"), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_FILLED} SELECT seq, to_phone || '@c.us' AS to_jid, body_text, 'cold-outreach,phone,r7,' || vertical || ',' || country_code AS tags FROM tx")
def render_phone_drafts(s, d):
    r = drafts.render_drafts(_draft_leads(s, d), _OPENERS, _VERTICALS, _DIALECTS, _SUBJECT, _BODY, "r7", ("phone_led", "business", "English"), phone=True)
    return r.select("seq", "to_jid", "body_text", F.array_join("tags", ",").alias("tags"))


# ---- sources and places -----------------------------------------------------------
@query(f"WITH {R._MERGED}, g AS (SELECT country, count(*) AS n FROM merged WHERE drop_reason = 'country' GROUP BY 1) SELECT * FROM (SELECT country, n, row_number() OVER (ORDER BY n DESC, country) AS rank FROM g) WHERE rank <= 8")
def merge_top_countries(s, d):
    return C.merge_countries(R._merged(s, d))


_UNIT = "CASE WHEN batch_file = 3 THEN 'DE' ELSE batch_file || '-' || vertical END"


@query(f"""WITH {R._MERGED}, u AS (SELECT *, {_UNIT} AS source FROM merged), declared AS (SELECT DISTINCT source FROM u UNION SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey <= 3),
  n AS (SELECT source, string_agg(DISTINCT vertical, ',' ORDER BY vertical) AS verticals, count(*) AS found, count(*) FILTER (WHERE drop_reason IS NULL) AS kept FROM u GROUP BY source)
  SELECT source, coalesce(verticals, '') AS verticals, coalesce(found, 0) AS found, coalesce(kept, 0) AS kept, coalesce(kept, 0) = 0 AS dry FROM declared LEFT JOIN n USING (source)""")
def source_report(s, d):
    """Each declared source with its verticals, what it found and what stayed; some bring nothing, or nothing new."""
    m = R._merged(s, d).withColumn("source", F.when(F.col("batch_file") == 3, "DE").otherwise(F.concat(F.col("batch_file").cast("string"), F.lit("-"), "vertical")))
    declared = m.select("source").union(X.table(s, d, "supplier").where("s_suppkey <= 3").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))
    return C.source_report(m, declared)


@query(f"""WITH {Q._FOUND} SELECT CASE WHEN drop_stage IS NOT NULL THEN drop_stage WHEN by_phone THEN 'phone-only' ELSE 'kept' END AS stage, CASE WHEN k % 11 = 0 THEN 'none' ELSE basis END AS basis, count(*) AS n FROM g4 GROUP BY 1, 2""")
def enrich_bases(s, d):
    """How many leads each gate drops or keeps, by what their address is based on."""
    g = Q.gate_found_contacts(s, d).select("domain", "drop_stage", "channel")
    k = F.col("c_custkey")
    found = X.table(s, d, "customer").where(k % 11 != 0).select(F.concat(F.lit("d"), k.cast("string"), F.lit(".firms.net")).alias("domain"), F.when((k % 10).isin(4, 5, 6), "constructed").otherwise("verbatim").alias("basis"))
    stage = F.when(F.col("drop_stage").isNotNull(), F.col("drop_stage")).when(F.col("channel") == "phone", "phone-only").otherwise("kept")
    return g.join(found, "domain", "left").groupBy(stage.alias("stage"), F.coalesce("basis", F.lit("none")).alias("basis")).agg(F.count("*").alias("n"))


_SWEPT = "SELECT DISTINCT (['ES', 'FR', 'DE', 'GB'])[s_suppkey % 4 + 1] AS country, (['hotel', 'clinic'])[s_nationkey % 2 + 1] AS vertical FROM supplier WHERE s_nationkey < 12"


@query(f"WITH {O.CANDIDATES} SELECT country, vertical, min(seq) AS pos FROM candidates WHERE (country, vertical) NOT IN ({_SWEPT}) GROUP BY country, vertical")
def unswept_by_ledger(s, d):
    """Places of a vertical, in order of first mention, that the sweep ledger (a table of its own) lacks."""
    n = F.col("s_suppkey")
    pick = lambda items, i: F.get(F.array(*map(F.lit, items)), (i % len(items)).cast("int"))
    swept = X.table(s, d, "supplier").where("s_nationkey < 12").select(pick(("ES", "FR", "DE", "GB"), n).alias("country"), pick(("hotel", "clinic"), F.col("s_nationkey")).alias("vertical")).distinct()
    return X.candidates(s, d).groupBy("country", "vertical").agg(F.min("seq").alias("pos")).join(swept, ["country", "vertical"], "left_anti")


@query(f"""WITH {O.GEO}, g AS (SELECT *, {G._STEP!r} / greatest(cos(radians(lat)), 0.15) AS lon_step FROM places),
  c AS (SELECT place, lat, lon, half, lon_step, unnest(range(0, floor(2 * half / {G._STEP!r})::INTEGER + 1)) AS i FROM g), e AS (SELECT *, unnest(range(0, floor(2 * half / lon_step)::INTEGER + 1)) AS j FROM c),
  h AS (SELECT p.place, floor((q.lat - (p.lat - p.half)) / {G._STEP!r})::BIGINT AS i, floor((q.lon - (p.lon - p.half)) / p.lon_step)::BIGINT AS j, count(*) AS n FROM geo_points q JOIN g p ON q.lat BETWEEN p.lat - half AND p.lat + half AND q.lon BETWEEN p.lon - half AND p.lon + half GROUP BY 1, 2, 3)
  SELECT e.place, e.i, e.j, coalesce(n, 0) AS n FROM e LEFT JOIN h ON e.place = h.place AND e.i = h.i AND e.j = h.j""")
def cover_cells(s, d):
    """Each place's cells with the points of the table that lie in them."""
    return geo.cover_cells(X.geo_points(s, d), X.places(s), 5.0).select("place", "i", "j", "n")
