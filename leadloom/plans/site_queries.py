"""Queries over pages and leads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.operators import contacts, gates, reports, signals
from leadloom.sources import fixtures as X

from . import oracle_parts as O

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _emails(s, d):
    return contacts.harvest_emails(X.site_pages(s, d))


def _leads(s, d):
    return gates.assemble_leads(X.site_pages(s, d), X.candidates(s, d))


@query(f"WITH {O.SITE_PAGES} SELECT domain, count(*) AS n_pages, (sum(length(html)) + count(*) - 1)::BIGINT AS chars, array_to_string(list(slug ORDER BY slug), ',') AS slugs FROM site_pages WHERE length(html) >= 500 GROUP BY domain")
def scan_pages(s, d):
    p = X.site_pages(s, d).where(F.char_length("html") >= 500)
    return p.groupBy("domain").agg(F.count("*").alias("n_pages"), (F.sum(F.char_length("html")) + F.count("*") - 1).alias("chars"), F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))


@query(f"WITH {O.EMAILS} SELECT domain, email FROM emails")
def harvest_emails(s, d):
    return _emails(s, d)


@query(f"WITH {O.CLASSED} SELECT domain, email, email_class FROM classed")
def classify_email(s, d):
    return contacts.classify_emails(_emails(s, d))


@query(f"WITH {O.BEST} SELECT domain, best_email, email_class, n_emails FROM best")
def pick_best_contact(s, d):
    return contacts.pick_best_contact(_emails(s, d))


@query(f"""WITH {O.CLASSED} SELECT domain, bucket, count(*) AS n, string_agg(email, ',' ORDER BY email) AS emails FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, bucket ORDER BY email) AS rn FROM (
    SELECT domain, email, CASE WHEN email_class = 'personal' THEN 'freemail' WHEN e <> d THEN 'offdomain' WHEN email_class = 'role' THEN 'role' ELSE 'personal' END AS bucket FROM classed WHERE email_class <> 'junk')) WHERE rn <= 12 GROUP BY domain, bucket""")
def bucket_contacts(s, d):
    return contacts.bucket_contacts(_emails(s, d))


_PHONES = f"list_concat({O.every('lower(html)', r'wa\.me/\+?(\d{7,15})', 1)}, {O.every('lower(html)', 'tel:([+0-9() .-]{6,25})', 1)})"


@query(f"""WITH {O.SITE_PAGES} SELECT domain, rn, phone FROM (
  SELECT domain, phone, row_number() OVER (PARTITION BY domain ORDER BY page_id, place, phone) AS rn FROM (
    SELECT domain, phone, page_id, place, row_number() OVER (PARTITION BY domain, phone ORDER BY page_id, place) AS k FROM (
      SELECT domain, page_id, i AS place, regexp_replace(found[i], '[^0-9]', '', 'g') AS phone FROM (SELECT domain, page_id, {_PHONES} AS found FROM site_pages), unnest(range(1, len(found) + 1)) AS u(i)) WHERE length(phone) BETWEEN 9 AND 15) WHERE k = 1) WHERE rn <= 6""")
def harvest_phones(s, d):
    return contacts.harvest_phones(X.site_pages(s, d))


@query(f"WITH {O.CLASSED} SELECT DISTINCT domain FROM classed WHERE email_class = 'person' AND e = d AND regexp_matches(split_part(email, '@', 1), '^[a-z]+[._-][a-z]+$')")
def person_format_evidence(s, d):
    return contacts.person_format_evidence(_emails(s, d))


@query(f"WITH {O.CLASSED} SELECT email, count(*) AS n_domains FROM classed WHERE email_class <> 'junk' AND NOT own GROUP BY email HAVING count(*) >= 2")
def shared_offdomain_contacts(s, d):
    return contacts.shared_offdomain(_emails(s, d))


@query(f"""WITH {O.SITE_PAGES} SELECT domain, rn, page_id, slug FROM (SELECT domain, page_id, slug, row_number() OVER (PARTITION BY domain ORDER BY coalesce(nullif(list_position(['contact', 'team', 'about', 'home'], slug), 0), 5), page_id) AS rn
  FROM site_pages WHERE length(html) >= 500) WHERE rn <= 4""")
def rank_pages_per_domain(s, d):
    return contacts.rank_pages(X.site_pages(s, d), ["contact", "team", "about", "home"], 4)


_ROW = '<li><a href="([^"]*)">([^<]*)</a></li>'


@query(f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rn, name, link FROM (
  SELECT page_id, place, name, link, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY place) AS k FROM (
    SELECT page_id, i AS place, trim(regexp_replace(names[i], '\\s+', ' ', 'g')) AS name, links[i] AS link
    FROM (SELECT page_id, {O.every("html", _ROW, 1)} AS links, {O.every("html", _ROW, 2)} AS names FROM pages), unnest(range(1, len(names) + 1)) AS u(i)) WHERE name <> '') WHERE k = 1""")
def extract_listing_rows(s, d):
    return contacts.listing_rows(X.table(s, d, "pages"))


@query(f"WITH {O.SITES} SELECT domain, {O.INTAKE} AS intake FROM sites")
def detect_intake_signal(s, d):
    return signals.site_signals(X.site_pages(s, d)).select("domain", signals.intake_signal().alias("intake"))


@query(f"WITH {O.SITES} SELECT domain, rooms, five, four, len(scale)::BIGINT AS n_scale, {O.SCALE} AS scale FROM sites")
def detect_property_scale(s, d):
    t = signals.site_signals(X.site_pages(s, d))
    return t.select("domain", "rooms", "five", "four", F.size("scale").cast("long").alias("n_scale"), signals.property_scale().alias("scale"))


@query(f"WITH {O.SITES} SELECT domain, r_jsonld, r_microdata, r_text, {O.REVIEWS} AS reviews FROM sites")
def detect_review_count(s, d):
    return signals.site_signals(X.site_pages(s, d)).select("domain", "r_jsonld", "r_microdata", "r_text", signals.review_count().alias("reviews"))


@query(f"WITH {O.SITES} SELECT domain, {O.TRACKERS} AS trackers FROM sites")
def detect_tracker_depth(s, d):
    return signals.site_signals(X.site_pages(s, d)).select("domain", signals.tracker_depth().alias("trackers"))


@query(f"WITH {O.CANDIDATES}, {O.TRAFFIC} SELECT domain, branches, load::BIGINT AS load FROM traffic")
def detect_operational_load(s, d):
    return gates.traffic_of_candidates(X.site_pages(s, d), X.candidates(s, d)).select("domain", "branches", "load")


@query(f"WITH {O.CANDIDATES}, {O.TRAFFIC} SELECT domain, reviews, trackers, load::BIGINT AS load, traffic_score::BIGINT AS traffic_score, traffic_tier FROM traffic")
def score_traffic(s, d):
    return gates.traffic_of_candidates(X.site_pages(s, d), X.candidates(s, d)).select("domain", "reviews", "trackers", "load", "traffic_score", "traffic_tier")


_LEAD = ["domain", "seq", "vertical", "country", "branches", "intake", "hotel_volume", "best_email", "email_class", "n_emails", "score", "traffic_score", "traffic_tier"]
_LEAD_SQL = "domain, seq, vertical, country, branches, intake, hotel_volume, best_email, email_class, n_emails, score::BIGINT AS score, traffic_score::BIGINT AS traffic_score, traffic_tier"
_REASON = f"CASE WHEN email_class = 'personal' THEN 'freemail-only' WHEN intake = 'modern_booking' THEN 'dead-signal:' || intake WHEN score < {gates.MIN_SCORE} THEN 'score<{gates.MIN_SCORE}'"
_VOLUME = f"WHEN vertical IN {O.some(K.HOTEL_VERTICALS)} AND CASE hotel_volume WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 0 END < 1 THEN 'hotel-volume-too-low'"
_TRAFFIC = "WHEN traffic_tier <> 'unknown' AND CASE traffic_tier WHEN 'low' THEN 0 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END < 2 THEN 'traffic-too-low'"
_QUALIFIED = f"{O.LEADS}, qualified AS (SELECT *, {_REASON} {_VOLUME} {_TRAFFIC} END AS drop_reason FROM leads)"
_ORDER = "CASE hotel_volume WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'na' THEN 2 ELSE 3 END, score DESC, CASE email_class WHEN 'person' THEN 0 WHEN 'role' THEN 1 WHEN 'personal' THEN 2 ELSE 3 END, CASE traffic_tier WHEN 'low' THEN 0 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 1 END DESC, traffic_score DESC, branches DESC, seq"


@query(f"WITH {O.LEADS} SELECT {_LEAD_SQL} FROM leads")
def score_lead(s, d):
    return _leads(s, d).select(*_LEAD)


@query(f"WITH {_QUALIFIED} SELECT domain, seq, drop_reason FROM qualified")
def qualify_leads(s, d):
    return gates.qualify_leads(_leads(s, d), "medium", "medium").select("domain", "seq", "drop_reason")


@query(f"WITH {O.LEADS} SELECT domain, seq, {_REASON} END AS drop_reason FROM leads")
def qualify_leads_no_floor(s, d):
    return gates.qualify_leads(_leads(s, d), "huge", None).select("domain", "seq", "drop_reason")


@query(f"WITH {_QUALIFIED} SELECT DISTINCT domain, drop_reason AS reason FROM qualified WHERE drop_reason IS NOT NULL AND drop_reason <> 'traffic-too-low'")
def disqualify_rows(s, d):
    return gates.disqualify_rows(gates.qualify_leads(_leads(s, d), "medium", "medium"))


@query(f"WITH {O.LEADS} SELECT {_LEAD_SQL} FROM leads WHERE {_REASON} END IS NULL ORDER BY {_ORDER} LIMIT 250")
def rank_and_cap(s, d):
    return gates.rank_and_cap(gates.qualify_leads(_leads(s, d)).where("drop_reason is null")).select(*_LEAD)


@query(f"WITH {O.CANDIDATES}, {O.TRAFFIC} SELECT domain FROM traffic WHERE in_platform")
def drop_solved_gap(s, d):
    return gates.traffic_of_candidates(X.site_pages(s, d), X.candidates(s, d)).where("in_platform").select("domain")


@query(f"WITH {O.LEADS} SELECT vertical, count(*) AS n, count(*) FILTER (WHERE email_class = 'person') AS person, count(*) FILTER (WHERE email_class = 'role') AS role, count(*) FILTER (WHERE email_class = 'personal') AS personal FROM leads GROUP BY vertical")
def class_distribution(s, d):
    return _leads(s, d).groupBy("vertical").agg(F.count("*").alias("n"), *[F.count_if(F.col("email_class") == c).alias(c) for c in ("person", "role", "personal")])


@query(f"WITH {O.CANDIDATES}, {O.TRAFFIC}, g AS (SELECT vertical, traffic_tier, count(*) AS n FROM traffic GROUP BY GROUPING SETS ((traffic_tier), (vertical, traffic_tier))) SELECT vertical, traffic_tier, n, round(n * 100.0 / sum(n) OVER (PARTITION BY vertical), 2)::DOUBLE AS percent FROM g")
def traffic_report(s, d):
    r = reports.traffic_report(gates.traffic_of_candidates(X.site_pages(s, d), X.candidates(s, d)))
    return r.withColumn("percent", F.col("percent").cast("double"))


_SIGNALS = [("chat_widget", "chat"), ("many_pages", f"n_pages >= {K.MANY_PAGES}"), ("multi_branch", f"branches >= {K.MANY_BRANCHES}"), ("multilang", "len(langs) >= 2")]
_SIGNALS += [(f"reviews_{k}", f"r_{k} > 0") for k in ("jsonld", "microdata", "text")] + [(f"tracker_{k}", f"tracker_{k}") for k in K.TRACKERS]


@query(f"WITH {O.CANDIDATES}, {O.TRAFFIC}, known AS (SELECT * FROM traffic WHERE traffic_tier <> 'unknown') " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS signal, count(*) AS n FROM known WHERE {c}) WHERE n > 0" for n, c in _SIGNALS))
def signal_frequency(s, d):
    return reports.signal_frequency(gates.traffic_of_candidates(X.site_pages(s, d), X.candidates(s, d)))


@query(f"WITH {O.CANDIDATES}, {O.SITES} SELECT domains, with_pages, round(with_pages / domains, 4) AS share, with_pages / domains < 0.4 AS warn FROM (SELECT count(DISTINCT c.domain) AS domains, count(DISTINCT s.domain) AS with_pages FROM candidates c LEFT JOIN sites s USING (domain))")
def page_yield(s, d):
    return reports.page_yield(X.candidates(s, d), signals.site_signals(X.site_pages(s, d)))


@query(f"""WITH {_QUALIFIED}, steps AS (SELECT 0::BIGINT AS step, 'sourced' AS stage, (SELECT count(DISTINCT domain) FROM candidates) AS n UNION ALL SELECT 1, 'fetched', (SELECT count(*) FROM sites)
  UNION ALL SELECT 2, 'extracted', (SELECT count(*) FROM leads) UNION ALL SELECT 3, 'qualified', (SELECT count(*) FROM qualified WHERE drop_reason IS NULL))
  SELECT step, stage, n, round(n / lag(n) OVER (ORDER BY step), 4) AS ratio FROM steps""")
def funnel_counts(s, d):
    leads = _leads(s, d)
    kept = gates.qualify_leads(leads, "medium", "medium").where("drop_reason is null")
    return reports.funnel([("sourced", X.candidates(s, d).select("domain").distinct()), ("fetched", signals.site_signals(X.site_pages(s, d))), ("extracted", leads), ("qualified", kept)])


_SHARED = "CASE WHEN seq % 10 = 0 THEN 'desk@shared.example' ELSE best_email END"


@query(f"WITH {O.LEADS} SELECT domain, address, first_value(domain) OVER (PARTITION BY address ORDER BY score DESC, seq) AS kept_by FROM (SELECT *, {_SHARED} AS address FROM leads)")
def dedup_contact_address(s, d):
    leads = _leads(s, d).withColumn("best_email", F.expr(_SHARED))
    return gates.dedup_address(leads).select("domain", F.col("best_email").alias("address"), "kept_by")


_RESULTS = "SELECT domain, seq % 9 <> 1 AS found, CASE WHEN seq % 9 <> 2 THEN 'Stone' END AS surname, CASE WHEN seq % 9 = 3 THEN 'info@' || domain WHEN seq % 9 = 5 THEN 'a.stone@dead.example' ELSE 'a.stone@' || domain END AS email, CASE WHEN seq % 9 = 4 THEN 'constructed' ELSE 'published' END AS basis, CASE WHEN seq % 9 NOT IN (4) THEN 'https://' || domain END AS url FROM leads WHERE seq % 9 <> 0"
_GATE = f"""{O.LEADS}, results AS ({_RESULTS}), gated AS (SELECT l.domain, l.seq, CASE WHEN found IS NULL THEN 'no_result' WHEN NOT found THEN 'no_match' WHEN coalesce(surname, '') = '' THEN 'no_name' WHEN split_part(email, '@', 1) IN {O.some(K.ROLE_LOCALS)} THEN 'no_direct_email'
  WHEN basis = 'constructed' AND url IS NULL THEN 'no_evidence' WHEN split_part(email, '@', -1) NOT IN (SELECT domain FROM leads) THEN 'dead_domain' END AS drop_stage FROM leads l LEFT JOIN results r USING (domain))"""


def _gated(s, d):
    leads = _leads(s, d)
    n = F.col("seq") % 9
    results = leads.where(n != 0).select(
        "domain", (n != 1).alias("found"), F.when(n != 2, "Stone").alias("surname"),
        F.when(n == 3, F.concat(F.lit("info@"), "domain")).when(n == 5, "a.stone@dead.example").otherwise(F.concat(F.lit("a.stone@"), "domain")).alias("email"),
        F.when(n == 4, "constructed").otherwise("published").alias("basis"), F.when(n != 4, F.concat(F.lit("https://"), "domain")).alias("url"),
    )
    return gates.gate_contacts(leads, results, leads.select("domain"))


@query(f"WITH {_GATE} SELECT domain, drop_stage FROM gated")
def gate_contacts(s, d):
    return _gated(s, d).select("domain", "drop_stage")


@query(f"WITH {_GATE} SELECT coalesce(drop_stage, 'kept') AS stage, count(*) AS n FROM gated GROUP BY 1")
def enrich_summary(s, d):
    return _gated(s, d).groupBy(F.coalesce("drop_stage", F.lit("kept")).alias("stage")).agg(F.count("*").alias("n"))


@query(f"WITH {_GATE} SELECT domain, CASE drop_stage WHEN 'no_match' THEN 'no-contact-found' WHEN 'no_direct_email' THEN 'no-direct-mailbox' ELSE 'dead-domain' END AS reason FROM gated WHERE drop_stage IN ('no_match', 'no_direct_email', 'dead_domain')")
def retire_unreachable(s, d):
    g = _gated(s, d).where(F.col("drop_stage").isin("no_match", "no_direct_email", "dead_domain"))
    return g.select("domain", F.when(F.col("drop_stage") == "no_match", "no-contact-found").when(F.col("drop_stage") == "no_direct_email", "no-direct-mailbox").otherwise("dead-domain").alias("reason"))


@query(f"WITH {_QUALIFIED} SELECT n_in, n_kept, ceil(20 * n_in / n_kept)::BIGINT AS needed, n_in < ceil(20 * n_in / n_kept) AS short FROM (SELECT count(*) AS n_in, count(*) FILTER (WHERE drop_reason IS NULL) AS n_kept FROM qualified)")
def target_shortfall(s, d):
    q = gates.qualify_leads(_leads(s, d), "medium", "medium").agg(F.count("*").alias("n_in"), F.count_if(F.col("drop_reason").isNull()).alias("n_kept"))
    return reports.target_shortfall(q, 20)


@query(f"WITH {_QUALIFIED} SELECT traffic_tier, count(*) AS n, count(*) FILTER (WHERE drop_reason IS NULL) AS survived FROM qualified GROUP BY traffic_tier")
def tier_outcome_crosstab(s, d):
    return gates.qualify_leads(_leads(s, d), "medium", "medium").groupBy("traffic_tier").agg(F.count("*").alias("n"), F.count_if(F.col("drop_reason").isNull()).alias("survived"))


_OPEN = "CASE intake WHEN 'whatsapp' THEN 'I saw that guests write to you on WhatsApp' WHEN 'contact_form' THEN 'I found the form on your site' ELSE 'I came across your site' END"


@query(f"WITH {O.LEADS} SELECT domain, 'Dear ' || coalesce(nullif(split_part(split_part(best_email, '@', 1), '.', 1), ''), 'team') || ', ' || {_OPEN} || '. Is the ' || vertical || ' in ' || country || ' open to a talk?' AS body, floor((row_number() OVER (ORDER BY seq) - 1) / 10)::BIGINT AS batch_index FROM leads")
def render_messages(s, d):
    from leadloom.operators.drafts import plan_batches, render

    openers = s.createDataFrame([("whatsapp", "I saw that guests write to you on WhatsApp"), ("contact_form", "I found the form on your site")], "intake string, opener string")
    text = "Dear {name}, {opener}. Is the {vertical} in {country} open to a talk?"
    leads = _leads(s, d).withColumn("name", F.coalesce(F.nullif(F.substring_index(F.substring_index("best_email", "@", 1), ".", 1), F.lit("")), F.lit("team")))
    drafts = render(leads, openers, text, "I came across your site", ["name", "opener", "vertical", "country"])
    return plan_batches(drafts, "seq", 10).select("domain", "body", "batch_index")
