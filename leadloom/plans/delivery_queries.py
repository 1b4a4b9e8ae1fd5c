"""Queries over senders' days, message queues, states by now, page digests and runs' funnels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.operators import contacts, gates, pages, reports
from leadloom.operators import lifecycle as L
from leadloom.operators import people as P
from leadloom.sources import fixtures as X

from . import oracle_parts as O
from . import record_queries as R
from . import site_queries as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- senders --------------------------------------------------------------------
def _sender_days(status: str) -> str:
    return f"""{O.SEND_EVENTS}, d AS (SELECT address, ts::DATE AS day, count(*) AS n FROM send_events WHERE status = {O.q(status)} GROUP BY 1, 2),
  x AS (SELECT *, (sum(n) OVER (PARTITION BY address ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS week, row_number() OVER (PARTITION BY address ORDER BY day) AS campaign_day FROM d)"""


def _cap(ramp, most: int) -> str:
    return "CASE " + " ".join(f"WHEN {'true' if to is None else f'campaign_day <= {to}'} THEN {min(cap, most)}" for to, cap in ramp) + " END"


@query(f"WITH {_sender_days('sent')} SELECT address, day, greatest(0, least({_cap(K.RAMP, K.DAILY_MAX)} - n, {K.DAILY_MAX} - n, {K.WEEKLY_MAX} - week)) AS room FROM x")
def remaining_room_by_sender(s, d):
    x = L.sender_days(X.send_events(s, d))
    return x.select("address", "day", L.remaining_room(F.col("n"), F.col("week"), L.ramp_cap(F.col("campaign_day"))).alias("room"))


@query(f"WITH {_sender_days('dm_sent')} SELECT address, day, greatest(0, least({_cap(K.MESSAGE_RAMP, K.MESSAGE_DAILY_MAX)} - n, {K.MESSAGE_WEEKLY_MAX} - week)) AS room FROM x")
def message_room_by_sender(s, d):
    x = L.sender_days(X.send_events(s, d), "dm_sent")
    return x.select("address", "day", L.message_room(F.col("n"), F.col("week"), L.ramp_cap(F.col("campaign_day"), K.MESSAGE_RAMP, K.MESSAGE_DAILY_MAX)).alias("room"))


@query(f"""WITH {O.SEND_EVENTS}, d AS (SELECT address, ts::DATE AS day, count(*) FILTER (WHERE status = 'sent') AS sent, max(ts) FILTER (WHERE status = 'failed') AS failure,
    count(*) FILTER (WHERE status = 'attempting') AS attempts, count(*) FILTER (WHERE status = 'attempting' AND NOT dry_run) AS queued FROM send_events GROUP BY 1, 2),
  f AS (SELECT *, failure IS NOT NULL AS breaker, coalesce(max(failure) OVER (PARTITION BY address ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 48 HOUR > day, false) AS cooldown,
    greatest(0, sum(attempts - sent) OVER w)::BIGINT AS backlog, max(CASE WHEN attempts > 0 THEN day END) OVER w AS queue_date FROM d WINDOW w AS (PARTITION BY address ORDER BY day ROWS UNBOUNDED PRECEDING)),
  v AS (SELECT *, CASE WHEN dayofweek(day) IN (0, 6) THEN 'not a send day' WHEN cooldown THEN 'cooldown' WHEN sent > 0 THEN 'sent' WHEN backlog = 0 THEN 'no supply' WHEN breaker THEN 'breaker'
    WHEN queue_date IS NULL THEN 'no queue' WHEN queue_date <> day THEN 'stale queue' WHEN queued = 0 THEN 'empty queue' ELSE 'silent failure' END AS verdict FROM f)
  SELECT address, day, sent, backlog, queued, verdict, verdict IN ('not a send day', 'cooldown', 'sent', 'no supply', 'breaker') AS ok FROM v""")
def heartbeat_by_sender(s, d):
    return L.heartbeat_rules(L.sender_facts(X.send_events(s, d))).select("address", "day", "sent", "backlog", "queued", "verdict", "ok")


# ---- states and message queues ---------------------------------------------------
@query(f"""WITH {R._LIFE}, {O.PEOPLE}, m AS (SELECT max(ts) AS now FROM send_events), listed AS (SELECT DISTINCT o_custkey AS profile FROM orders WHERE o_orderstatus = 'O')
  SELECT l.profile, CASE WHEN status = 'attempting' AND since <= now - INTERVAL 5 MINUTE THEN 'unknown' WHEN status = 'sent' AND x.profile IS NOT NULL THEN CASE WHEN since < now - INTERVAL {K.PENDING_DAYS} DAY THEN 'withdrawn' ELSE 'sent' END
    WHEN status = 'sent' THEN CASE WHEN degree = 1 THEN 'accepted' ELSE 'expired' END ELSE status END AS status, since
  FROM life l CROSS JOIN m LEFT JOIN listed x ON l.profile = x.profile LEFT JOIN people p ON l.profile = p.person_id""")
def lifecycle_outcomes(s, d):
    e = X.send_events(s, d)
    listed = X.table(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("profile"))
    people = X.people(s, d).select(F.col("person_id").alias("profile"), "degree")
    return R._ntz(L.outcomes(L.lifecycle_state(e), e.agg(F.max("ts").alias("now")), listed, people), "since")


_FLAGS = "SELECT profile AS id, bool_or(status = 'accepted') AS accepted, bool_or(status = 'dm_sent') AS messaged, bool_or(status = 'failed') AS closed FROM send_events GROUP BY 1"


@query(f"""WITH {O.SEND_EVENTS}, {O.PEOPLE}, f AS ({_FLAGS}),
  urls AS (SELECT person_id AS lead_id, {O.PROFILE("profile_url")} AS profile, 140 - coalesce(last_activity_days, 140) AS score, open_profile, title FROM people),
  states AS (SELECT u.profile, bool_or(accepted) AS accepted, bool_or(messaged) AS messaged, bool_or(closed) AS closed FROM f JOIN urls u ON f.id = u.lead_id GROUP BY 1),
  barred AS (SELECT DISTINCT u.profile FROM customer JOIN urls u ON c_custkey = u.lead_id WHERE c_acctbal < 0),
  j AS (SELECT u.*, coalesce(accepted, false) AS accepted, CASE WHEN u.profile IS NULL THEN 'no profile' WHEN b.profile IS NOT NULL THEN 'suppressed' WHEN coalesce(messaged, false) THEN 'already messaged' WHEN coalesce(closed, false) THEN 'not messageable'
      WHEN NOT coalesce(accepted, false) AND NOT open_profile THEN 'no consent' WHEN trim(title) = '' THEN 'empty message' END AS v
    FROM urls u LEFT JOIN states s ON u.profile = s.profile LEFT JOIN barred b ON u.profile = b.profile),
  k AS (SELECT lead_id, profile, score, accepted, CASE WHEN profile IS NOT NULL AND lead_id > min(CASE WHEN v IS NULL THEN lead_id END) OVER (PARTITION BY profile) THEN 'duplicate' ELSE v END AS v FROM j),
  r AS (SELECT *, CASE WHEN v IS NULL THEN row_number() OVER (PARTITION BY v IS NULL ORDER BY score DESC, lead_id) END AS rn FROM k)
  SELECT lead_id, profile, CASE WHEN v IS NULL AND rn > 25 THEN 'over cap' ELSE v END AS verdict, CASE WHEN rn <= 25 THEN CASE WHEN accepted THEN 'accepted' ELSE 'open profile' END END AS via, CASE WHEN rn <= 25 THEN rn END AS rn FROM r""")
def select_dm_queue_gated(s, d):
    flag = lambda v: F.bool_or(F.col("status") == v)
    f = X.send_events(s, d).groupBy(F.col("profile").alias("lead_id")).agg(flag("accepted").alias("accepted"), flag("dm_sent").alias("messaged"), flag("failed").alias("closed"))
    score = F.lit(140) - F.coalesce("last_activity_days", F.lit(140))
    leads = X.people(s, d).select(F.col("person_id").alias("lead_id"), F.col("profile_url").alias("url"), score.alias("score"), "open_profile", F.col("title").alias("message"))
    urls = leads.select("lead_id", P.profile_url(F.col("url")).alias("profile"))
    states = f.join(urls, "lead_id").groupBy("profile").agg(*[F.bool_or(c).alias(c) for c in ("accepted", "messaged", "closed")])
    barred = X.table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("lead_id")).join(urls, "lead_id").select("profile").distinct()
    return P.select_messages(leads, states, barred, 25)


# ---- pages ------------------------------------------------------------------------
_TIDY = "regexp_replace(regexp_replace(lower(e), '^(%20)+', ''), '^\\.+', '')"


def _found(part: int, of: str) -> str:
    return f"SELECT domain, slug, page_id, {part} AS part, i AS place, w[i] AS e FROM (SELECT domain, slug, page_id, {of} AS w FROM site_pages WHERE length(html) >= 200), unnest(range(1, len(w) + 1)) AS u(i)"


_LOCAL, _DOM = "split_part(email, '@', 1)", "split_part(email, '@', -1)"
_JUNK = " OR ".join([f"len(string_split(email, '@')) <> 2 OR length({_LOCAL}) < 2 OR {_LOCAL} IN {O.some(K.PLACEHOLDER_LOCALS)}"] + [O.like("email", p) for p in K.JUNK])


@query(f"""WITH {O.SITE_PAGES}, found AS ({_found(0, O._WRITTEN)} UNION ALL {_found(1, O._LINKED)}),
  e AS (SELECT domain, email, min((part, slug, page_id, place)) AS first FROM (SELECT *, {_TIDY} AS email FROM found) GROUP BY domain, email),
  b AS (SELECT domain, email, first, CASE WHEN {_LOCAL} IN {O.some(K.ROLE_LOCALS)} THEN 'role' WHEN {_DOM} IN {O.some(K.FREEMAIL)} THEN 'freemail' WHEN {O.root("email")} <> {O.root("domain")} THEN 'offdomain' ELSE 'personal' END AS bucket FROM e WHERE NOT ({_JUNK}))
  SELECT * FROM (SELECT domain, bucket, row_number() OVER (PARTITION BY domain, bucket ORDER BY first) AS rn, email FROM b) WHERE rn <= 12""")
def bucket_contacts_first_seen(s, d):
    return contacts.bucket_contacts_first_seen(X.site_pages(s, d))


def _page_text() -> str:
    c = "html"
    for tag in K.HIDDEN_TAGS:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    c = f"regexp_replace({c}, '<[^>]+>', chr(10), 'g')"
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("\u00a0", " ")):
        c = f"replace({c}, {O.q(code)}, {O.q(char)})"
    return f"regexp_replace({c}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"


_PLACE = "CASE " + " ".join(f"WHEN starts_with(lower(slug), {O.q(k)}) THEN {i}" for i, k in enumerate(K.PEOPLE_PAGES)) + " END"


@query(f"""WITH {O.SITE_PAGES}, r AS (SELECT *, {_PLACE} AS rank FROM site_pages),
  l AS (SELECT domain, rank, page_id, slug, i AS place, trim(ls[i]) AS line FROM (SELECT domain, rank, page_id, slug, string_split({_page_text()}, chr(10)) AS ls FROM r WHERE rank IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
  k AS (SELECT *, row_number() OVER (PARTITION BY domain, lower(line) ORDER BY rank, page_id, place) AS k FROM l WHERE length(line) >= 3 AND NOT {O.like("line", "(?i)" + K.BANNER)}),
  p AS (SELECT domain, rank, page_id, slug, string_agg(line, chr(10) ORDER BY place) AS text FROM k WHERE k = 1 GROUP BY domain, rank, page_id, slug),
  o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY rank, page_id) AS rn, coalesce(sum(least(length(text), 1200)) OVER (PARTITION BY domain ORDER BY rank, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p WHERE length(text) >= 80)
  SELECT domain, rn, page_id, slug, left(text, least(1200, 2000 - used)::BIGINT) AS text FROM o WHERE rn <= 3 AND used < 2000""")
def people_digest(s, d):
    return pages.people_digest(X.site_pages(s, d), total=2000)


# ---- runs ---------------------------------------------------------------------------
_STAGES = ("sourced", "fetched", "extracted", "qualified", "enriched", "sent")


@query(f"""WITH {O.LEDGER}, {S._QUALIFIED[len(O.CANDIDATES) + 2 :]}, mailed AS (SELECT DISTINCT domain FROM ledger_lines WHERE kind = 'email'),
  f AS (SELECT c.batch_file AS run, true AS sourced, s.domain IS NOT NULL AS fetched, q.domain IS NOT NULL AS extracted, q.domain IS NOT NULL AND q.drop_reason IS NULL AS qualified,
      q.domain IS NOT NULL AND q.drop_reason IS NULL AND q.email_class = 'person' AS enriched, q.domain IS NOT NULL AND q.drop_reason IS NULL AND q.email_class = 'person' AND m.domain IS NOT NULL AS sent
    FROM candidates c JOIN first_candidate USING (domain, seq) LEFT JOIN sites s ON c.domain = s.domain LEFT JOIN qualified q ON c.domain = q.domain LEFT JOIN mailed m ON c.domain = m.domain),
  n AS ({" UNION ALL ".join(f"SELECT run, {i}::BIGINT AS step, {O.q(c)} AS stage, count(*) FILTER (WHERE {c}) AS n FROM f GROUP BY run" for i, c in enumerate(_STAGES))})
  SELECT run, step, stage, n, round(n / nullif(lag(n) OVER (PARTITION BY run ORDER BY step), 0), 4) AS ratio FROM n""")
def funnel_by_run(s, d):
    c = X.candidates(s, d)
    c = c.join(c.groupBy("domain").agg(F.min("seq").alias("seq")), ["domain", "seq"]).select("domain", F.col("batch_file").alias("run"))
    fetched = X.site_pages(s, d).where(F.char_length("html") >= 500).select("domain", F.lit(True).alias("fetched")).distinct()
    q = gates.qualify_leads(S._leads(s, d), "medium", "medium").select("domain", F.lit(True).alias("extracted"), F.col("drop_reason").isNull().alias("qualified"), (F.col("email_class") == "person").alias("person"))
    mailed = X.ledger_lines(s, d).where("kind = 'email'").select("domain", F.lit(True).alias("mailed")).distinct()
    f = c.join(fetched, "domain", "left").join(q, "domain", "left").join(mailed, "domain", "left").withColumn("sourced", F.lit(True))
    enriched = F.col("qualified") & F.col("person")
    return reports.funnel_by_run(f.withColumns({"enriched": enriched, "sent": enriched & F.col("mailed")}), list(_STAGES))


@query(f"WITH {S._QUALIFIED} SELECT n_kept, 40::BIGINT AS needed, greatest(350, 3 * 40)::BIGINT AS candidates, n_kept < 40 AS short FROM (SELECT count(*) FILTER (WHERE drop_reason IS NULL) AS n_kept FROM qualified)")
def target_plan(s, d):
    q = gates.qualify_leads(S._leads(s, d), "medium", "medium").agg(F.count_if(F.col("drop_reason").isNull()).alias("n_kept"))
    return reports.target_plan(q, 20, 0.5, 350)


@query(f"WITH {S._QUALIFIED} SELECT count(*) AS n, count(*) FILTER (WHERE drop_reason IS NULL) AS survived, round(corr(CASE WHEN drop_reason IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, traffic_score::DOUBLE), 4) AS correlation FROM qualified")
def tier_score_correlation(s, d):
    return reports.score_survival(gates.qualify_leads(S._leads(s, d), "medium", "medium"))
