"""Queries over candidates, ledgers, people, messages, places and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import company_key
from leadloom.operators import candidates as C
from leadloom.operators import drafts as D
from leadloom.operators import geo as G
from leadloom.operators import lifecycle as L
from leadloom.operators import neardup as N
from leadloom.operators import people as P
from leadloom.operators import sketches
from leadloom.operators.entities import top_n_per_group
from leadloom.sources import fixtures as X

from . import oracle_parts as O

QUERIES, ORACLE_SQL = {}, {}
TODAY = "2024-03-01"
ZONE = "Europe/Paris"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- candidates and ledgers ---------------------------------------------------
_LINES = f"{O.CANDIDATES}, lines AS (SELECT seq, CASE WHEN seq % 13 = 0 THEN '# note' WHEN seq % 17 = 0 THEN '' WHEN seq % 19 = 0 THEN domain || '|x' ELSE domain || ' | ' || replace(name, '|', '/') || '|' || country || '|' || vertical || '|' || CASE WHEN seq % 5 = 0 THEN 'n/a' ELSE branches::VARCHAR END END AS line FROM candidates)"


def _lines(s, d):
    c = X.candidates(s, d)
    n = F.col("seq")
    row = F.concat("domain", F.lit(" | "), F.replace("name", F.lit("|"), F.lit("/")), F.lit("|"), "country", F.lit("|"), "vertical", F.lit("|"), F.when(n % 5 == 0, "n/a").otherwise(F.col("branches").cast("string")))
    return c.select("seq", F.when(n % 13 == 0, "# note").when(n % 17 == 0, "").when(n % 19 == 0, F.concat("domain", F.lit("|x"))).otherwise(row).alias("line"))


@query(f"""WITH {_LINES} SELECT seq, trim(p[1]) AS domain, trim(p[2]) AS name, trim(p[3]) AS country, trim(p[4]) AS vertical, coalesce(try_cast(p[5] AS BIGINT), 0) AS branches
  FROM (SELECT seq, line, string_split(line, '|') AS p FROM lines WHERE NOT starts_with(trim(line), '#') AND trim(line) <> '') WHERE len(p) >= 4""")
def scan_candidates(s, d):
    return C.parse_candidates(_lines(s, d))


@query(f"""WITH {O.CANDIDATES}, x AS (SELECT seq, CASE WHEN seq % 7 = 3 THEN replace(name, '|', '/') || '|' || country ELSE replace(name, '|', '/') || '|' || country || '|city' || seq % 9 || '|' || vertical END AS line FROM candidates WHERE NOT linked)
  SELECT seq, name, country, city, vertical, row_number() OVER (ORDER BY seq) > 20 AS over_cap FROM (SELECT seq, trim(p[1]) AS name, trim(p[2]) AS country, trim(p[3]) AS city, trim(p[4]) AS vertical FROM (SELECT seq, string_split(line, '|') AS p FROM x) WHERE len(p) = 4) WHERE name <> ''""")
def scan_unresolved(s, d):
    c = X.candidates(s, d).where("not linked")
    name = F.replace("name", F.lit("|"), F.lit("/"))
    full = F.concat(name, F.lit("|"), "country", F.lit("|city"), (F.col("seq") % 9).cast("string"), F.lit("|"), "vertical")
    return C.parse_unresolved(c.select("seq", F.when(F.col("seq") % 7 == 3, F.concat(name, F.lit("|"), "country")).otherwise(full).alias("line")), 20)


_KEYS = f"""keys AS (SELECT DISTINCT key_type, lower(v) AS key_value FROM (
  SELECT 'email' AS key_type, unnest({O.every("line", K.EMAIL)}) AS v FROM ledger_lines UNION ALL SELECT 'slug', unnest({O.every("line", r"\[\[([^\]]+)\]\]", 1)}) FROM ledger_lines
  UNION ALL SELECT 'phone', unnest({O.every("line", "wa:([0-9]{6,15})", 1)}) FROM ledger_lines UNION ALL SELECT 'message', unnest({O.every("line", r"<([^<>\s]+@[^<>\s]+)>", 1)}) FROM ledger_lines)
  WHERE NOT (key_type = 'email' AND (contains(lower(v), 'smtp-relay') OR contains(lower(v), 'mailin.fr'))))"""


@query(f"WITH {O.LEDGER}, {_KEYS} SELECT key_type, key_value FROM keys")
def scan_contact_ledger(s, d):
    return C.ledger_keys(X.ledger_lines(s, d))


@query(f"""WITH {O.LEDGER} SELECT DISTINCT CASE WHEN e <> '' THEN 'email' ELSE 'domain' END AS key_type, CASE WHEN e <> '' THEN e ELSE f END AS key_value FROM (
  SELECT lower(regexp_extract(line, {O.q(K.EMAIL)}, 0)) AS e, lower(trim(string_split(line, '|')[2])) AS f FROM ledger_lines WHERE NOT regexp_matches(line, '^[#>`-]')) WHERE e <> '' OR regexp_matches(f, '^[^ ]+\\.[^ ]+$')""")
def scan_bounce_ledger(s, d):
    return C.bounce_keys(X.ledger_lines(s, d))


@query(f"WITH {O.LEDGER}, {_KEYS} SELECT key_value FROM keys WHERE key_type = 'email'")
def scan_suppression(s, d):
    return C.ledger_keys(X.ledger_lines(s, d)).where("key_type = 'email'").select("key_value")


@query(f"WITH {O.LEDGER} SELECT m, domain, entry_date FROM ledger_lines WHERE run_id <> 'r1' AND (DATE '{TODAY}' - entry_date) <= 30")
def ledger_window(s, d):
    return C.ledger_window(X.ledger_lines(s, d), "r1", TODAY, 30).select("m", "domain", "entry_date")


_MERGED = f"""{O.LEDGER}, flagged AS (SELECT c.*, CASE WHEN country NOT IN {O.some(X.ALLOWED)} THEN 'country'
    WHEN domain IN (SELECT domain FROM ledger_lines WHERE kind = 'email') OR replace(domain, '.', '-') IN (SELECT replace(domain, '.', '-') FROM ledger_lines WHERE kind = 'slug') THEN 'sent'
    WHEN domain IN (SELECT domain FROM ledger_lines WHERE kind = 'disqualified') THEN 'disqualified' END AS bad FROM candidates c),
  merged AS (SELECT f.*, CASE WHEN seq > min(seq) FILTER (WHERE bad IS NULL) OVER (PARTITION BY domain) THEN 'duplicate' ELSE bad END AS drop_reason FROM flagged f)"""


def _merged(s, d):
    led = X.ledger_lines(s, d)
    slugs = led.where("kind = 'slug'").select(F.replace("domain", F.lit("."), F.lit("-")).alias("slug"))
    return C.merge_candidates(X.candidates(s, d), X.ALLOWED, led.where("kind = 'email'"), slugs, led.where("kind = 'disqualified'"))


@query(f"WITH {_MERGED} SELECT seq, domain, country, drop_reason FROM merged")
def merge_candidates(s, d):
    return _merged(s, d).select("seq", "domain", "country", "drop_reason")


@query(f"WITH {_MERGED}, g AS (SELECT coalesce(drop_reason, 'kept') AS drop_reason, country, count(*) AS n FROM merged WHERE drop_reason IS NULL OR drop_reason <> 'duplicate' GROUP BY 1, 2) SELECT drop_reason, country, n, round(n / sum(n) OVER (), 4) AS share FROM g")
def merge_drop_audit(s, d):
    return C.merge_audit(_merged(s, d))


@query(f"WITH {O.CANDIDATES} SELECT country, count(*) AS n FROM candidates WHERE country IN {O.some(X.ALLOWED)} GROUP BY country")
def allowed_countries(s, d):
    return X.candidates(s, d).where(F.col("country").isin(*X.ALLOWED)).groupBy("country").agg(F.count("*").alias("n"))


@query(f"WITH {O.LEDGER}, firsts AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS rn FROM candidates WHERE domain NOT IN (SELECT domain FROM ledger_lines)) SELECT seq, domain FROM firsts WHERE rn = 1")
def append_once(s, d):
    return C.append_once(X.ledger_lines(s, d), X.candidates(s, d), ["domain"], [F.col("seq")]).select("seq", "domain")


@query(f"""WITH {O.LEDGER}, {_KEYS}, bounced AS (SELECT domain FROM ledger_lines WHERE kind = 'bounce_domain') SELECT seq, domain FROM candidates
  WHERE 'info@' || domain NOT IN (SELECT key_value FROM keys WHERE key_type = 'email') AND replace(domain, '.', '-') NOT IN (SELECT key_value FROM keys WHERE key_type = 'slug') AND domain NOT IN (SELECT domain FROM bounced)""")
def suppress_contacts(s, d):
    led = X.ledger_lines(s, d)
    ledger = C.ledger_keys(led).union(led.where("kind = 'bounce_domain'").select(F.lit("domain").alias("key_type"), F.col("domain").alias("key_value")))
    drafts = X.candidates(s, d).withColumns({"email": F.concat(F.lit("info@"), "domain"), "slug": F.replace("domain", F.lit("."), F.lit("-"))})
    return C.suppress(drafts, {"email": "email", "slug": "slug", "domain": "domain"}, ledger, "seq").select("seq", "domain")


@query(f"WITH {O.CANDIDATES} SELECT vertical, country, count(*) AS n, string_agg(DISTINCT batch_file::VARCHAR, ',' ORDER BY batch_file::VARCHAR) AS files FROM candidates GROUP BY vertical, country")
def source_mix(s, d):
    return X.candidates(s, d).groupBy("vertical", "country").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("batch_file").cast("string"))), ",").alias("files"))


_PLACES = f"{O.CANDIDATES}, by_place AS (SELECT country || '-' || vertical AS place, min(seq) AS pos, count(*) AS n FROM candidates WHERE seq % 3 <> 1 OR country <> 'DE' GROUP BY 1)"


def _places(s, d):
    c = X.candidates(s, d).where("seq % 3 <> 1 or country <> 'DE'")
    return c.groupBy(F.concat("country", F.lit("-"), "vertical").alias("place")).agg(F.min("seq").alias("pos"), F.count("*").alias("n"))


@query(f"WITH {_PLACES} SELECT place, pos, n, before FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM by_place) WHERE before < 90")
def take_until_quota(s, d):
    return C.take_until(_places(s, d), "pos", "n", 90).select("place", "pos", "n", "before")


@query(f"WITH {O.CANDIDATES} SELECT country || '-' || seq % 97 AS place, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE NOT linked AND name <> '') AS named FROM candidates GROUP BY 1 HAVING count(*) FILTER (WHERE linked OR (name <> '' AND country <> 'FR')) > 0")
def sweep_ledger_rows(s, d):
    """Places that returned something count as swept; name-only rows count where names are looked up, which is not so for FR."""
    c = X.candidates(s, d).groupBy(F.concat("country", F.lit("-"), (F.col("seq") % 97).cast("string")).alias("place"))
    n = c.agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked") & (F.col("name") != "")).alias("named"), F.count_if(F.col("linked") | ((F.col("name") != "") & (F.col("country") != "FR"))).alias("some"))
    return n.where("some > 0").select("place", "linked", "named")


@query(f"WITH {_PLACES} SELECT place, pos FROM by_place WHERE place NOT IN (SELECT DISTINCT 'ES-' || vertical FROM candidates)")
def unswept_places(s, d):
    swept = X.candidates(s, d).select(F.concat(F.lit("ES-"), "vertical").alias("place")).distinct()
    return _places(s, d).join(swept, "place", "left_anti").select("place", "pos")


# ---- people -------------------------------------------------------------------
_T = lambda t: O.like("lower(title)", K.TITLE_TIERS[t])
_TIER = f"CASE WHEN {_T('T1')} THEN 'T1' WHEN {_T('T2')} THEN 'T2' WHEN {_T('T3')} THEN 'T3' END"
_REACH = "CASE WHEN degree = 1 THEN 'direct' WHEN open_profile THEN 'open profile' WHEN degree IN (2, 3) THEN 'invite' END"
_ROUTED = f"""{O.PEOPLE}, tiered AS (SELECT *, {_TIER} AS title_tier, {_REACH} AS reach_mode, coalesce(last_activity_days <= 90, false) AS alive, {O.PROFILE("profile_url")} AS url FROM people),
  routed AS (SELECT *, CASE WHEN title_tier IS NULL OR title_tier NOT IN ('T1', 'T2') THEN 'drop' WHEN alive AND reach_mode IS NOT NULL THEN 'linkedin' ELSE 'email' END AS route,
    CASE WHEN title_tier IS NULL OR title_tier NOT IN ('T1', 'T2') THEN 'title: tier ' || coalesce(title_tier, 'none') WHEN NOT alive THEN 'dormant' WHEN reach_mode IS NULL THEN 'unreachable' END AS reason FROM tiered)"""
_SCORE = "CASE title_tier WHEN 'T1' THEN 3 WHEN 'T2' THEN 2 ELSE 1 END + CASE WHEN last_activity_days <= 14 THEN 3 WHEN last_activity_days <= 30 THEN 2 WHEN last_activity_days <= 90 THEN 1 ELSE 0 END + CASE reach_mode WHEN 'direct' THEN 3.0 WHEN 'open profile' THEN 2.0 WHEN 'invite' THEN 1.5 ELSE 1.0 END + CASE WHEN mutuals >= 3 THEN 1.0 ELSE 0.0 END"
_SCORED = f"{_ROUTED}, scored AS (SELECT *, ({_SCORE})::DOUBLE AS score FROM routed WHERE route <> 'drop')"


def _routed(s, d):
    return P.qualify_people(P.canonical(X.people(s, d)))


def _scored(s, d):
    p = P.score_people(_routed(s, d).where("route <> 'drop'"))
    return p.withColumn("score", F.col("score").cast("double"))


@query(f"WITH {_ROUTED} SELECT person_id, title_tier, reach_mode, alive, route, reason FROM routed")
def qualify_people(s, d):
    return _routed(s, d).select("person_id", "title_tier", "reach_mode", "alive", "route", "reason")


@query(f"WITH {_ROUTED} SELECT route, split_part(coalesce(reason, ''), ':', 1) AS prefix, count(*) AS n FROM routed GROUP BY 1, 2")
def route_split(s, d):
    return _routed(s, d).groupBy("route", F.substring_index(F.coalesce("reason", F.lit("")), ":", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT person_id, url, score FROM scored")
def score_people(s, d):
    return _scored(s, d).select("person_id", "url", "score")


@query(f"WITH {_ROUTED}, w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN person_id % 3 = 0 THEN 0 ELSE 1 END, person_id) AS rn FROM routed WHERE url IS NOT NULL) SELECT person_id, url FROM w WHERE rn = 1")
def union_first_wins(s, d):
    p = _routed(s, d).select("person_id", "url")
    return P.union_first_wins(p.where("person_id % 3 = 0"), p.where("person_id % 3 <> 0"), "url", "person_id")


@query(f"WITH {O.PEOPLE}, held AS (SELECT DISTINCT {O.KEY('company')} AS key FROM people WHERE person_id % 7 = 0 AND company_id % 3 <> 1) SELECT company_id, name FROM companies WHERE {O.KEY('name')} NOT IN (SELECT key FROM held WHERE key IS NOT NULL) ORDER BY company_id LIMIT 40")
def coverage_gap(s, d):
    return P.coverage_gap(X.companies(s, d), X.people(s, d).where("person_id % 7 = 0 and company_id % 3 <> 1"), 40).select("company_id", "name")


@query(f"WITH {O.COMPANIES} SELECT {O.KEY('domain')} AS key FROM companies WHERE company_id % 6 = 0 UNION SELECT {O.KEY('domain')} FROM companies WHERE company_id % 6 = 1")
def blocked_companies(s, d):
    return P.blocked_keys(X.companies(s, d).where("company_id % 6 in (0, 1)"))


_HOLD = f"""{_SCORED}, k AS (SELECT person_id, score, {O.KEY('company')} AS key FROM scored WHERE headcount <= 6),
  last_contact AS (SELECT {O.KEY('name')} AS key, DATE '2024-02-01' + (company_id % 40)::INTEGER AS contacted FROM companies WHERE company_id % 3 = 0),
  win AS (SELECT person_id FROM k JOIN last_contact USING (key) WHERE DATE '{TODAY}' - contacted < 14),
  firsts AS (SELECT person_id, row_number() OVER (PARTITION BY key ORDER BY score DESC, person_id) AS rn FROM k WHERE person_id NOT IN (SELECT person_id FROM win))
  SELECT person_id, CASE WHEN person_id IN (SELECT person_id FROM win) THEN 'window' WHEN person_id IN (SELECT person_id FROM firsts WHERE rn > 1) THEN 'same firm' END AS hold FROM scored"""


@query(f"WITH {_HOLD}")
def coordination_hold(s, d):
    ranked = _scored(s, d).withColumn("keys", F.array_compact(F.array(company_key(F.col("company")))))
    c = X.companies(s, d).where("company_id % 3 = 0")
    last = c.select(company_key(F.col("name")).alias("key"), F.date_add(F.lit("2024-02-01").cast("date"), (F.col("company_id") % 40).cast("int")).alias("contacted"))
    return P.coordination_hold(ranked, last, TODAY).select("person_id", "hold")


@query()
def coordination_hold_graph(s, d):
    """Two keys a person, so who is kept is settled as a graph; tests hold it against the sequential loop."""
    ranked = _scored(s, d).withColumn("keys", F.array_distinct(F.array_compact(F.array(company_key(F.col("company")), F.concat(F.lit("c"), (F.col("company_id") % 11).cast("string"))))))
    return P.coordination_hold_exact(ranked)


@query(f"WITH {_ROUTED} SELECT person_id, CASE WHEN url IN (SELECT url FROM tiered WHERE person_id % 10 = 3) THEN 'profile' WHEN 'u' || person_id || '@example.com' IN (SELECT 'u' || person_id || '@example.com' FROM tiered WHERE person_id % 9 = 2) THEN 'email' END AS reason FROM tiered")
def profile_suppression(s, d):
    p = P.canonical(X.people(s, d)).withColumn("email", F.concat(F.lit("u"), F.col("person_id").cast("string"), F.lit("@example.com")))
    urls = p.where("person_id % 10 = 3").select(F.col("url").alias("u"), F.lit(True).alias("by_url")).distinct()
    mails = p.where("person_id % 9 = 2").select(F.col("email").alias("m"), F.lit(True).alias("by_mail")).distinct()
    out = p.join(urls, p.url == urls.u, "left").join(mails, p.email == mails.m, "left")
    return out.select("person_id", F.when(F.col("by_url"), "profile").when(F.col("by_mail"), "email").alias("reason"))


_MSG = "CASE WHEN p.person_id % 8 = 5 THEN '' ELSE coalesce(d.text, '') END"


@query(f"""WITH {_SCORED}, q AS (SELECT p.person_id, url, degree, score, {_MSG} AS message FROM scored p LEFT JOIN documents d ON d.doc_id = p.person_id),
  sup AS (SELECT DISTINCT url FROM scored WHERE person_id % 10 = 3), st AS (SELECT DISTINCT url FROM scored WHERE person_id % 11 = 4),
  r AS (SELECT *, CASE WHEN url IS NULL THEN 'bad url' WHEN row_number() OVER (PARTITION BY url ORDER BY person_id) > 1 THEN 'duplicate' WHEN url IN (SELECT url FROM sup) THEN 'suppressed' WHEN url IN (SELECT url FROM st) THEN 'in state' WHEN degree = 1 THEN 'reachable' WHEN message = '' THEN 'no message' END AS why FROM q)
  SELECT person_id, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why ORDER BY score DESC, person_id) > 30 THEN 'over cap' ELSE why END AS reason FROM r""")
def select_invite_queue(s, d):
    p = _scored(s, d).join(X.messages(s, d), F.col("person_id") == F.col("id"), "left")
    p = p.withColumn("message", F.when(F.col("person_id") % 8 == 5, "").otherwise(F.coalesce("text", F.lit(""))))
    q = p.select("person_id", "url", "degree", "score", "message")
    return P.select_queue(q, q.where("person_id % 10 = 3"), q.where("person_id % 11 = 4"), 30).select("person_id", "reason")


@query(f"WITH {_ROUTED}, m AS (SELECT doc_id AS id, text AS message FROM documents WHERE doc_id % 4 <> 2) SELECT person_id, message, CASE WHEN message IS NULL THEN 'none' ELSE 'id' END AS matched_by FROM tiered LEFT JOIN m ON id = person_id")
def attach_messages(s, d):
    m = X.messages(s, d).where("id % 4 <> 2").select("id", F.col("text").alias("message"))
    p = X.people(s, d).join(m, F.col("person_id") == F.col("id"), "left")
    return p.select("person_id", "message", F.when(F.col("message").isNull(), "none").otherwise("id").alias("matched_by"))


@query(f"WITH {_ROUTED}, g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY person_id) AS rn FROM tiered WHERE url IS NOT NULL AND company IS NOT NULL AND person_id % 6 <> 1) SELECT person_id, url, company FROM g WHERE rn = 1")
def found_profile_gate(s, d):
    p = P.canonical(X.people(s, d)).where("company is not null and person_id % 6 <> 1")
    return top_n_per_group(p.where("url is not null"), ["url"], [F.col("person_id")], 1).select("person_id", "url", "company")


@query(f"WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN person_id % 2 = 0 THEN 0 ELSE 1 END, person_id) AS rn FROM scored WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM scored WHERE person_id % 12 = 7 AND url IS NOT NULL)) SELECT person_id, url, score FROM b WHERE rn = 1")
def backlog_merge(s, d):
    p = _scored(s, d).select("person_id", "url", "score")
    spent = p.where("person_id % 12 = 7").select("url").distinct()
    rest = p.join(spent, "url", "left_anti").select("person_id", "url", "score")
    return P.union_first_wins(rest.where("person_id % 2 = 0"), rest.where("person_id % 2 <> 0"), "url", "person_id")


@query(f"WITH {O.COMPANIES}, k AS (SELECT *, {O.KEY('name')} AS key, row_number() OVER (PARTITION BY {O.KEY('name')} ORDER BY company_id) AS rn FROM companies) SELECT company_id, name, domain, country, headcount::BIGINT AS headcount FROM k WHERE key IS NOT NULL AND rn = 1")
def companies_from_leads(s, d):
    c = X.companies(s, d).withColumn("key", company_key(F.col("name"))).where("key is not null")
    return top_n_per_group(c, ["key"], [F.col("company_id")], 1).select("company_id", "name", "domain", "country", F.col("headcount").cast("long").alias("headcount"))


# ---- messages -----------------------------------------------------------------
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_SHINGLES = f"sh AS (SELECT DISTINCT doc_id AS id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0)"
_CLASSES = f"{_SHINGLES}, sets AS (SELECT id, list_sort(list(f)) AS fs FROM sh GROUP BY id), cls AS (SELECT id, min(id) OVER (PARTITION BY fs) AS rep FROM sets)"


def _shingle_classes(s, d):
    m = X.messages(s, d).where(F.size(N.words(F.col("text"))) > 0)
    return N.equal_sets(m.select("id", N.shingles(F.col("text"), 3).alias("items")))


@query(f"""WITH {_CLASSES}, r AS (SELECT sh.* FROM sh JOIN cls ON cls.id = sh.id AND cls.rep = cls.id), n AS (SELECT id, count(*) AS n FROM r GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM r x JOIN r y ON x.f = y.f AND x.id < y.id GROUP BY 1, 2)
  SELECT a, b, round(c / (p.n + q.n - c), 3) AS similarity FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c / (p.n + q.n - c) > 0.35
  UNION ALL SELECT rep, id, 1.0::DOUBLE FROM cls WHERE id <> rep""")
def word_shingle_pairs(s, d):
    """Pairs of messages alike above 0.35: the first messages of two shingle sets, and each message with the first that has its set."""
    return N.all_links(_shingle_classes(s, d), 0.35)


@query(f"WITH {_CLASSES} SELECT id, rep FROM cls")
def word_shingle_classes(s, d):
    return _shingle_classes(s, d).select("id", "rep")


def _opening(text):
    return F.array_join(F.slice(N.words(text), 1, 7), " ")


@query(f"SELECT opening, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, array_to_string(({_WORDS})[1:7], ' ') AS opening FROM documents WHERE len({_WORDS}) >= 7) GROUP BY opening HAVING count(*) > 1")
def shared_openings(s, d):
    """Messages that share their first seven words, as groups; a group is a row, not its pairs."""
    m = X.messages(s, d).where(F.size(N.words(F.col("text"))) >= 7)
    return m.groupBy(_opening(F.col("text")).alias("opening")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query()
def char_trigram_dedup(s, d):
    """Messages kept in order of id when one goes if its character trigrams are over 0.85 alike to a kept one's."""
    m = X.messages(s, d).where("text is not null").select("id", N.trigrams(N.message_body(F.col("text"))).alias("items"))
    sets = N.stored_sets(m)
    ids = N.first_ids(sets)
    return sketches.keep_first_by_tiles(sets, ids, 0.85).union(X.messages(s, d).where("text is null").select("id"))


_ERR = "array_to_string(list_filter([CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' END, CASE WHEN length(text) > 280 THEN 'too long' END, CASE WHEN regexp_matches(text, '\\{[a-z_]+\\}|\\[[A-Z ]+\\]') THEN 'placeholder' END], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT conv_id, turn, {_ERR} AS errors FROM conversations")
def message_shape_check(s, d):
    return X.table(s, d, "conversations").select("conv_id", "turn", F.array_join(N.message_errors(F.col("text"), 280), ",").alias("errors"))


@query(f"""WITH {_SHINGLES}, n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.f = y.f AND x.id < y.id GROUP BY 1, 2),
  o AS (SELECT array_to_string(({_WORDS})[1:7], ' ') AS opening FROM documents WHERE len({_WORDS}) >= 7 GROUP BY 1 HAVING count(*) > 1)
  SELECT exists(SELECT 1 FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c / (p.n + q.n - c) > 0.35) OR exists(SELECT 1 FROM o) AS refused""")
def reject_batch_if_dupes(s, d):
    """Refused if two messages are alike above 0.35, or share an opening of more than six words."""
    one = lambda df: df.select(F.lit(1).alias("hit")).limit(1)
    hits = one(shared_openings(s, d))
    if hits.isEmpty():  # an opening refuses the batch, whatever else is alike
        classes = _shingle_classes(s, d)
        hits = one(classes.where("id <> rep"))
        if hits.isEmpty():
            hits = one(N.similar_pairs(classes, 0.35))
    return hits.agg((F.count("*") > 0).alias("refused"))


@query(r"SELECT doc_id AS id, CASE WHEN NOT starts_with(text, 'The') THEN 'greeting' WHEN regexp_matches(lower(text), 'price|cost|\$') THEN 'money' WHEN NOT contains(text, 'th') THEN 'link' WHEN regexp_matches(lower(text), 'token') THEN 'banned' END AS drop_reason FROM documents")
def draft_contract_gate(s, d):
    return D.contract_gate(X.messages(s, d), "The", "th", r"price|cost|\$", "token").select("id", "drop_reason")


@query("SELECT doc_id AS id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 100)::BIGINT AS batch_index FROM documents")
def plan_send_batches(s, d):
    return D.plan_batches(X.messages(s, d).select("id"), "id", 100)


# ---- places ---------------------------------------------------------------------
@query(f"WITH {O.GEO} SELECT place, id FROM geo_points g JOIN places p ON g.lat BETWEEN p.lat - half AND p.lat + half AND g.lon BETWEEN p.lon - half AND p.lon + half")
def bbox_assign(s, d):
    return G.bbox_assign(X.geo_points(s, d), X.places(s))


@query(f"WITH {O.GEO}, r AS (SELECT floor(lat / 0.1)::BIGINT AS gx, floor(lon / 0.1)::BIGINT AS gy, count(*) AS n FROM geo_points GROUP BY 1, 2) SELECT 0.1::DOUBLE AS size, gx, gy, n, n < 1000000 AS complete FROM r")
def adaptive_cells_one_level(s, d):
    return G.adaptive_cells(X.geo_points(s, d), 0.1, 1_000_000, 0.01)


@query()
def adaptive_cells(s, d):
    return G.adaptive_cells(X.geo_points(s, d), 0.4, 20, 0.02)


# ---- events ---------------------------------------------------------------------
_STATE = """CASE status WHEN 'attempting' THEN 0 WHEN 'failed' THEN 0 WHEN 'sent' THEN 1 WHEN 'dm_sent' THEN 2 WHEN 'accepted' THEN 3 END"""
_LIFE = f"{O.SEND_EVENTS}, life AS (SELECT profile, status, ts AS since, n_events FROM (SELECT *, count(*) OVER (PARTITION BY profile) AS n_events, row_number() OVER (PARTITION BY profile ORDER BY {_STATE} DESC, ts, event_id) AS rn FROM send_events) WHERE rn = 1)"
_DAYS = f"{O.SEND_EVENTS}, days AS (SELECT ts::DATE AS day, count(*) AS n FROM send_events WHERE status = 'sent' GROUP BY 1)"


def _days(s, d):
    return X.send_events(s, d).where("status = 'sent'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(f"WITH {_LIFE} SELECT profile, status, since, n_events FROM life")
def lifecycle_state(s, d):
    return _ntz(L.lifecycle_state(X.send_events(s, d)), "since")


@query(f"WITH {O.SEND_EVENTS} SELECT address, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM send_events WHERE status = 'failed' GROUP BY address")
def failure_event_sync(s, d):
    return _ntz(L.first_failures(X.send_events(s, d)), "ts")


@query(f"WITH {O.SEND_EVENTS}, e AS (SELECT *, lead(ts) OVER (PARTITION BY profile ORDER BY ts, event_id) AS nxt FROM send_events) SELECT event_id, profile, ts FROM e WHERE status = 'attempting' AND coalesce(nxt, TIMESTAMP '2030-01-01') > ts + INTERVAL 5 MINUTE")
def expire_stale_attempts(s, d):
    return _ntz(L.expire_attempts(X.send_events(s, d), F.lit("2030-01-01").cast("timestamp")), "ts")


@query(f"WITH {_LIFE}, m AS (SELECT max(ts) AS now FROM send_events) SELECT profile, since FROM life, m WHERE status = 'sent' AND since < now - INTERVAL {K.PENDING_DAYS} DAY")
def stale_pending(s, d):
    e = X.send_events(s, d)
    now = e.agg(F.max("ts").alias("now"))
    p = L.lifecycle_state(e).where("status = 'sent'").join(F.broadcast(now)).where(F.col("since") < F.col("now") - F.expr(f"INTERVAL {K.PENDING_DAYS} DAYS"))  # one row
    return _ntz(p.select("profile", "since"), "since")


@query(f"WITH {_LIFE} SELECT status, count(*) AS n FROM life GROUP BY status")
def outstanding_count(s, d):
    return L.lifecycle_state(X.send_events(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {O.SEND_EVENTS} SELECT ts::DATE AS day, status, count(*) AS n FROM send_events GROUP BY 1, 2")
def daily_counts(s, d):
    return L.daily_counts(X.send_events(s, d), "UTC")


@query(f"WITH {_DAYS} SELECT day, n, (sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS week FROM days")
def rolling_7d_counts(s, d):
    return L.rolling_week(_days(s, d))


@query(f"WITH {_DAYS} SELECT day, n, row_number() OVER (ORDER BY day) AS campaign_day FROM days")
def campaign_day(s, d):
    return L.campaign_days(_days(s, d))


_RAMP = "CASE " + " ".join(f"WHEN campaign_day <= {t} THEN {min(c, K.DAILY_MAX)}" for t, c in K.RAMP if t) + f" ELSE {K.RAMP[-1][1]} END"
_ROOM = f"{_DAYS}, c AS (SELECT day, n, row_number() OVER (ORDER BY day) AS campaign_day, (sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))::BIGINT AS week FROM days)"


@query(f"WITH {_ROOM} SELECT day, campaign_day, ({_RAMP})::BIGINT AS cap FROM c")
def ramp_cap(s, d):
    return L.campaign_days(_days(s, d)).select("day", "campaign_day", L.ramp_cap(F.col("campaign_day")).alias("cap"))


@query(f"WITH {_ROOM} SELECT day, greatest(0, least({_RAMP} - n % 25, {K.DAILY_MAX} - n % 25, {K.WEEKLY_MAX} - week % 100))::BIGINT AS room FROM c")
def remaining_room(s, d):
    c = L.campaign_days(L.rolling_week(_days(s, d)))
    return c.select("day", L.remaining_room(F.col("n") % 25, F.col("week") % 100, L.ramp_cap(F.col("campaign_day"))).alias("room"))


@query(f"WITH {_LIFE}, t AS (SELECT * FROM life WHERE status IN ('sent', 'accepted', 'dm_sent') ORDER BY since DESC, profile LIMIT {K.SAMPLE_SIZE}) SELECT sample, accepted, CASE WHEN sample >= {K.SAMPLE_SIZE} THEN round(accepted * 100.0 / sample, 4)::DOUBLE END AS rate FROM (SELECT count(*) AS sample, count(*) FILTER (WHERE status = 'accepted') AS accepted FROM t)")
def trailing_rate(s, d):
    r = L.trailing_rate(X.send_events(s, d), K.SAMPLE_SIZE)
    return r.withColumn("rate", F.col("rate").cast("double"))


@query(f"""WITH {O.SEND_EVENTS}, f AS (SELECT *, lag(ts) OVER (PARTITION BY profile ORDER BY ts, event_id) AS before FROM send_events WHERE status = 'failed'),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 48 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY profile ORDER BY ts, event_id) AS island FROM f) SELECT profile, count(*) AS trips, min(ts) AS starts, max(ts) + INTERVAL 48 HOUR AS ends FROM i GROUP BY profile, island""")
def cooldown_intervals(s, d):
    return _ntz(L.cooldowns(X.send_events(s, d)), "starts", "ends")


@query(f"WITH {_LIFE}, {O.PEOPLE} SELECT profile, CASE WHEN degree = 1 THEN 'accepted' ELSE 'expired' END AS status FROM life LEFT JOIN people ON person_id = profile WHERE status = 'sent' AND profile % 3 <> 0")
def reconcile_pending(s, d):
    state = L.lifecycle_state(X.send_events(s, d)).where("status = 'sent'")
    snapshot = state.where("profile % 3 = 0").select("profile")
    return L.reconcile(state, snapshot, X.people(s, d).select(F.col("person_id").alias("profile"), "degree"))


@query(f"WITH {O.SEND_EVENTS}, x AS (SELECT ts::DATE AS day, count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed FROM send_events GROUP BY 1) SELECT day, CASE WHEN dayofweek(day) IN (0, 6) THEN 'not a send day' WHEN sent > failed THEN 'sent' WHEN failed > 0 THEN 'failures' ELSE 'not ok' END AS verdict FROM x")
def heartbeat_check(s, d):
    return L.heartbeat(X.send_events(s, d))


@query(f"WITH {O.SEND_EVENTS} SELECT event_id, ts FROM send_events WHERE dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 1050")
def send_window_filter(s, d):
    return _ntz(X.send_events(s, d).where(L.in_send_window(F.col("ts"), "UTC")).select("event_id", "ts"), "ts")


@query(f"WITH {O.SEND_EVENTS} SELECT count(*) FILTER (WHERE status = 'sent') AS sent, count(*) FILTER (WHERE status = 'failed') AS failed FROM send_events")
def send_outcome_counts(s, d):
    return X.send_events(s, d).agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(f"WITH {O.SEND_EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY address, ts::DATE ORDER BY event_id) AS rn FROM send_events WHERE status = 'sent' AND NOT dry_run) SELECT event_id, address, ts::DATE AS day, message_id FROM p WHERE rn = 1")
def persist_outcomes(s, d):
    return L.persisted(X.send_events(s, d))


@query(f"WITH {_LIFE}, d AS (SELECT profile, row_number() OVER (ORDER BY since, profile) AS rn FROM life WHERE status = 'accepted') SELECT profile, rn FROM d WHERE rn <= 25")
def select_dm_queue(s, d):
    q = L.lifecycle_state(X.send_events(s, d)).where("status = 'accepted'").orderBy("since", "profile").limit(25)
    from pyspark.sql import Window

    return q.select("profile", F.row_number().over(Window.orderBy("since", "profile")).cast("long").alias("rn"))
