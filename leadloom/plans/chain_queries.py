"""Queries over contacts' names, found profiles, search results and the people chain, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions import exprs as E
from leadloom.operators import candidates as C
from leadloom.operators import contacts, drafts, entities, names
from leadloom.operators import people as P
from leadloom.sources import fixtures as X

from . import oracle_parts as O
from . import record_queries as R

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(items, n):
    """Entry n of items, for a number column n from 0."""
    return F.element_at(F.array(*map(F.lit, items)), (n % len(items) + 1).cast("int"))


def _sql_pick(items, n: str) -> str:
    return f"({O.array(items)})[(({n}) % {len(items)}) + 1]"


# ---- contacts -----------------------------------------------------------------
_PARTS = "list_filter(regexp_split_to_array(split_part(e, '@', 1), '[._+-]'), lambda p: p <> '')"
DIRECT = f"""(contains(e, '@') AND split_part(e, '@', 1) <> '' AND contains(split_part(e, '@', -1), '.') AND split_part(e, '@', -1) NOT IN {O.some(K.FREEMAIL)}
  AND NOT (split_part(e, '@', 1) IN {O.some(K.ROLE_MAILBOXES)} OR (len({_PARTS}) BETWEEN 1 AND 3 AND (({_PARTS})[1] IN {O.some(K.ROLE_MAILBOXES)} OR len(list_filter({_PARTS}, lambda p: p NOT IN {O.some(K.ROLE_MAILBOXES)})) = 0))))"""


@query(f"WITH {O.EMAILS} SELECT domain, email, {DIRECT} AS direct FROM (SELECT domain, email, lower(trim(email)) AS e FROM emails)")
def is_direct_mailbox(s, d):
    return contacts.harvest_emails(X.site_pages(s, d)).select("domain", "email", names.is_direct_mailbox(F.col("email")).alias("direct"))


GIVEN = ("jane", "lucy", "maria", "anna", "todd", "howard", "zoe")
FIRST, LAST = ("jane", "lucy", "maria", "anna", "todd", "howard", "budapest", "j"), ("miller", "stone", "van.dijk", "hotel", "info", "o'neil")
TEXTS = ("Owner: Jane has twenty years", "Maria Lopez founded it", "no person here", "Ask for Anna or Todd", "Budapest City centre")
_N = "SELECT c_custkey AS k FROM customer"
_CONTACTS = f"""contacts AS (SELECT k, 'firm' || k % 50 || '.co.uk' AS domain, CASE k % 7 WHEN 0 THEN 'Howard Hotel' WHEN 1 THEN 'Todd Brown Plumbing' ELSE 'Firm ' || k % 50 END AS business,
  CASE k % 6 WHEN 0 THEN f || '.' || l || '@firm' || k % 50 || '.co.uk' WHEN 1 THEN f || '@firm' || k % 50 || '.co.uk' WHEN 2 THEN 'info@firm' || k % 50 || '.co.uk' WHEN 3 THEN f || '.' || l || '@gmail.com' WHEN 4 THEN f || '%40x@firm.co.uk' ELSE upper(f) || '_' || l || '@firm' || k % 50 || '.co.uk' END AS email
  FROM (SELECT k, {_sql_pick(FIRST, 'k // 3')} AS f, {_sql_pick(LAST, 'k // 5')} AS l FROM ({_N})))"""


def _contacts(s, d):
    k = F.col("c_custkey")
    firm = F.concat(F.lit("firm"), (k % 50).cast("string"), F.lit(".co.uk"))
    f, l = _pick(FIRST, F.floor(k / 3)), _pick(LAST, F.floor(k / 5))  # noqa: E741
    at = lambda local: F.concat(local, F.lit("@"), firm)
    two = F.concat(f, F.lit("."), l)
    email = (
        F.when(k % 6 == 0, at(two)).when(k % 6 == 1, at(f)).when(k % 6 == 2, at(F.lit("info"))).when(k % 6 == 3, F.concat(two, F.lit("@gmail.com")))
        .when(k % 6 == 4, F.concat(f, F.lit("%40x@firm.co.uk"))).otherwise(at(F.concat(F.upper(f), F.lit("_"), l)))
    )
    business = F.when(k % 7 == 0, "Howard Hotel").when(k % 7 == 1, "Todd Brown Plumbing").otherwise(F.concat(F.lit("Firm "), (k % 50).cast("string")))
    return X.table(s, d, "customer").select(k.alias("k"), firm.alias("domain"), business.alias("business"), email.alias("email"))


_PAGE_NAMES = f"""on_pages AS (SELECT DISTINCT domain, lower(unnest(list_concat({O.every('t', names.PAIR, 1)}, {O.every('t', names.CUE, 1)}))) AS name
  FROM (SELECT DISTINCT 'firm' || k % 50 || '.co.uk' AS domain, {_sql_pick(TEXTS, 'k % 50')} AS t FROM ({_N})))"""
_WORDS = "list_filter(list_transform(list_filter(regexp_split_to_array(local, '[._+-]'), lambda p: p <> ''), lambda p: regexp_replace(p, '[^a-z]', '', 'g')), lambda p: p <> '')"
_BARRED = O.some([*K.PLACEHOLDER_LOCALS, *K.NAME_PLACEHOLDERS])
_DERIVED = f"""{_CONTACTS}, {_PAGE_NAMES}, c1 AS (SELECT *, lower(trim(email)) AS e, split_part(lower(trim(email)), '@', 1) AS local, split_part(lower(trim(email)), '@', -1) AS host, split_part({O.root('domain')}, '.', 1) AS stem FROM contacts),
  c2 AS (SELECT *, {_WORDS} AS w, len(list_filter(regexp_split_to_array(local, '[._+-]'), lambda p: p <> '')) AS n_raw, list_concat(list_concat(regexp_extract_all(lower(business), '[a-z]{{2,}}'), regexp_extract_all(stem, '[a-z]{{2,}}')), [stem]) AS brand FROM c1
    WHERE len(string_split(e, '@')) = 2 AND local <> '' AND contains(host, '.') AND NOT contains(e, '%') AND length(local) <= 40 AND host NOT IN {O.some(K.FREEMAIL)}
      AND local NOT IN {O.some([*K.ROLE_LOCALS, *K.PLACEHOLDER_LOCALS, *K.NAME_PLACEHOLDERS])} AND NOT {O.like('host', K.PLACEHOLDER_HOST)} AND NOT ({' OR '.join(f"contains(e, {O.q(p)})" for p in K.PLACEHOLDER_PARTS)})),
  c3 AS (SELECT *, list_filter(w, lambda x: x NOT IN {O.some(K.NAME_PARTICLES)}) AS r FROM c2 WHERE len(w) > 0 AND len(list_filter(w, lambda x: length(x) < 2 OR x IN {_BARRED} OR x IN {O.some(K.ROLE_MAILBOXES)})) = 0),
  c4 AS (SELECT *, CASE WHEN n_raw >= 2 AND len(r) >= 2 THEN r[1] WHEN len(w) = 1 THEN w[1] END AS f, CASE WHEN n_raw >= 2 AND len(r) >= 2 THEN r[-1] END AS l FROM c3),
  c5 AS (SELECT c4.*, p.name AS seen FROM c4 LEFT JOIN on_pages p ON p.domain = c4.domain AND p.name = c4.f WHERE f IN {O.some(GIVEN)} AND NOT list_contains(brand, f)),
  derived AS (SELECT k, upper(f[1]) || f[2:] AS first_name, CASE WHEN l IS NULL THEN '' ELSE upper(l[1]) || l[2:] END AS last_name, CASE WHEN l IS NULL THEN 'email_local_first_name_site_confirmed' ELSE 'email_local_first_last' END AS basis
    FROM c5 WHERE l IS NOT NULL OR (seen IS NOT NULL AND length(f) BETWEEN 3 AND 20))"""


def _derived(s, d):
    k = F.col("c_custkey") % 50
    texts = X.table(s, d, "customer").select(F.concat(F.lit("firm"), k.cast("string"), F.lit(".co.uk")).alias("domain"), _pick(TEXTS, k).alias("text")).distinct()
    table = lambda items: s.createDataFrame([(x,) for x in items], "name string")
    return names.derive_names(_contacts(s, d), table(GIVEN), table(K.ROLE_MAILBOXES), names.page_names(texts, "domain"))


@query(f"WITH {_DERIVED} SELECT c.k, c.email, first_name, last_name, basis FROM contacts c LEFT JOIN derived USING (k)")
def derive_name_from_contact(s, d):
    return _derived(s, d).select("k", "email", "first_name", "last_name", "basis")


@query(f"WITH {_DERIVED} SELECT domain, k AS pos, email, first_name, last_name, basis FROM (SELECT c.domain, c.email, d.*, row_number() OVER (PARTITION BY c.domain ORDER BY k) AS rn FROM contacts c JOIN derived d USING (k)) WHERE rn = 1")
def pick_derived_name(s, d):
    return names.pick_derived_name(_derived(s, d).withColumnRenamed("k", "pos"))


_RES = """res AS (SELECT k, 'd' || k || '.firms.net' AS domain, CASE WHEN k % 7 = 3 THEN 'Ferrari Dental Clinic' ELSE 'Firm ' || k END AS name, k % 9 <> 1 AS found, CASE WHEN k % 9 = 2 THEN ' ' ELSE 'Ann' END AS first,
  CASE WHEN k % 7 = 3 THEN 'Ferrari' WHEN k % 3 = 0 THEN '' ELSE 'Stone' END AS last, CASE WHEN k % 4 = 0 THEN 'Mr.' END AS title,
  CASE WHEN k % 8 = 5 THEN 'gm-malta@d' || k || '.firms.net' WHEN k % 8 = 6 THEN 'ann@gmail.com' ELSE 'Ann.Stone@d' || k || '.firms.net' END AS email, CASE WHEN k % 10 IN (4, 5, 6) THEN 'constructed' ELSE 'verbatim' END AS basis,
  CASE WHEN k % 10 = 4 THEN 'https://x' WHEN k % 10 = 5 THEN 'seen somewhere' END AS url, CASE WHEN k % 6 = 2 THEN '(0)20 1234-5678' END AS phone, CASE WHEN k % 5 = 0 THEN 'high' WHEN k % 5 = 1 THEN 'medium' END AS confidence, k % 11 = 0 AS missing
  FROM (SELECT c_custkey AS k FROM customer))"""
_FOUND = f"""{_RES}, g AS (SELECT *, NOT missing AND found AS hit, lower(trim(email)) AS e FROM res),
  g2 AS (SELECT *, CASE WHEN NOT hit THEN 'no_match' WHEN trim(first) = '' AND NOT (trim(last) <> '' AND coalesce(title IN ('Mr.', 'Mrs.'), false)) THEN 'name_or_gender_missing' WHEN trim(last) = 'Ferrari' AND coalesce(confidence, '') <> 'high' THEN 'business_as_surname' END AS ns,
    CASE WHEN NOT {DIRECT} THEN 'no_direct_email' WHEN basis = 'constructed' AND NOT coalesce(starts_with(url, 'https://'), false) AND k % 20 <> 5 THEN 'constructed_no_url_evidence' WHEN k % 13 = 0 THEN 'dead_domain' END AS ms FROM g),
  g3 AS (SELECT *, ns IS NULL AND ms IS NOT NULL AND phone IS NOT NULL AS by_phone FROM g2), g4 AS (SELECT *, coalesce(ns, CASE WHEN NOT by_phone THEN ms END) AS drop_stage FROM g3)"""


@query(f"""WITH {_FOUND} SELECT domain, drop_stage, CASE WHEN drop_stage IS NULL THEN CASE WHEN by_phone THEN 'phone' ELSE 'email' END END AS channel, CASE WHEN drop_stage IS NULL AND NOT by_phone THEN e END AS contact_email,
  CASE WHEN drop_stage IS NULL AND phone IS NOT NULL THEN '+' || regexp_replace(phone, '[^0-9]', '', 'g') END AS contact_phone, CASE WHEN by_phone THEN ms END AS phone_reason,
  CASE WHEN drop_stage IS NULL THEN CASE WHEN basis = 'constructed' AND confidence = 'high' AND NOT by_phone THEN 'medium' ELSE coalesce(confidence, 'low') END END AS contact_confidence FROM g4""")
def gate_found_contacts(s, d):
    k = F.col("k")
    res = X.table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    host = F.concat(F.lit("d"), k.cast("string"), F.lit(".firms.net"))
    res = res.select(
        "k", host.alias("domain"), F.when(k % 7 == 3, "Ferrari Dental Clinic").otherwise(F.concat(F.lit("Firm "), k.cast("string"))).alias("name"), (k % 9 != 1).alias("found"), F.when(k % 9 == 2, " ").otherwise("Ann").alias("first"),
        F.when(k % 7 == 3, "Ferrari").when(k % 3 == 0, "").otherwise("Stone").alias("last"), F.when(k % 4 == 0, "Mr.").alias("title"),
        F.when(k % 8 == 5, F.concat(F.lit("gm-malta@"), host)).when(k % 8 == 6, "ann@gmail.com").otherwise(F.concat(F.lit("Ann.Stone@"), host)).alias("email"), F.when((k % 10).isin(4, 5, 6), "constructed").otherwise("verbatim").alias("basis"),
        F.when(k % 10 == 4, "https://x").when(k % 10 == 5, "seen somewhere").alias("url"), F.when(k % 6 == 2, "(0)20 1234-5678").alias("phone"), F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").alias("confidence"),
    )
    live = res.where(k % 13 != 0).select("domain")
    return names.gate_found_contacts(res.select("domain", "name"), res.where(k % 11 != 0).drop("k", "name"), live.union(s.createDataFrame([("gmail.com",)], "domain string")), res.where(k % 20 == 5).select("domain"))


# ---- search results ----------------------------------------------------------------
@query("""WITH l AS (SELECT k, 'out-' || lpad(k::VARCHAR, 9, '0') AS file, 'L' || k % 100 AS lead_id FROM (SELECT c_custkey AS k FROM customer) WHERE k % 13 <> 0 AND k % 17 <> 0)
  SELECT lead_id, max(file) AS file, arg_max(k % 3 = 0, file) AS found, arg_max('N' || k, file) AS first_name FROM l GROUP BY lead_id""")
def scan_results_json(s, d):
    return entities.scan_results(_result_lines(s, d))[0].select("lead_id", "file", "found", "first_name")


@query("SELECT count(*) FILTER (WHERE c_custkey % 13 = 0) AS bad, count(*) FILTER (WHERE c_custkey % 13 <> 0 AND c_custkey % 17 = 0) AS no_id, count(*) AS n FROM customer")
def scan_results_audit(s, d):
    return entities.scan_results(_result_lines(s, d))[1]


def _result_lines(s, d):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.when(k % 17 != 0, F.concat(F.lit("L"), (k % 100).cast("string"))).alias("lead_id"), (k % 3 == 0).alias("found"), F.concat(F.lit("N"), k.cast("string")).alias("first_name")))
    return X.table(s, d, "customer").select(F.concat(F.lit("out-"), F.lpad(k.cast("string"), 9, "0")).alias("file"), F.when(k % 13 == 0, '{"lead_id": "L1", ').otherwise(body).alias("line"))


_EL = """el AS (SELECT k AS call_id, i AS pos, CASE WHEN (k + i) % 6 = 0 THEN '' ELSE 'Firm ' || k || ' ' || i END AS name,
  CASE WHEN (k + i) % 5 IN (1, 3, 4) THEN 'firm' || k % 200 || '.example' WHEN k % 2 = 0 THEN 'firmc' || k % 100 || '.example' END AS domain FROM (SELECT c_custkey AS k FROM customer), range(0, 4) AS t(i))"""
_OUT = "CASE WHEN name = '' THEN 'no name' WHEN domain IS NULL THEN 'unresolved' WHEN row_number() OVER (PARTITION BY {g}name = '' OR domain IS NULL, domain ORDER BY {o}) > 1 THEN 'repeat' WHEN domain IN (SELECT 'firm' || k || '.example' FROM range(0, 200, 7) AS t(k)) THEN 'seen' ELSE 'linked' END AS outcome"


def _sites(s, d):
    """(k, i, name, website, other) of four results for each call k."""
    k, i = F.col("k"), F.col("i")
    n = X.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    site = F.when(((k + i) % 5).isin(1, 3, 4), text("https://www.Firm", k % 200, ".example/path?x=1")).when((k + i) % 5 == 2, "http://www.booking.com/hotel")
    return n.select("k", "i", F.when((k + i) % 6 == 0, " ").otherwise(text("Firm ", k, " ", i)).alias("name"), site.alias("website"), F.when(k % 2 == 0, text("firmc", k % 100, ".example")).alias("other"))


def _seen(s, d):
    n = X.table(s, d, "customer").select((F.col("c_custkey") % 200).alias("n")).distinct().where("n % 7 = 0")
    return n.select(F.concat(F.lit("firm"), F.col("n").cast("string"), F.lit(".example")).alias("domain"))


@query(f"WITH {_EL} SELECT call_id, pos::INTEGER AS pos, name, domain, {_OUT.format(g='call_id, ', o='pos')} FROM el")
def flatten_map_elements(s, d):
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("website"), F.col("website"), F.lit("contact:website"), F.col("other")), lambda k, v: v.isNotNull())
    one = _sites(s, d).groupBy("k").agg(F.collect_list(F.struct("i", F.to_json(F.struct(F.col("i").cast("long").alias("id"), tags.alias("tags"))).alias("e"))).alias("es"))
    body = F.concat(F.lit('{"elements":['), F.array_join(F.transform(F.array_sort("es"), lambda x: x["e"]), ","), F.lit("]}"))
    return entities.flatten_map_elements(one.select(F.col("k").alias("call_id"), body.alias("body")), _seen(s, d)).select("call_id", "pos", "name", "domain", "outcome")


_PL = f"{_EL}, pl AS (SELECT * FROM (SELECT *, 'P' || (call_id * 3 + pos) AS place_id, row_number() OVER (PARTITION BY call_id * 3 + pos ORDER BY call_id, pos) AS rn FROM (SELECT call_id, pos, name, CASE WHEN (call_id + pos) % 5 IN (1, 3, 4) THEN domain END AS domain FROM el)) WHERE rn = 1)"


@query(f"WITH {_PL} SELECT call_id, pos::INTEGER AS pos, place_id, name, domain, {_OUT.format(g='', o='call_id, pos')} FROM pl")
def flatten_place_results(s, d):
    place = F.struct(F.concat(F.lit("P"), (F.col("k") * 3 + F.col("i")).cast("string")).alias("id"), F.struct(F.col("name").alias("text")).alias("displayName"), F.col("website").alias("websiteUri"))
    one = _sites(s, d).groupBy("k").agg(F.collect_list(F.struct("i", F.to_json(place).alias("e"))).alias("es"))
    body = F.concat(F.lit('{"places":['), F.array_join(F.transform(F.array_sort("es"), lambda x: x["e"]), ","), F.lit("]}"))
    return entities.flatten_place_results(one.select(F.col("k").alias("call_id"), body.alias("body")), _seen(s, d)).select("call_id", "pos", "place_id", "name", "domain", "outcome")


@query("SELECT n_name AS place, substr(n_name, 1, 2) AS country, n_nationkey + 0.5::DOUBLE AS lat, -n_nationkey::DOUBLE AS lon, 0.25::DOUBLE AS half FROM nation")
def load_places(s, d):
    k = F.col("n_nationkey").cast("string")
    line = F.concat(F.lit(" "), "n_name", F.lit("|"), F.lower(F.substring("n_name", 1, 2)), F.lit("|"), k, F.lit(".5|-"), k, F.lit(" | 0.25"))
    n = X.table(s, d, "nation")
    return entities.parse_places(n.select(line.alias("line")).union(n.select(F.concat(F.lit("# "), "n_name"))).union(n.select(F.lit("  "))))


@query(f"WITH {O.CANDIDATES} SELECT country, vertical, seq, domain, rn FROM (SELECT *, row_number() OVER (PARTITION BY country, vertical ORDER BY branches DESC, seq) AS rn FROM candidates) WHERE rn <= 5")
def top_n_per_group(s, d):
    return entities.top_n_per_group(X.candidates(s, d), ["country", "vertical"], [F.desc("branches"), F.col("seq")], 5).select("country", "vertical", "seq", "domain", "rn")


_TOK = f"list_distinct(list_filter(list_transform(regexp_extract_all(name, '[A-Za-z؀-ۿ][A-Za-z0-9؀-ۿ]{{2,}}'), lambda w: lower(w)), lambda w: w NOT IN {O.some(K.IDENTITY_STOP)}))"
_VERIFY = f"""{O.CANDIDATES}, f AS (SELECT domain, min(seq) AS seq FROM candidates GROUP BY domain), h AS (SELECT row_number() OVER (ORDER BY f.seq) AS id, f.domain AS host, f.seq, p.html, c.name FROM f JOIN pages p ON p.page_id = f.seq JOIN candidates c ON c.seq = f.seq),
  v AS (SELECT n.id AS name_id, (x.pos)::INTEGER AS pos, x.host, {_TOK.replace('name', 'n.name')} AS tokens, x.text, x.title FROM h n JOIN (
    SELECT id, id AS name_id, 1 AS pos, host, regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS text, regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1) AS title FROM h
    UNION ALL SELECT id, id + 1, 0, host, regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), regexp_extract(lower(html), '(?s)<title[^>]*>(.*?)</title>', 1) FROM h) x ON x.name_id = n.id),
  w AS (SELECT name_id, pos, host, CASE WHEN regexp_matches(host, 'facebook|org$') THEN 'directory' WHEN len(tokens) < 2 THEN 'generic' WHEN len(list_filter(tokens, lambda t: contains(text, t))) >= 2 AND len(list_filter(tokens, lambda t: contains(title, t) OR contains(host, t))) > 0 THEN 'verified' ELSE 'unproven' END AS verdict FROM v),
  b AS (SELECT *, verdict = 'verified' AND row_number() OVER (PARTITION BY name_id, verdict ORDER BY pos, host) = 1 AS best FROM w)"""


@query(f"WITH {_VERIFY} SELECT name_id, pos, host, verdict, best, best AND name_id = min(name_id) FILTER (WHERE best) OVER (PARTITION BY host) AS kept FROM b")
def verify_entity_page(s, d):
    from pyspark.sql import Window

    c = X.candidates(s, d)
    first = c.groupBy("domain").agg(F.min("seq").alias("seq"))
    # a row for each site: numbers of sites, not of pages, so one window serves the fixture
    h = c.join(first, ["domain", "seq"]).select("seq", "name", F.col("domain").alias("host")).withColumn("name_id", F.row_number().over(Window.orderBy("seq")).cast("long"))
    pages = h.select("host", "seq").join(X.table(s, d, "pages").select(F.col("page_id").alias("seq"), "html"), "seq").select("host", "html")
    hits = h.select("name_id", F.lit(1).alias("pos"), "host").union(h.select(F.col("name_id") + 1, F.lit(0), "host"))
    return entities.verify_entity_pages(h.select("name_id", "name"), pages, hits, directory="facebook|org$")


# ---- people --------------------------------------------------------------------------
_RANKED = f"""{R._SCORED}, ks AS (SELECT person_id, score, headcount, list_distinct(list_filter([{O.KEY('company_domain')}, {O.KEY('company')}, 'c' || company_id % 41], lambda x: x IS NOT NULL)) AS keys FROM scored),
  last_contact AS (SELECT {O.KEY('name')} AS key, DATE '2024-02-01' + (company_id % 40)::INTEGER AS contacted FROM companies WHERE company_id % 3 = 0),
  recent AS (SELECT key FROM last_contact GROUP BY key HAVING DATE '{R.TODAY}' - max(contacted) < 14),
  small AS (SELECT *, coalesce(list_has_any(keys, (SELECT list(key) FROM recent)), false) AS win FROM ks WHERE headcount <= 6),
  turn AS (SELECT person_id, keys, row_number() OVER (ORDER BY score DESC, person_id) AS rn FROM small WHERE NOT win)"""
_LOOP = """loop(i, used, person_id, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT, false UNION ALL
  SELECT rn, CASE WHEN list_has_any(used, keys) THEN used ELSE list_concat(used, keys) END, turn.person_id, NOT list_has_any(used, keys) FROM loop JOIN turn ON rn = i + 1)"""


@query(f"""WITH RECURSIVE {_RANKED}, {_LOOP}, m AS (SELECT ks.person_id, ks.score, CASE WHEN small.win THEN 'window' WHEN l.kept = false THEN 'same firm' END AS why FROM ks LEFT JOIN small USING (person_id) LEFT JOIN loop l ON l.person_id = ks.person_id)
  SELECT person_id, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY why ORDER BY score DESC, person_id) > 200 THEN 'over cap' ELSE why END AS hold FROM m""")
def coordination_hold_keys(s, d):
    ranked = R._scored(s, d).withColumn("keys", F.array_distinct(F.array_append(E.company_keys(F.col("company_domain"), F.col("company")), F.concat(F.lit("c"), (F.col("company_id") % 41).cast("string")))))
    c = X.companies(s, d).where("company_id % 3 = 0")
    last = c.select(E.company_key(F.col("name")).alias("key"), F.date_add(F.lit("2024-02-01").cast("date"), (F.col("company_id") % 40).cast("int")).alias("contacted"))
    return P.coordination_hold_keys(ranked, last, R.TODAY, 200)


@query(f"WITH {O.PEOPLE} SELECT person_id FROM people WHERE coalesce({O.KEY('company_domain')}, '') NOT IN (SELECT {O.KEY('domain')} FROM companies WHERE company_id % 6 = 0) AND coalesce({O.KEY('company')}, '') NOT IN (SELECT {O.KEY('name')} FROM companies WHERE company_id % 6 = 1)")
def block_people(s, d):
    c = X.companies(s, d)
    blocked = P.blocked_keys(c.where("company_id % 6 = 0")).union(c.where("company_id % 6 = 1").select(E.company_key(F.col("name")).alias("key")))
    return P.block_people(X.people(s, d).withColumn("keys", E.company_keys(F.col("company_domain"), F.col("company"))), blocked).select("person_id")


_MSGS = "msgs AS (SELECT doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS pos, CASE doc_id % 4 WHEN 0 THEN 'https://www.linkedin.com/in/p-' || doc_id WHEN 1 THEN 'https://www.linkedin.com/in/p-' || doc_id // 2 END AS url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE trim(text, ' ') END AS message FROM documents)"


@query(f"""WITH {R._ROUTED}, {_MSGS}, g AS (SELECT * FROM msgs WHERE message <> ''), u AS (SELECT url, arg_max(message, file) AS by_url FROM g WHERE url IS NOT NULL GROUP BY url), p AS (SELECT pos, arg_max(message, file) AS by_pos FROM g WHERE pos IS NOT NULL GROUP BY pos)
  SELECT person_id, coalesce(by_url, by_pos) AS message, CASE WHEN by_url IS NOT NULL THEN 'url' WHEN by_pos IS NOT NULL THEN 'position' ELSE 'none' END AS matched_by FROM tiered t LEFT JOIN u ON u.url = t.url LEFT JOIN p ON p.pos = t.person_id""")
def attach_messages_by_url(s, d):
    i = F.col("id")
    url = F.when(i % 4 == 0, F.concat(F.lit("http://LinkedIn.com/in/P-"), i.cast("string"), F.lit("/?x=1"))).when(i % 4 == 1, F.concat(F.lit("uk.linkedin.com/in/p-"), F.floor(i / 2).cast("string"))).otherwise("none given")
    m = X.messages(s, d).select(i.alias("file"), F.when(i % 3 == 0, i).alias("pos"), url.alias("url"), F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("message"))
    p = P.canonical(X.people(s, d)).select("person_id", F.col("person_id").alias("pos"), "url")
    return P.attach_messages(p, m).select("person_id", "message", "matched_by")


_FP = f"""{R._ROUTED}, fp AS (SELECT person_id AS row_id, url, person_id % 7 <> 2 AS found, person_id % 5 <> 1 AS proof, CASE WHEN person_id % 6 <> 1 THEN company END AS co FROM tiered),
  known AS (SELECT {O.KEY('name')} AS key, max(company_id) AS company_id FROM companies GROUP BY 1),
  fq AS (SELECT row_id, url, found, k.company_id, CASE WHEN NOT found THEN 'not found' WHEN url IS NULL THEN 'bad url' WHEN NOT proof THEN 'no evidence' WHEN k.company_id IS NULL THEN 'unknown company' END AS bad FROM fp LEFT JOIN known k ON k.key = {O.KEY('co')})"""


@query(f"WITH {_FP} SELECT row_id, url, company_id, CASE WHEN found AND row_id > min(row_id) FILTER (WHERE bad IS NULL) OVER (PARTITION BY url) THEN 'repeat' ELSE bad END AS reason FROM fq")
def found_profiles(s, d):
    k = F.col("person_id")
    f = X.people(s, d).select(k.alias("row_id"), (k % 7 != 2).alias("found"), "profile_url", F.when(k % 5 != 1, "https://x").otherwise(" ").alias("evidence_url"), F.when(k % 6 != 1, F.upper("company")).alias("company"))
    return P.found_profiles(f, X.companies(s, d)).select("row_id", "url", "company_id", "reason")


# ---- candidates and sends ----------------------------------------------------------------
@query(f"""WITH {R._MERGED}, n AS (SELECT count(*) FILTER (WHERE drop_reason IS NULL) AS kept, count(*) FILTER (WHERE drop_reason = 'country') AS country, count(*) FILTER (WHERE drop_reason IN ('sent', 'disqualified', 'sourced')) AS stale FROM merged)
  SELECT kept, country, stale, country > 0.3 * (kept + country) AS country_warning, stale > 0.5 * (kept + stale) AS stale_warning FROM n""")
def merge_warnings(s, d):
    return C.merge_warnings(R._merged(s, d))


_SOURCED = R._MERGED.replace("THEN 'disqualified' END AS bad", "THEN 'disqualified' WHEN domain IN (SELECT domain FROM candidates WHERE seq % 9 = 4) THEN 'sourced' END AS bad")


@query(f"WITH {_SOURCED} SELECT seq, domain, drop_reason FROM merged")
def merge_candidates_sourced(s, d):
    led, c = X.ledger_lines(s, d), X.candidates(s, d)
    slugs = led.where("kind = 'slug'").select(F.replace("domain", F.lit("."), F.lit("-")).alias("slug"))
    return C.merge_candidates(c, X.ALLOWED, led.where("kind = 'email'"), slugs, led.where("kind = 'disqualified'"), c.where("seq % 9 = 4")).select("seq", "domain", "drop_reason")


@query(f"""WITH {O.CANDIDATES}, a AS (SELECT seq, domain, 'info@' || domain AS address FROM candidates WHERE domain NOT IN (SELECT domain FROM candidates WHERE seq % 23 = 5)), f AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY seq) AS nth FROM a),
  o AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM f WHERE nth = 1) SELECT seq, address, ((rn - 1) // 10)::BIGINT AS batch_index FROM o WHERE rn <= 35""")
def plan_sends(s, d):
    c = X.candidates(s, d).withColumn("address", F.concat(F.lit("info@"), "domain"))
    blocked = c.where("seq % 23 = 5").select(F.lit("domain").alias("key_type"), F.col("domain").alias("key_value")).distinct()
    return drafts.plan_sends(c, {"domain": "domain", "address": "email"}, blocked, "seq", "address", 35, 10).select("seq", "address", "batch_index")


@query(f"""WITH {O.LEADS}, k AS (SELECT seq, name, domain, country, vertical, {O.KEY('name')} AS key FROM leads WHERE coalesce(trim(name), '') <> '') SELECT name, domain, country, vertical FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM k WHERE key IS NOT NULL) WHERE rn = 1""")
def companies_of_leads(s, d):
    from . import site_queries

    leads = site_queries._leads(s, d).select("seq", "name", "domain", "country", "vertical", E.company_key(F.col("name")).alias("key")).where("coalesce(trim(name), '') <> '' and key is not null")
    return entities.top_n_per_group(leads, ["key"], [F.col("seq")], 1).select("name", "domain", "country", "vertical")


# ---- canonical forms -----------------------------------------------------------------------
_V = "v AS (SELECT c_custkey AS k, c_custkey % 9 + 1 AS n, c_name FROM customer)"
_SHORT = "trim(regexp_replace(trim(regexp_replace(s, '\\s+[-–—|]\\s.*$', '')), '(?i)[\\s,]+(llc|fze|co|group)\\.?$', ''))"


@query(f"""WITH {_V}, t AS (SELECT *, CASE k % 3 WHEN 0 THEN 'About ' || n || ',0' || n || '0-9,999 employees' WHEN 1 THEN n || ' to 50 Employees' ELSE 'no staff' END AS staff, CASE k % 3 WHEN 0 THEN '· ' || n % 3 + 1 || CASE n % 3 WHEN 0 THEN 'st' WHEN 1 THEN 'nd' ELSE 'rd' END || ' degree' WHEN 1 THEN 'x2ndy' ELSE '4th' END AS deg,
    'Firm ' || c_name || CASE k % 3 WHEN 0 THEN ' Group' WHEN 1 THEN ' - best in town' ELSE ', a very long name that goes on and on' END AS s FROM v)
  SELECT k, CASE k % 3 WHEN 0 THEN n * 1000 + n * 10 WHEN 1 THEN n END AS staff, CASE k % 3 WHEN 0 THEN n % 3 + 1 END AS deg, CASE WHEN k % 2 = 0 THEN n * 1000 + n END AS mutual, k % 4 <> 3 AS named,
    CASE k % 3 WHEN 0 THEN 'the UK' WHEN 1 THEN 'Spain' ELSE 'XX' END AS country, 'lb-tpa-' || n || 'x' AS base, CASE k % 5 WHEN 0 THEN n * 30 WHEN 1 THEN n * 7 WHEN 2 THEN 0 WHEN 3 THEN n * 365 END AS age,
    CASE WHEN length({_SHORT}) <= 40 THEN {_SHORT} ELSE regexp_replace(left({_SHORT}, 41), '\\s+\\S*$', '') END AS short, CASE k % 3 WHEN 0 THEN 'firm' || n || '.com' END AS site, CASE WHEN k % 2 = 0 THEN '4420' || 1000000 + k ELSE '4420' || 2000000 + k END AS phone FROM t""")
def canonical_values(s, d):
    k = F.col("k")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    v = X.table(s, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 9 + 1).alias("n"), "c_name")
    n = F.col("n")
    staff = F.when(k % 3 == 0, t("About ", n, ",0", n, "0-9,999 employees")).when(k % 3 == 1, t(n, " to 50 Employees")).otherwise("no staff")
    deg = F.when(k % 3 == 0, t("· ", n % 3 + 1, F.when(n % 3 == 0, "st").when(n % 3 == 1, "nd").otherwise("rd"), " degree")).when(k % 3 == 1, "x2ndy").otherwise("4th")
    mutual = F.when(k % 2 == 0, t(n, ",00", n, " other mutual connections")).otherwise("none")
    label = F.when(k % 4 == 0, "Invite José O'Brien-Núñez to connect").when(k % 4 == 1, "jose x obrien NUNEZ").when(k % 4 == 2, "Núñez José OBrien jr").otherwise("Invite Jose Brien")
    age = F.when(k % 5 == 0, t(n, "mo")).when(k % 5 == 1, t(n, " w ago")).when(k % 5 == 2, t(n, "h")).when(k % 5 == 3, t(n, "yr")).otherwise("lately")
    name = F.concat(F.lit("Firm "), "c_name", F.when(k % 3 == 0, " Group").when(k % 3 == 1, " - best in town").otherwise(", a very long name that goes on and on"))
    site = F.when(k % 3 == 0, t("https://www.Firm", n, ".com/x?y")).when(k % 3 == 1, "www.facebook.com/firm").otherwise("no site")
    phone = F.when(k % 2 == 0, t("+44 (20) ", k + 1000000)).otherwise(t("020 ", k + 2000000))
    return v.select(
        "k", E.headcount(staff).alias("staff"), E.degree(deg).alias("deg"), E.mutual_count(mutual).alias("mutual"), E.names_person(label, F.lit("José O’Brien Nuñez B")).alias("named"),
        E.country_name(F.when(k % 3 == 0, "gb").when(k % 3 == 1, "ES").otherwise("XX")).alias("country"), E.run_base(t("2026-07-27-lb-tpa-", n, "x-", n)).alias("base"), E.age_days(age).cast("long").alias("age"),
        E.short_name(name).alias("short"), E.usable_domain(site).alias("site"), E.phone_digits(phone, F.lit("44")).alias("phone"),
    )


# ---- scores and drafts ---------------------------------------------------------------------
_HOOKS = f"""{R._ROUTED}, h AS (SELECT person_id, mutuals, CASE WHEN person_id % 4 = 1 THEN 'The Harbour School of Trade' END AS school, CASE WHEN person_id % 5 = 2 THEN 'new site' WHEN person_id % 5 = 3 THEN '' END AS news, person_id % 6 = 4 AS posts FROM tiered)"""


@query(f"""WITH {_HOOKS} SELECT person_id, CASE WHEN school IS NOT NULL THEN 2.0 ELSE 0 END::DOUBLE + CASE WHEN mutuals >= 3 THEN 1 ELSE 0 END + CASE WHEN posts THEN 1 ELSE 0 END + CASE WHEN news <> '' THEN 1.5 ELSE 0 END::DOUBLE AS hook_score,
  array_to_string(list_filter([CASE WHEN school IS NOT NULL THEN 'shared-school' END, CASE WHEN mutuals >= 3 THEN 'mutuals' END, CASE WHEN posts THEN 'recent-post' END, CASE WHEN news <> '' THEN 'timing:' || news END], lambda x: x IS NOT NULL), ',') AS hooks FROM h""")
def score_people_hooks(s, d):
    k = F.col("person_id")
    p = X.people(s, d).withColumns({
        "school": F.when(k % 4 == 1, "The Harbour School of Trade"), "company_signal": F.when(k % 5 == 2, "new site").when(k % 5 == 3, ""), "recent_posts": F.when(k % 6 == 4, F.array(F.lit("post"))).otherwise(F.array().cast("array<string>")),
    })
    return P.score_hooks(p, ["harbour school"]).select("person_id", "hook_score", F.array_join("hooks", ",").alias("hooks"))


_DRAFT = f"""{O.LEADS}, dr AS (SELECT seq, domain, name, 'x.' || vertical || '@' || domain AS address, 'Ms. ' || country AS salutation, CASE WHEN seq % 4 = 0 THEN 'AI for ' || name ELSE 'A word on ai' END AS subject,
  CASE WHEN seq % 5 = 1 THEN 'Hi' ELSE 'Hello' END || ' Ms. ' || country || ', a word' || chr(10) || chr(10) || CASE WHEN seq % 6 = 2 THEN 'It is free of Charge' ELSE 'It is' END || ' https://' || CASE WHEN seq % 7 = 3 THEN '' ELSE domain END || CASE WHEN seq % 3 = 0 THEN ' by acme' ELSE '' END || CASE WHEN seq % 2 = 0 THEN chr(10) || 'Sent by us' ELSE '' END AS body FROM leads),
  dg AS (SELECT *, lower(address) AS e, CASE WHEN seq % 2 = 0 THEN body ELSE body || chr(10) || 'Sent by us' END AS signed FROM dr)"""


@query(f"""WITH {_DRAFT} SELECT seq, CASE WHEN NOT {DIRECT} THEN 'no_direct_email' WHEN seq % 5 = 1 THEN 'salutation' WHEN {O.like('lower(body)', K.MONEY)} OR {O.like('lower(subject)', K.MONEY)} THEN 'money' WHEN seq % 7 = 3 THEN 'no_link' WHEN seq % 3 = 0 THEN 'banned' END AS drop_reason,
  trim(regexp_replace(trim(subject), '(?i)(^|[^A-Za-z0-9_])ai($|[^A-Za-z0-9_])', '\\1the\\2', 'g')) AS subject, '<p>' || array_to_string(list_transform(string_split(signed, chr(10) || chr(10)), lambda p: replace(p, chr(10), '<br>')), '</p>' || chr(10) || '<p>') || '</p>' AS html FROM dg""")
def draft_contract(s, d):
    from . import site_queries

    n = F.col("seq")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    lead = site_queries._leads(s, d).select("seq", "domain", t("x.", F.col("vertical"), "@", F.col("domain")).alias("address"), t("Ms. ", F.col("country")).alias("salutation"), "name")
    body = t(
        F.when(n % 5 == 1, "Hi").otherwise("Hello"), " ", F.col("salutation"), ", a word\n\n", F.when(n % 6 == 2, "It is free of Charge").otherwise("It is"), " https://", F.when(n % 7 == 3, "").otherwise(F.col("domain")),
        F.when(n % 3 == 0, " by acme").otherwise(""), F.when(n % 2 == 0, "\nSent by us").otherwise(""),
    )
    return drafts.draft_contract(lead.withColumns({"subject": F.when(n % 4 == 0, t("AI for ", F.col("name"))).otherwise("A word on ai"), "body": body}), "domain", "acme", "Sent by us").select("seq", "drop_reason", "subject", "html")
