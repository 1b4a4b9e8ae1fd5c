"""People: routes, scores, small-firm holds, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K
from leadloom.functions.exprs import company_key, profile_url

from .neardup import settled


def title_tier(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier, p in reversed(list(K.TITLE_TIERS.items())):
        out = F.when(F.lower(title).rlike(p), tier).otherwise(out)
    return out


def reach_mode() -> Column:
    return F.when(F.col("degree") == 1, "direct").when(F.col("open_profile"), "open profile").when(F.col("degree").isin(2, 3), "invite")


def qualify_people(people: DataFrame, accept=("T1", "T2"), countries=(), alive_days: int = 90, cities=()) -> DataFrame:
    """people with title_tier, reach_mode, alive, route (linkedin, email or drop) and reason.

    The headline stands in for a blank title where there is such a column. Countries and cities are those of the
    company; who has neither is dropped where either is asked for, and one of them is enough.
    """
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("headline")) if "headline" in people.columns else F.col("title")
    p = people.withColumns({"title_tier": title_tier(title), "reach_mode": reach_mode(), "alive": F.coalesce(F.col("last_activity_days") <= alive_days, F.lit(False))})
    bad_tier = ~F.coalesce(F.col("title_tier").isin(*accept), F.lit(False))
    reason = F.when(bad_tier, F.concat(F.lit("title: tier "), F.coalesce("title_tier", F.lit("none"))))
    if countries or cities:
        city = F.col("company_city") if "company_city" in people.columns else F.lit(None).cast("string")
        inside = F.coalesce(F.col("company_country").isin(*countries), F.lit(False)) | F.coalesce(F.lower(city).isin(*[c.lower() for c in cities]), F.lit(False))
        reason = reason.when(F.col("company_country").isNull() & city.isNull(), "geo: no company location").when(~inside, F.concat(F.lit("geo: company in "), F.coalesce("company_country", city)))
    p = p.withColumn("drop", reason)
    route = F.when(F.col("drop").isNotNull(), "drop").when(F.col("alive") & F.col("reach_mode").isNotNull(), "linkedin").otherwise("email")
    why = F.coalesce(F.col("drop"), F.when(~F.col("alive"), "dormant").when(F.col("reach_mode").isNull(), "unreachable"))
    return p.withColumns({"route": route, "reason": why}).drop("drop")


def score_people(people: DataFrame, alive_days: int = 90) -> DataFrame:
    """people with score: tier, how lately active, reach, mutual contacts; a sum of halves."""
    tier = F.when(F.col("title_tier") == "T1", 3).when(F.col("title_tier") == "T2", 2).otherwise(1)
    d = F.col("last_activity_days")
    alive = F.when(d <= 14, 3).when(d <= 30, 2).when(d <= alive_days, 1).otherwise(0)
    reach = F.when(F.col("reach_mode") == "direct", 3.0).when(F.col("reach_mode") == "open profile", 2.0).when(F.col("reach_mode") == "invite", 1.5).otherwise(1.0)
    return people.withColumn("score", tier + alive + reach + F.when(F.col("mutuals") >= 3, 1.0).otherwise(0.0))


def score_hooks(people: DataFrame, schools=()) -> DataFrame:
    """people with hook_score and hooks: a shared school 2, three mutual contacts 1, a recent post 1, news of the company 1.5.

    people: school, mutuals, recent_posts (array), company_signal; a column that is missing gives no hook.
    """
    has = lambda c, test: F.coalesce(test(F.col(c)), F.lit(False)) if c in people.columns else F.lit(False)
    school = F.lit(False)
    for x in schools:
        school = school | has("school", lambda c, x=x: F.contains(F.lower(c), F.lit(x.lower())))
    news = has("company_signal", lambda c: c != "")
    tests = [(school, 2.0, F.lit("shared-school")), (has("mutuals", lambda c: c >= 3), 1.0, F.lit("mutuals")), (has("recent_posts", lambda c: F.size(c) > 0), 1.0, F.lit("recent-post"))]
    tests.append((news, 1.5, F.concat(F.lit("timing:"), F.col("company_signal")) if "company_signal" in people.columns else F.lit("timing")))
    total = F.lit(0.0)
    for test, points, _ in tests:
        total = total + F.when(test, points).otherwise(0.0)
    return people.withColumns({"hook_score": total, "hooks": F.array_compact(F.array(*[F.when(test, name) for test, _, name in tests]))})


def canonical(people: DataFrame) -> DataFrame:
    return people.withColumn("url", profile_url(F.col("profile_url")))


def union_first_wins(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both; of one key, the first table's row, then the smallest by order. key must not be null."""
    both = first.withColumn("__prio", F.lit(0)).unionByName(second.withColumn("__prio", F.lit(1))).where(F.col(key).isNotNull())
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("__prio", order))).where("__rn = 1").drop("__rn", "__prio")


def coverage_gap(companies: DataFrame, people: DataFrame, cap: int) -> DataFrame:
    """The first cap companies, by company_id, that no person is of."""
    held = people.select(company_key(F.col("company")).alias("key")).where("key is not null").distinct()
    gap = companies.withColumn("key", company_key(F.col("name"))).join(held, "key", "left_anti")
    return gap.orderBy("company_id").limit(cap).drop("key")


def coordination_hold(ranked: DataFrame, last_contact: DataFrame, today, window_days: int = 14, small: int = 6) -> DataFrame:
    """ranked (person_id, score, keys, headcount) with hold: window, same firm or null; see coordination_hold_keys."""
    return ranked.join(coordination_hold_keys(ranked, last_contact, today, None, window_days, small), "person_id")


def coordination_hold_exact(ranked: DataFrame, small: int = 6) -> DataFrame:
    """(person_id) kept in the run where people may answer to several keys."""
    ident = F.struct((-F.col("score")).alias("order"), F.col("person_id").alias("person_id")).alias("id")
    keys = ranked.where(F.coalesce(F.col("headcount") <= small, F.lit(False))).select(ident, F.explode("keys").alias("key"))
    return first_per_keys(keys).select("id.person_id")


def blocked_keys(domains: DataFrame) -> DataFrame:
    return domains.select(company_key(F.col("domain")).alias("key")).where("key is not null").distinct()


def select_queue(people: DataFrame, suppressed: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """people (person_id, url, degree, message, score) with reason: bad url, duplicate, suppressed, in state, reachable, no message, over cap or null."""
    p = people.join(suppressed.select(F.col("url").alias("s_url")).distinct(), F.col("url") == F.col("s_url"), "left")
    p = p.join(state.select(F.col("url").alias("t_url")).distinct(), F.col("url") == F.col("t_url"), "left")
    first = people.where("url is not null").groupBy(F.col("url").alias("f_url")).agg(F.min("person_id").alias("first_id"))
    p = p.join(first, F.col("url") == F.col("f_url"), "left")
    reason = (
        F.when(F.col("url").isNull(), "bad url").when(F.col("person_id") > F.col("first_id"), "duplicate").when(F.col("s_url").isNotNull(), "suppressed").when(F.col("t_url").isNotNull(), "in state")
        .when(F.col("degree") == 1, "reachable").when(F.coalesce("message", F.lit("")) == "", "no message")
    )
    p = p.withColumn("reason", reason).drop("s_url", "t_url", "f_url", "first_id")
    chosen = p.where("reason is null").orderBy(F.desc("score"), "person_id").limit(cap).select("person_id").withColumn("in_queue", F.lit(True))
    return p.join(chosen, "person_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("in_queue").isNull(), "over cap").otherwise(F.col("reason"))).drop("in_queue")


def suppress_profiles(leads: DataFrame, keys: DataFrame) -> DataFrame:
    """leads (lead_id, url, email and more) with suppressed: profile if its URL is among keys (key_type, key_value), else email, else null.

    URLs are compared in canonical form, addresses in lower case; a lead's keys become rows of one equi-join.
    """
    mine = F.array(F.struct(F.lit("profile").alias("key_type"), profile_url(F.col("url")).alias("key_value")), F.struct(F.lit("email").alias("key_type"), F.lower(F.trim("email")).alias("key_value")))
    long = leads.select("lead_id", F.explode(mine).alias("k")).select("lead_id", "k.*").where("key_value <> ''")
    hit = long.join(keys.select("key_type", "key_value").distinct(), ["key_type", "key_value"]).groupBy("lead_id").agg(F.max("key_type").alias("suppressed"))  # profile is the greater
    return leads.join(hit, "lead_id", "left")


def first_per_keys(rows: DataFrame) -> DataFrame:
    """(id) kept when ids are taken by rising id and one is held if it shares a key with one kept before. rows: id, key.

    Each round keeps who comes first for all of its keys and holds who shares a key with it, so a firm's rows are
    grouped and never paired; the result is that of the sequential loop.
    """
    left, kept = settled(rows.select("id", "key").distinct(), "first"), None
    while not left.isEmpty():
        firsts = left.groupBy("key").agg(F.min("id").alias("first"))
        ahead = left.join(firsts, "key").groupBy("id").agg(F.min((F.col("id") == F.col("first")).cast("int")).alias("all")).where(F.col("all") == 1).select("id")
        now = settled(ahead, "first")
        taken = left.join(now, "id", "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select("id").distinct()
        kept = now if kept is None else kept.union(now)
        left = settled(left.join(gone, "id", "left_anti"), "first")
    return kept if kept is not None else rows.select("id").distinct()


def coordination_hold_keys(ranked: DataFrame, last_contact: DataFrame, today, budget: int | None = None, window_days: int = 14, small: int = 6) -> DataFrame:
    """(person_id, hold) of ranked (person_id, score, keys, headcount): window, same firm, over cap or null.

    A firm answers to several keys. Of a small firm nobody is asked within window_days of the last contact with any of
    its keys, and in a run only who shares no key with someone asked before, by score and person_id; who the window
    holds blocks nobody. The cap comes last, in the same order.
    """
    ident = F.struct((-F.col("score")).alias("order"), F.col("person_id").alias("person_id"))
    small_firms = F.coalesce(F.col("headcount") <= small, F.lit(False))
    keys = ranked.where(small_firms).select(ident.alias("id"), F.explode("keys").alias("key"))
    recent = last_contact.groupBy("key").agg(F.max("contacted").alias("contacted")).where(F.datediff(F.lit(today).cast("date"), "contacted") < window_days)
    held = settled(keys.join(recent, "key", "left_semi").select("id").distinct(), "window")
    open_ = keys.join(held, "id", "left_anti")
    kept = first_per_keys(open_)
    firm = open_.select("id").distinct().join(kept, "id", "left_anti")
    marks = held.select("id.person_id", F.lit("window").alias("why")).union(firm.select("id.person_id", F.lit("same firm")))
    out = settled(ranked.join(marks, "person_id", "left").select("person_id", "score", "why"), "hold")
    if budget is None:
        return out.select("person_id", F.col("why").alias("hold"))
    chosen = out.where("why is null").orderBy(F.desc("score"), "person_id").limit(budget).select("person_id", F.lit(True).alias("chosen"))
    return out.join(chosen, "person_id", "left").select("person_id", F.coalesce("why", F.when(F.col("chosen").isNull(), "over cap")).alias("hold"))


def block_people(people: DataFrame, blocked: DataFrame) -> DataFrame:
    """people none of whose keys is blocked. blocked: key."""
    hit = people.select("person_id", F.explode("keys").alias("key")).join(blocked.select("key").distinct(), "key", "left_semi").select("person_id").distinct()
    return people.join(hit, "person_id", "left_anti")


def attach_messages(people: DataFrame, messages: DataFrame) -> DataFrame:
    """people (person_id, pos, url) with message and matched_by: url, position or none.

    messages: file, pos, url, message. Of one URL the last file's message counts; blank messages count for nothing. A
    person whose URL meets none takes the message of its own position.
    """
    good = messages.where(F.trim(F.coalesce("message", F.lit(""))) != "").withColumn("message", F.trim("message"))
    by_url = good.withColumn("m_url", profile_url(F.col("url"))).where("m_url is not null").groupBy("m_url").agg(F.max_by("message", "file").alias("by_url"))
    by_pos = good.where("pos is not null").groupBy(F.col("pos").alias("m_pos")).agg(F.max_by("message", "file").alias("by_pos"))
    p = people.join(by_url, F.col("url") == F.col("m_url"), "left").join(by_pos, F.col("pos") == F.col("m_pos"), "left")
    how = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_pos").isNotNull(), "position").otherwise("none")
    return p.select(*people.columns, F.coalesce("by_url", "by_pos").alias("message"), how.alias("matched_by"))


def found_profiles(found: DataFrame, companies: DataFrame) -> DataFrame:
    """found (row_id, found, profile_url, evidence_url, company) with url, company_id and reason: not found, bad url, repeat, no evidence, unknown company or null.

    A URL is claimed by its first row, by row_id, that passes all else. companies: company_id, name.
    """
    f = found.withColumns({"url": profile_url(F.col("profile_url")), "key": company_key(F.col("company"))})
    known = companies.select(company_key(F.col("name")).alias("key"), "company_id").where("key is not null").groupBy("key").agg(F.max("company_id").alias("company_id"))
    f = f.join(known, "key", "left")
    bad = F.when(~F.coalesce("found", F.lit(False)), "not found").when(F.col("url").isNull(), "bad url").when(F.coalesce(F.trim("evidence_url"), F.lit("")) == "", "no evidence").when(F.col("company_id").isNull(), "unknown company")
    f = f.withColumn("bad", bad)
    firsts = f.where("bad is null").groupBy("url").agg(F.min("row_id").alias("first_row")).select(F.col("url").alias("f_url"), "first_row")
    f = f.join(firsts, F.col("url") == F.col("f_url"), "left")
    repeat = F.coalesce(F.col("row_id") > F.col("first_row"), F.lit(False)) & F.coalesce("found", F.lit(False))
    return f.select("row_id", "url", "company_id", F.when(repeat, "repeat").otherwise(F.col("bad")).alias("reason"))


def select_messages(leads: DataFrame, states: DataFrame, suppressed: DataFrame, cap: int, most: int = 1000) -> DataFrame:
    """(lead_id, profile, verdict, via, rn) of leads (lead_id, url, score, open_profile, message).

    verdict is the first rule that rejects, or null; a profile's leads behind its first good one (by lead_id) are
    duplicates. states (profile, accepted, messaged, closed) and suppressed (profile) have canonical URLs, a row for each.
    Good leads go by score, then lead_id: rn is set for the first cap of them, and the others are over cap.
    """
    x = leads.withColumn("profile", profile_url(F.col("url"))).join(states, "profile", "left").join(suppressed.select("profile", F.lit(True).alias("barred")), "profile", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = F.trim(F.coalesce("message", F.lit("")))
    rules = (("no profile", F.col("profile").isNull()), ("suppressed", yes("barred")), ("already messaged", yes("messaged")), ("not messageable", yes("closed")),
             ("no consent", ~yes("accepted") & ~yes("open_profile")), ("empty message", text == ""), ("long message", F.char_length(text) > most))
    x = x.withColumn("verdict", F.coalesce(*[F.when(test, name) for name, test in rules]))
    first = F.min(F.when(F.col("verdict").isNull(), F.col("lead_id"))).over(Window.partitionBy(F.coalesce("profile", F.col("lead_id").cast("string"))))
    x = x.withColumn("verdict", F.when(F.col("profile").isNotNull() & (F.col("lead_id") > first), "duplicate").otherwise(F.col("verdict")))
    x = x.select("lead_id", "profile", "score", "verdict", F.when(yes("accepted"), "accepted").when(yes("open_profile"), "open profile").alias("via"))
    top = x.where("verdict is null").orderBy(F.desc("score"), "lead_id").limit(cap)
    top = top.select("lead_id", F.row_number().over(Window.orderBy(F.desc("score"), "lead_id")).cast("long").alias("rn"))  # cap rows
    x = x.join(F.broadcast(top), "lead_id", "left")
    verdict = F.coalesce("verdict", F.when(F.col("rn").isNull(), "over cap"))
    return x.select("lead_id", "profile", verdict.alias("verdict"), F.when(verdict.isNull(), F.col("via")).alias("via"), "rn")
