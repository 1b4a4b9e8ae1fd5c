"""Delivery events: states, windows, limits, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K

from .people import first_per_keys

STAGE = {"attempting": 0, "failed": 0, "sent": 1, "dm_sent": 2, "accepted": 3}


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def furthest_events(events: DataFrame) -> DataFrame:
    """(profile, status, ts, event_id, n_events): each profile's event of the furthest status, the first such; no event moves it back."""
    stage = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STAGE.items()])
    e = events.select("profile", "ts", "event_id", "status", stage.alias("stage"))
    best = F.max(F.struct("stage", -F.unix_micros("ts"), -F.col("event_id"), "status", "ts", "event_id"))
    return e.groupBy("profile").agg(best.alias("b"), F.count("*").alias("n_events")).select("profile", "b.status", "b.ts", "b.event_id", "n_events")


def lifecycle_state(events: DataFrame) -> DataFrame:
    """(profile, status, since, n_events): the furthest status a profile has reached, and when first."""
    return furthest_events(events).select("profile", "status", F.col("ts").alias("since"), "n_events")


def expire_attempts(events: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Attempts with nothing else of the profile within minutes after, by now: they are unknown and to be looked at."""
    nxt = F.lead("ts").over(Window.partitionBy("profile").orderBy("ts", "event_id"))
    e = events.withColumn("next_ts", nxt).where("status = 'attempting'")
    late = F.coalesce("next_ts", now) > F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    return e.where(late).select("event_id", "profile", "ts")


def daily_counts(events: DataFrame, zone: str) -> DataFrame:
    """(day, status, n) by local date."""
    return events.groupBy(local_date(F.col("ts"), zone).alias("day"), "status").agg(F.count("*").alias("n"))


def rolling_week(daily: DataFrame) -> DataFrame:
    """(day, n, week): sends of the day, and of it and the six local dates before. daily: one row for each day."""
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.withColumn("week", F.sum("n").over(w))


def campaign_days(daily: DataFrame) -> DataFrame:
    """daily with campaign_day: how many days with sends there were, this one included."""
    return daily.where("n > 0").withColumn("campaign_day", F.row_number().over(Window.orderBy("day")).cast("long"))


def campaign_day_on(daily: DataFrame, today) -> DataFrame:
    """(campaign_day) of one row: how many days with sends there were by today, which counts even without any."""
    n = daily.where(F.col("n") > 0).where(F.col("day") <= F.lit(today).cast("date"))
    return n.agg((F.count_if(F.col("day") < F.lit(today).cast("date")) + 1).alias("campaign_day"))


def ramp_cap(day: Column, ramp=K.RAMP, most: int = K.DAILY_MAX) -> Column:
    out = F.lit(0)
    for through, cap in reversed(ramp):
        hit = F.lit(True) if through is None else day <= through
        out = F.when(hit, F.least(F.lit(cap), F.lit(most))).otherwise(out)
    return out.cast("long")


def remaining_room(today: Column, week: Column, cap: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(cap - today, K.DAILY_MAX - today, K.WEEKLY_MAX - week))


def trailing_rate(events: DataFrame, n: int) -> DataFrame:
    """(sample, accepted, rate) of the last n profiles' states by first send; the rate is null for fewer than n."""
    s = lifecycle_state(events).where("status in ('sent', 'accepted', 'dm_sent')").orderBy(F.desc("since"), "profile").limit(n)
    a = s.agg(F.count("*").alias("sample"), F.count_if(F.col("status") == "accepted").alias("accepted"))
    return a.select("sample", "accepted", F.when(F.col("sample") >= n, F.round(F.col("accepted") * 100.0 / F.col("sample"), 4)).alias("rate"))


def rolling_rates(sends: DataFrame, n: int) -> DataFrame:
    """(address, event_id, at, accepted, rate) of each sender's sends in the order of ts and event_id, at from 1: the share accepted of the last n, null before the n-th.

    sends: address, event_id, ts, accepted (boolean). Sums are built up from the days' own, so a task sees one sender's day
    and never a sender's whole past; the sum of the last n is the difference of two running sums, joined by place.
    """
    s = sends.withColumn("day", F.to_date("ts"))
    days = s.groupBy("address", "day").agg(F.count("*").alias("n"), F.count_if("accepted").alias("a"))
    past = Window.partitionBy("address").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("address", "day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("a").over(past), F.lit(0)).alias("a0"))
    own = Window.partitionBy("address", "day").orderBy("ts", "event_id")
    s = s.withColumns({"i": F.row_number().over(own), "a": F.sum(F.col("accepted").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    s = s.join(days, ["address", "day"]).select("address", "event_id", "accepted", (F.col("n0") + F.col("i")).alias("at"), (F.col("a0") + F.col("a")).alias("sum"))
    before = s.select("address", (F.col("at") + n).alias("at"), F.col("sum").alias("out"))
    last = s.join(before, ["address", "at"], "left")
    rate = F.when(F.col("at") >= n, F.round((F.col("sum") - F.coalesce("out", F.lit(0))) * 100.0 / n, 4))
    return last.select("address", "event_id", "at", "accepted", rate.alias("rate"))


def cooldowns(events: DataFrame, hours: int = 48) -> DataFrame:
    """(profile, trips, starts, ends): failures block for hours; overlapping blocks are one."""
    w = Window.partitionBy("profile").orderBy("ts", "event_id")
    f = events.where("status = 'failed'").withColumn("before", F.lag("ts").over(w))
    gap = F.expr(f"INTERVAL {hours} HOURS")
    new = (F.col("before").isNull() | (F.col("ts") > F.col("before") + gap)).cast("int")
    f = f.withColumn("island", F.sum(new).over(w))
    return f.groupBy("profile", "island").agg(F.count("*").alias("trips"), F.min("ts").alias("starts"), (F.max("ts") + gap).alias("ends")).drop("island")


def in_send_window(ts: Column, zone: str, days=(2, 3, 4, 5, 6), start: int = 9 * 60 + 15, end: int = 17 * 60 + 30) -> Column:
    """Whether a moment is on a send day (1 is Sunday) and from start to end, in minutes of the local day, both included."""
    t = F.from_utc_timestamp(ts, zone)
    minute = F.hour(t) * 60 + F.minute(t)
    return F.dayofweek(t).isin(*days) & minute.between(start, end)


def first_failures(events: DataFrame) -> DataFrame:
    """(address, ts, event_id): each address's first failure."""
    b = events.where("status = 'failed'").groupBy("address").agg(F.min(F.struct("ts", "event_id")).alias("b"))
    return b.select("address", "b.ts", "b.event_id")


def persisted(events: DataFrame) -> DataFrame:
    """The sends to note: real ones, the first of each address and day by event_id."""
    s = events.where("status = 'sent' and not dry_run")
    rn = F.row_number().over(Window.partitionBy("address", F.to_date("ts")).orderBy("event_id"))
    return s.withColumn("rn", rn).where("rn = 1").select("event_id", "address", F.to_date("ts").alias("day"), "message_id")


def noted_sends(outcomes: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """The outcomes to append to the ledger, each by its channel's keys, first wins by order.

    outcomes: result, dry_run, channel, message_id, email, run, phone and the unique column order. Only real sends count. By e-mail
    a row needs a message_id and neither that nor (email, run) may be known; by phone its digits may not be. ledger (key_type,
    key_value) has the kinds message, email_run (email|run) and phone. A row that is not appended makes nothing known.
    """
    mail, digits = F.lower(F.trim("email")), F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")
    key = lambda kind, value: F.struct(F.lit(kind).alias("key_type"), value.alias("key_value"))
    mine = F.when(F.col("channel") == "phone", F.array(key("phone", digits))).otherwise(F.array(key("message", F.col("message_id")), key("email_run", F.when(mail != "", F.concat(mail, F.lit("|"), "run")))))
    good = F.when(F.col("channel") == "phone", digits != "").otherwise(F.coalesce(F.col("message_id"), F.lit("")) != "")
    s = outcomes.where((F.col("result") == "sent") & ~F.coalesce("dry_run", F.lit(False))).where(good)
    long = s.select(F.col(order).alias("id"), F.explode(mine).alias("k")).select("id", "k.*").where("key_value is not null")
    known = long.join(ledger.select("key_type", "key_value"), ["key_type", "key_value"], "left_semi").select("id").distinct()
    rows = long.join(known, "id", "left_anti").select("id", F.concat("key_type", F.lit(":"), "key_value").alias("key"))
    return s.join(first_per_keys(rows).withColumnRenamed("id", order), order, "left_semi")


def heartbeat(events: DataFrame) -> DataFrame:
    """(day, verdict) for each day with events: not a send day, sent, failures, or not ok."""
    d = events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
    verdict = F.when(F.dayofweek("day").isin(1, 7), "not a send day").when(F.col("sent") > F.col("failed"), "sent").when(F.col("failed") > 0, "failures").otherwise("not ok")
    return d.select("day", verdict.alias("verdict"))


def reconcile(sent: DataFrame, snapshot: DataFrame, people: DataFrame) -> DataFrame:
    """(profile, status) of sent profiles that the pending snapshot lacks: accepted where people (profile, degree) has degree 1, else expired."""
    return sent.join(snapshot.select("profile").distinct(), "profile", "left_anti").join(people, "profile", "left").select("profile", F.when(F.col("degree") == 1, "accepted").otherwise("expired").alias("status"))


def outcomes(states: DataFrame, now: DataFrame, snapshot: DataFrame, people: DataFrame, minutes: int = 5, days: int = K.PENDING_DAYS) -> DataFrame:
    """(profile, status, since) of states as they stand at now (one row: now).

    Attempts of minutes or older are unknown. A sent one that snapshot (profile) still lists is withdrawn once it is
    older than days; one that it lacks is accepted if people (profile, degree) say degree 1, else expired.
    """
    s = states.join(F.broadcast(now))  # one row
    s = s.join(snapshot.select("profile").distinct().withColumn("listed", F.lit(True)), "profile", "left").join(people.select("profile", "degree"), "profile", "left")
    age = lambda unit, n: F.col("now") - F.expr(f"INTERVAL {n} {unit}")
    status = F.when((F.col("status") == "attempting") & (F.col("since") <= age("MINUTES", minutes)), "unknown")
    sent = F.when(F.col("listed"), F.when(F.col("since") < age("DAYS", days), "withdrawn").otherwise("sent")).when(F.col("degree") == 1, "accepted").otherwise("expired")
    return s.select("profile", status.when(F.col("status") == "sent", sent).otherwise(F.col("status")).alias("status"), "since")


def sender_days(events: DataFrame, status: str = "sent") -> DataFrame:
    """(address, day, n, week, campaign_day) for each sender and day with events of status: its sends, those of it and the
    six dates before, and how many such days there were, this one included."""
    d = events.where(F.col("status") == status).groupBy("address", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("address").orderBy(F.unix_date("day"))
    return d.withColumns({"week": F.sum("n").over(w.rangeBetween(-6, 0)), "campaign_day": F.row_number().over(w).cast("long")})


def message_room(today: Column, week: Column, cap: Column) -> Column:
    """Messages left today: by the day's cap and by the week's, which have no part in the invites' limits."""
    return F.greatest(F.lit(0).cast("long"), F.least(cap - today, K.MESSAGE_WEEKLY_MAX - week))


def sender_facts(events: DataFrame, hours: int = 48) -> DataFrame:
    """A row for each sender and day with events: sent, breaker (a failure that day), cooldown (a failure of an earlier
    day, hours or less before the day began), backlog (attempts so far less sends), queue_date (last day with attempts),
    queued (attempts of the day that are no dry runs)."""
    count = lambda c: F.count_if(c)
    d = events.groupBy("address", F.to_date("ts").alias("day")).agg(
        count(F.col("status") == "sent").alias("sent"), F.max(F.when(F.col("status") == "failed", F.col("ts"))).alias("failure"),
        count(F.col("status") == "attempting").alias("attempts"), count((F.col("status") == "attempting") & ~F.col("dry_run")).alias("queued"),
    )
    w = Window.partitionBy("address").orderBy("day")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    cooling = F.max("failure").over(before) + F.expr(f"INTERVAL {hours} HOURS") > F.col("day").cast("timestamp")
    return d.select(
        "address", "day", "sent", F.col("failure").isNotNull().alias("breaker"), F.coalesce(cooling, F.lit(False)).alias("cooldown"),
        F.greatest(F.lit(0), F.sum(F.col("attempts") - F.col("sent")).over(so_far)).alias("backlog"), F.max(F.when(F.col("attempts") > 0, F.col("day"))).over(so_far).alias("queue_date"), "queued",
    )


def heartbeat_rules(facts: DataFrame) -> DataFrame:
    """facts with verdict, the first rule that holds, and ok. Sundays and Saturdays are no send days; no supply is no fault."""
    fine = (("not a send day", F.dayofweek("day").isin(1, 7)), ("cooldown", F.col("cooldown")), ("sent", F.col("sent") > 0), ("no supply", F.col("backlog") == 0), ("breaker", F.col("breaker")))
    bad = (("no queue", F.col("queue_date").isNull()), ("stale queue", F.col("queue_date") != F.col("day")), ("empty queue", F.col("queued") == 0))
    verdict = F.coalesce(*[F.when(test, name) for name, test in fine + bad], F.lit("silent failure"))
    return facts.withColumn("verdict", verdict).withColumn("ok", F.col("verdict").isin(*[name for name, _ in fine]))
