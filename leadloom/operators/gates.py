"""Leads: assembly, score, qualification, ranking, contact gates, address dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import constants as K

from .contacts import harvest_emails, pick_best_contact
from .signals import intake_signal, property_scale, score_traffic, site_signals

VOLUME_RANK = {"na": 0, "low": 0, "medium": 1, "high": 2}
TRAFFIC_RANK = {"low": 0, "unknown": 1, "medium": 2, "high": 3}
MIN_SCORE = 82


def rank_of(c: Column, ranks: dict, other: int) -> Column:
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def lead_score() -> Column:
    base = F.when(F.col("email_class") == "person", 90).when(F.col("email_class") == "personal", 78).otherwise(82)
    size = F.when(F.col("branches").between(5, 15), 5).when(F.col("branches").between(16, 30), 3).otherwise(0)
    page = F.when((F.col("n_emails") >= 2) & F.arrays_overlap("slugs", F.array(F.lit("contact"), F.lit("contactus"), F.lit("team"))), 1).otherwise(0)
    return (base + size + page).cast("long")


def traffic_of_candidates(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """The sites that are candidates, by their first row, with traffic scores."""
    first = candidates.groupBy("domain").agg(F.min("seq").alias("seq"))
    c = candidates.join(first, ["domain", "seq"]).select("domain", "seq", "name", "country", "vertical", "branches")
    return score_traffic(site_signals(pages).join(c, "domain"), F.col("branches"))


def assemble_leads(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """A lead for each candidate site with an address; sites that book online already are none."""
    t = traffic_of_candidates(pages, candidates).where("not in_platform")
    b = pick_best_contact(harvest_emails(pages))
    volume = F.when(F.lower("vertical").isin(*K.HOTEL_VERTICALS), property_scale()).otherwise("na")
    return t.join(b, "domain").withColumns({"intake": intake_signal(), "hotel_volume": volume}).withColumn("score", lead_score())


def qualify_leads(leads: DataFrame, min_traffic: str | None = None, min_volume: str | None = None, dead=("modern_booking",), mailbox: bool = True) -> DataFrame:
    """leads with drop_reason, the first rule that rejects, or null. An unknown floor is no floor; unknown traffic passes.

    lasting_reason is the same without the traffic rule, which comes last; who reads only it needs no traffic signals.
    """
    exempt = F.lit(not mailbox) & F.col("email_class").isin("personal", "none")
    reason = F.when((F.col("email_class") == "personal") & ~exempt, "freemail-only").when(F.col("intake").isin(*dead), F.concat(F.lit("dead-signal:"), "intake"))
    reason = reason.when((F.col("score") < MIN_SCORE) & ~exempt, f"score<{MIN_SCORE}")
    if min_volume in VOLUME_RANK:
        small = rank_of(F.col("hotel_volume"), VOLUME_RANK, 0) < VOLUME_RANK[min_volume]
        reason = reason.when(F.lower("vertical").isin(*K.HOTEL_VERTICALS) & small, "hotel-volume-too-low")
    lasting = reason
    if min_traffic in ("low", "medium", "high"):
        quiet = rank_of(F.col("traffic_tier"), TRAFFIC_RANK, 0) < TRAFFIC_RANK[min_traffic]
        reason = reason.when((F.col("traffic_tier") != "unknown") & quiet, "traffic-too-low")
    return leads.withColumns({"drop_reason": reason, "lasting_reason": lasting})


def disqualify_rows(qualified: DataFrame, mailbox: bool = True) -> DataFrame:
    """(domain, reason) of the drops that last; a traffic verdict never does. Without lasting_reason, drop_reason is read."""
    reason = F.col("lasting_reason" if "lasting_reason" in qualified.columns else "drop_reason")
    d = qualified.select("domain", reason.alias("reason")).where(F.col("reason").isNotNull() & (F.col("reason") != "traffic-too-low"))
    if not mailbox:
        d = d.where(F.col("reason").startswith("dead-signal") | F.col("reason").startswith("hotel-volume"))
    return d.distinct()


def ranking() -> list[Column]:
    """Volume, score, class, traffic tier and score, branches; then the row's number."""
    volume = rank_of(F.col("hotel_volume"), {"high": 0, "medium": 1, "low": 2, "na": 2}, 3)
    klass = rank_of(F.col("email_class"), {"person": 0, "role": 1, "personal": 2}, 3)
    return [volume, F.desc("score"), klass, rank_of(F.col("traffic_tier"), TRAFFIC_RANK, 1).desc(), F.desc("traffic_score"), F.desc("branches"), F.col("seq")]


def rank_and_cap(leads: DataFrame, most: int = 250) -> DataFrame:
    """The first most leads. Sorting with a limit keeps each task's best only, so no task sorts all."""
    return leads.orderBy(*ranking()).limit(most)


def dedup_address(leads: DataFrame) -> DataFrame:
    """leads with kept_by: of the leads with one address, the domain of the best; itself where it is kept."""
    w = Window.partitionBy("best_email").orderBy(F.desc("score"), "seq")
    return leads.withColumn("kept_by", F.when(F.coalesce("best_email", F.lit("")) == "", F.col("domain")).otherwise(F.first("domain").over(w)))


def gate_contacts(leads: DataFrame, results: DataFrame, mail_domains: DataFrame) -> DataFrame:
    """leads with drop_stage by the first failing gate: result, name, mailbox, evidence, mail. results: domain, found, surname, email, basis, url."""
    r = leads.join(results, "domain", "left").join(mail_domains.select(F.col("domain").alias("mail_domain"), F.lit(True).alias("takes_mail")), F.substring_index("email", "@", -1) == F.col("mail_domain"), "left")
    role = F.substring_index("email", "@", 1).isin(*K.ROLE_LOCALS)
    stage = (
        F.when(F.col("found").isNull(), "no_result").when(~F.col("found"), "no_match").when(F.coalesce("surname", F.lit("")) == "", "no_name")
        .when(role, "no_direct_email").when((F.col("basis") == "constructed") & F.col("url").isNull(), "no_evidence").when(F.col("takes_mail").isNull(), "dead_domain")
    )
    return r.withColumn("drop_stage", stage).drop("mail_domain", "takes_mail")
