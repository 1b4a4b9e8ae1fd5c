"""Queries over page text and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import geo, pages
from leadloom.sources import fixtures as X

from . import oracle_parts as O
from . import record_queries as R

QUERIES, ORACLE_SQL = {}, {}
PHRASES = ["the and attion", "und der", "de la"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _visible(c: str) -> str:
    for tag in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"trim(lower(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(f"SELECT * FROM (SELECT page_id, CASE {' '.join(f'WHEN contains(t, {O.q(p)}) THEN {O.q(p)}' for p in PHRASES)} END AS reason FROM (SELECT page_id, {_visible('html')} AS t FROM pages)) WHERE reason IS NOT NULL")
def flag_blocked_pages(s, d):
    return pages.flag_pages(X.table(s, d, "pages"), PHRASES)


@query(f"SELECT DISTINCT doc_id AS id, unnest({O.every('text', pages.NAME, 1)}) AS first_name FROM documents")
def page_person_names(s, d):
    return pages.person_names(X.messages(s, d))


@query(f"""WITH {O.SITE_PAGES}, l AS (SELECT domain, page_id, i AS place, trim(ls[i]) AS line FROM (SELECT domain, page_id, string_split(regexp_replace(html, '<[^>]+>', chr(10), 'g'), chr(10)) AS ls FROM site_pages), unnest(range(1, len(ls) + 1)) AS u(i)),
  f AS (SELECT *, row_number() OVER (PARTITION BY domain, lower(line) ORDER BY page_id, place) AS k FROM l WHERE length(line) >= 3),
  p AS (SELECT domain, page_id, left(string_agg(line, chr(10) ORDER BY place), 1200) AS text FROM f WHERE k = 1 GROUP BY domain, page_id)
  SELECT * FROM (SELECT domain, page_id, text, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM p WHERE length(text) >= 80) WHERE rn <= 3""")
def page_digest(s, d):
    return pages.page_digest(X.site_pages(s, d))


@query(f"WITH {R._MERGED}, f AS (SELECT DISTINCT batch_file AS run, domain FROM merged WHERE drop_reason IN ('sent', 'disqualified')) SELECT run, count(*) AS failed, count(*) FILTER (WHERE first_run < run) AS repeated FROM (SELECT *, min(run) OVER (PARTITION BY domain) AS first_run FROM f) GROUP BY run")
def repeat_failure_report(s, d):
    return pages.repeat_failures(R._merged(s, d).where("drop_reason in ('sent', 'disqualified')").withColumnRenamed("batch_file", "run"))


@query(f"WITH {O.CANDIDATES} SELECT batch_file AS run, count(*) AS n, count(*) FILTER (WHERE linked) AS done, count(*) FILTER (WHERE linked) < 0.8 * count(*) AS abort FROM candidates GROUP BY batch_file")
def completion_guard(s, d):
    return pages.completion_guard(X.candidates(s, d).select(F.col("batch_file").alias("run"), F.col("linked").alias("done")), 0.8)


@query(f"""WITH {O.CANDIDATES} SELECT seq, '{{"domain":"' || domain || '","country":"' || country || '","branches":' || branches || '}}' AS payload FROM candidates""")
def build_work_items(s, d):
    return pages.work_items(X.candidates(s, d), "seq", ["domain", "country", "branches"])


_STEP = 5 * 2**0.5 / 111.32


@query(f"""WITH {O.GEO}, g AS (SELECT *, {_STEP!r} / greatest(cos(radians(lat)), 0.15) AS lon_step FROM places),
  c AS (SELECT place, lat, lon, half, lon_step, unnest(range(0, floor(2 * half / {_STEP!r})::INTEGER + 1)) AS i FROM g), e AS (SELECT *, unnest(range(0, floor(2 * half / lon_step)::INTEGER + 1)) AS j FROM c)
  SELECT place, count(*) AS n, min(i) AS least_i, max(i) AS most_i, max(j) AS most_j FROM e GROUP BY place""")
def grid_cover(s, d):
    g = geo.grid_cover(X.places(s), 5.0)
    hit = geo.bbox_assign(X.geo_points(s, d), X.places(s)).groupBy("place").agg(F.count("*").alias("points"))  # the places that the points reach
    g = g.join(hit, "place", "left")
    return g.groupBy("place").agg(F.count("*").alias("n"), F.min("i").alias("least_i"), F.max("i").alias("most_i"), F.max("j").alias("most_j"))
