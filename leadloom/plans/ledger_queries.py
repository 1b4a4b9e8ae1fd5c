"""Queries over written files, stored ledgers, counters of one pass and rolling rates, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators import candidates as C
from leadloom.operators import lifecycle as L
from leadloom.operators.neardup import shared_folder
from leadloom.sources import files, ledgers
from leadloom.sources import fixtures as X

from . import oracle_parts as O
from . import record_queries as R
from .chain_queries import _result_lines

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- files ----------------------------------------------------------------------
@query(f"""WITH {R._LINES}, n AS (SELECT l.*, c.batch_file AS batch, row_number() OVER (PARTITION BY c.batch_file ORDER BY l.seq) AS line_no FROM lines l JOIN candidates c USING (seq))
  SELECT batch, line_no, trim(p[1]) AS domain, trim(p[2]) AS name, trim(p[3]) AS country, trim(p[4]) AS vertical, coalesce(try_cast(p[5] AS BIGINT), 0) AS branches, row_number() OVER (ORDER BY batch, line_no) AS place
  FROM (SELECT batch, line_no, line, string_split(line, '|') AS p FROM n WHERE NOT starts_with(trim(line), '#') AND trim(line) <> '') WHERE len(p) >= 4""")
def scan_candidate_files(s, d):
    """Batch files written from the fixture's lines and read again; place is the order of what is left."""
    folder = shared_folder(s, "batch-files")
    lines = R._lines(s, d).join(X.candidates(s, d).select("seq", "batch_file"), "seq")
    lines.repartition("batch_file").sortWithinPartitions("batch_file", "seq").select("batch_file", "line").write.partitionBy("batch_file").text(folder)
    c = files.scan_candidate_files(s, folder)
    batch = F.regexp_extract("file", r"batch_file=(\d+)", 1).cast("int")
    earlier = c.groupBy("file").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    earlier = earlier.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    place = F.col("before") + F.row_number().over(Window.partitionBy("file").orderBy("seq"))
    return c.join(earlier.drop("n"), "file").select(batch.alias("batch"), "line_no", "domain", "name", "country", "vertical", "branches", place.alias("place"))


@query("SELECT 'L' || c_custkey % 100 AS lead_id, max(c_custkey) AS last, arg_max(c_custkey % 3 = 0, c_custkey) AS found, 'N' || max(c_custkey) AS first_name FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 GROUP BY 1")
def scan_result_files(s, d):
    """Result files, a JSON text a line, some broken, written and read again: the last result of each lead."""
    folder = shared_folder(s, "result-files")
    _result_lines(s, d).repartitionByRange(8, "file").sortWithinPartitions("file").select("line").write.text(folder)
    results, _ = files.scan_result_files(s, folder, whole=False)
    return results.select("lead_id", F.substring("first_name", 2, 20).cast("long").alias("last"), "found", "first_name")


@query(f"""WITH {O.SITE_PAGES}, p AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY slug, page_id) - 1) // 64 AS part FROM site_pages WHERE length(html) >= 500)
  SELECT domain, part, count(*) AS n_pages, string_agg(slug, ',' ORDER BY slug, page_id) AS slugs, string_agg(html, chr(10) ORDER BY slug, page_id) AS text FROM p GROUP BY domain, part""")
def site_text(s, d):
    return files.site_text(X.site_pages(s, d))


# ---- ledgers ----------------------------------------------------------------------
def _stored_ledger(s, d) -> str:
    name = f"ledger_{uuid.uuid4().hex}"
    ledgers.save_ledger(X.ledger_lines(s, d), name, "domain")
    return name


@query(f"WITH {O.LEDGER} SELECT m, domain, entry_date FROM ledger_lines WHERE run_id <> 'r1' AND (DATE '{R.TODAY}' - entry_date) <= 30")
def ledger_window_stored(s, d):
    return ledgers.read_window(s, _stored_ledger(s, d), "r1", R.TODAY, 30).select("m", "domain", "entry_date")


@query(f"""WITH {O.LEDGER}, n AS (SELECT domain, seq, (row_number() OVER (PARTITION BY domain ORDER BY seq)) AS k FROM candidates WHERE domain NOT IN (SELECT domain FROM ledger_lines))
  SELECT domain, seq, 1::BIGINT AS times FROM n WHERE k = 1 UNION ALL SELECT domain, m, 1 FROM ledger_lines""")
def append_once_stored(s, d):
    """The stored ledger after the candidates were appended to it twice: each domain once."""
    name = _stored_ledger(s, d)
    rows = X.candidates(s, d).select(F.col("seq").alias("m"), F.lit("").alias("line"), F.lit(R.TODAY).cast("date").alias("entry_date"), F.lit("r9").alias("run_id"), "domain", F.lit("email").alias("kind"))
    for _ in range(2):
        ledgers.append_unseen(rows, name, "domain", [F.col("m").alias("__m")])
    return s.table(name).groupBy("domain").agg(F.min("m").alias("seq"), F.count("*").alias("times"))


# ---- counters -----------------------------------------------------------------------
_COUNTED = ", ".join([f"count(*) FILTER (WHERE drop_reason = '{r}') AS {r}" for r in C.REASONS] + [f"count(*) FILTER (WHERE drop_reason IS NULL AND country = '{c}') AS kept_{c}" for c in X.ALLOWED])


@query(f"WITH {R._MERGED} SELECT count(*) AS rows, count(*) FILTER (WHERE drop_reason IS NULL) AS kept, {_COUNTED} FROM merged")
def merge_counters(s, d):
    """The counts of a merge, taken while it is written: the tables are read once."""
    merged, seen = C.observed_merge(R._merged(s, d), X.ALLOWED, f"merge-{uuid.uuid4().hex}")
    merged.write.parquet(shared_folder(s, "merged"))
    counts = seen.get
    return s.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


# ---- rates ------------------------------------------------------------------------
@query(f"""WITH {O.SEND_EVENTS}, a AS (SELECT DISTINCT profile FROM send_events WHERE status = 'accepted'), x AS (SELECT address, event_id, ts, a.profile IS NOT NULL AS accepted FROM send_events s LEFT JOIN a USING (profile) WHERE status = 'sent')
  SELECT address, event_id, row_number() OVER w AS "at", accepted, CASE WHEN count(*) OVER l = 10 THEN round(count(*) FILTER (WHERE accepted) OVER l * 100.0 / 10, 4) END AS rate FROM x
  WINDOW w AS (PARTITION BY address ORDER BY ts, event_id), l AS (PARTITION BY address ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def trailing_rates(s, d):
    """Each sender's rate of accepted ones over its last ten sends, at each send."""
    e = X.send_events(s, d)
    accepted = e.where("status = 'accepted'").select("profile").distinct().withColumn("yes", F.lit(True))
    sends = e.where("status = 'sent'").join(accepted, "profile", "left").select("address", "event_id", "ts", F.coalesce("yes", F.lit(False)).alias("accepted"))
    return L.rolling_rates(sends, 10)
