"""Text files as tables: lines in the order of file and place, result files, page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.operators import candidates as C
from leadloom.operators import entities
from leadloom.operators.neardup import settled

#: Lines of one file stay below this, so a line's number is one long behind its file's.
FILE_LINES = 1 << 32


def scan_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, line_no, seq, line) of the text files under path: line_no from 1 in each file, seq rising over files by path.

    A file is read in splits, in any number of tasks. A row's running id orders the rows of its split, and splits are
    ordered by where they start; so numbers come from one small row for each split, and no task sees a whole file
    or all lines. The lines are settled first, as running ids hold for one reading only.
    """
    r = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    raw = r.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = settled(raw.withColumn("id", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # one row a file
    splits = splits.withColumn("before", before).join(files, "file").select("file", "start", "first", "before", "file_no")
    line_no = F.col("before") + F.col("id") - F.col("first") + 1
    d = rows.join(splits, ["file", "start"]).withColumn("line_no", line_no.cast("long"))
    return d.select("file", "line_no", (F.col("file_no") * FILE_LINES + F.col("line_no")).alias("seq"), F.col("value").alias("line"))


def scan_candidate_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """parse_candidates of the files under path, with file and line_no; seq is the order in which batches are merged."""
    lines = scan_lines(spark, path, pattern)
    return C.parse_candidates(lines).join(lines.select("seq", "file", "line_no"), "seq")


def scan_result_files(spark: SparkSession, path: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, audit) of the files under path: the last result of each lead_id by file, and counts of bad ones.

    Each file is one JSON text, or, where whole is false, holds one a line; then the last line of the last file holds.
    """
    if not whole:
        return entities.scan_results(scan_lines(spark, path).select(F.col("seq").alias("file"), "line"))
    r = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return entities.scan_results(r.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")))


def scan_page_files(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(domain, slug, html) of the files domain__slug.html under path, whole; pages under least characters and other names go."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*__*.html").text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    p = r.select(F.url_decode(name).alias("name"), F.col("value").alias("html")).where(F.char_length("html") >= least)
    cut = lambda i: F.regexp_extract("name", r"^(.+?)__(.+)\.html$", i)
    return p.select(cut(1).alias("domain"), cut(2).alias("slug"), "html").where("domain <> ''")


def site_text(pages: DataFrame, least: int = 500, part_pages: int = 64) -> DataFrame:
    """(domain, part, n_pages, slugs, text): a site's pages of least characters and more by slug and page_id, joined by line ends.

    A site's text comes in parts of part_pages pages, from 0, so that none is held whole; places are given to keys, without html.
    """
    p = pages.where(F.char_length("html") >= least)
    at = F.row_number().over(Window.partitionBy("domain").orderBy("slug", "page_id")) - 1
    placed = p.select("domain", "slug", "page_id").withColumn("part", F.floor(at / part_pages)).select("page_id", "part")
    g = p.select("domain", "slug", "page_id", "html").join(placed, "page_id").groupBy("domain", "part").agg(F.array_sort(F.collect_list(F.struct("slug", "page_id", "html"))).alias("ps"))
    of = lambda c: F.transform("ps", lambda x: x[c])
    return g.select("domain", "part", F.size("ps").cast("long").alias("n_pages"), F.array_join(of("slug"), ",").alias("slugs"), F.array_join(of("html"), "\n").alias("text"))
