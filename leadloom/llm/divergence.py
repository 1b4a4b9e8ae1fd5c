"""Source divergence audit: term use of each source of a language against the other sources and the language."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents of its language that a kept term stands in at least, and terms listed a group.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Bytes of a term's prefix at the first level; each level has twice as many as the one before.
FIRST_BYTES = 4
#: Bits of the filter that names a level's surviving prefixes: fixed, so what tasks are handed does not grow with the data.
FILTER_BITS = 1 << 24
#: Documents, and characters beyond the first document, of a block that is parsed at once.
BLOCK_ROWS, BLOCK_CHARS = 512, 2_000_000
#: Counts that a task holds before it adds them up and hands them on.
TASK_COUNTS = 300_000
#: Bytes of an Arrow batch of blocks: a task holds one batch in Spark and one in Python, however many blocks it reads.
BATCH_BYTES = 8 << 20
#: Cells (term, source) of a block that one task compares.
BLOCK_CELLS = 2_000_000
SCALE = 1_000_000_000
#: What stands between terms.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most for the jobs that run inside; the session's own setting holds again after them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _block(langs: list, sources: list, texts):
    """One row of _document_terms: the terms of some documents, each a number, and how often each document has which."""
    import numpy as np
    import pyarrow.compute as pc

    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=NO_TERM)
    ends = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    terms = coded.dictionary
    sizes = pc.binary_length(terms).to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    key, n = np.unique(doc.astype(np.int64) * max(len(terms), 1) + coded.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(key, max(len(terms), 1))
    there = sizes[term] > 0 if len(term) else np.zeros(0, bool)
    groups: dict = {}
    of = [groups.setdefault(g, len(groups)) for g in zip(langs, sources)]
    return [g[0] for g in groups], [g[1] for g in groups], of, terms, doc[there], term[there], n[there], int(sizes.max(initial=0))


def _document_terms(docs: DataFrame) -> DataFrame:
    """Blocks of documents with their terms, split and numbered by Arrow; nulls read as empty.

    (langs, sources: of the block's groups, group: of each document, terms, and for each document and term of it: doc, term, n;
    longest: bytes of the longest term). A block has whole documents, up to BLOCK_ROWS or BLOCK_CHARS. Numbers are packed as 32-bit
    integers and terms by line ends, which no term has, so Spark moves a block as a few byte strings.
    """
    names = ("langs", "sources", "group", "terms", "doc", "term", "n", "longest")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        one = lambda values: pa.array([values], pa.list_(pa.string()))
        packed = lambda values: pa.array([np.asarray(values, "<i4").tobytes()], pa.binary())
        for b in batches:
            sizes = pc.utf8_length(b.column(2)).to_numpy()
            start, chars = 0, 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or i - start == BLOCK_ROWS or (i > start and chars + sizes[i] > BLOCK_CHARS):
                    if i > start:
                        some = b.slice(start, i - start)
                        langs, sources, of, terms, doc, term, n, longest = _block(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2))
                        text = pa.array(["\n".join(terms.to_pylist()).encode()], pa.binary())
                        yield pa.record_batch([one(langs), one(sources), packed(of), text, *map(packed, (doc, term, n)), pa.array([longest], pa.int32())], names=names)
                    start, chars = i, 0
                if i < b.num_rows:
                    chars += sizes[i]

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kinds = ("array<string>",) * 2 + ("binary",) * 5 + ("int",)
    return docs.select(*map(empty, ("lang", "source", "text"))).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))


def _bits(lang: str, prefixes, size: int, bits: int):
    """Two places in a filter of bits for each of prefixes (an Arrow array of binaries of size bytes) of a language."""
    import numpy as np
    import xxhash

    raw = np.frombuffer(b"".join(prefixes.to_pylist()), np.uint8).reshape(-1, size)
    h = np.full(len(raw), xxhash.xxh64_intdigest(lang.encode(), 42), np.uint64)
    for column in raw.T:
        h = (h ^ column) * np.uint64(0x100000001B3)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _counts(parsed: DataFrame, before: int, size: int, filters: dict[int, bytes], whole: bool) -> DataFrame:
    """(lang, source, term, n_docs, n), counts of documents and occurrences: a key has a row for each task that met it.

    Prefixes of size bytes of longer terms (source and n null) or, with whole, all terms as they are. Terms of more than b bytes
    go on only if their prefix of b bytes may be among those of filters[b]. A document is whole in one block, so a task
    counts it once for each of its prefixes; counts are added up in the task.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = []
        tests = {cut: np.frombuffer(alive, np.uint8) for cut, alive in filters.items()}
        groups: dict[tuple[str, str | None], int] = {}

        def counted(of: list, g, terms, n_docs, n):
            g = np.array([groups.setdefault(x, len(groups)) for x in of], np.int32)[g]
            return pa.table([pa.array(g), terms, pa.array(n_docs, pa.int64()), n], names=["g", "term", "n_docs", "n"])

        def handed_on():
            t = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n_docs", "sum"), ("n", "sum")])
            held.clear()
            langs, sources = (pa.array([x[i] for x in groups], pa.string()) for i in (0, 1))
            for b in t.to_batches(max_chunksize=50_000):
                of = b.column("g")
                yield pa.record_batch([langs.take(of), sources.take(of), b.column("term"), b.column("n_docs_sum"), b.column("n_sum")], names=["lang", "source", "term", "n_docs", "n"])
            pa.default_memory_pool().release_unused()

        for b in batches:
            for i in range(b.num_rows):
                langs, sources = (b.column(c)[i].values for c in (0, 1))
                terms = b.column(3)[i].as_py().split(b"\n")
                raw, of, doc, term, n = pa.array(terms, pa.binary()), *(np.frombuffer(b.column(c)[i].as_buffer(), "<i4") for c in (2, 4, 5, 6))
                sizes = pc.binary_length(raw).to_numpy()
                languages = list(dict.fromkeys(langs.to_pylist()))
                lang_of = np.array([languages.index(x) for x in langs.to_pylist()], np.int64)[of]
                go = sizes[term] > before
                doc, term, n = doc[go], term[go], n[go]
                # only terms that are left are looked at, under new numbers
                left = np.zeros(len(raw), bool)
                left[term] = True
                raw, sizes, term = raw.filter(pa.array(left)), sizes[left], (np.cumsum(left) - 1)[term]
                for cut, alive in tests.items():
                    long = sizes > cut
                    if not len(term) or not long.any():
                        continue
                    part = pc.binary_slice(raw, 0, cut).dictionary_encode()
                    which = part.indices.to_numpy()
                    asked, good = np.zeros((2, len(languages), len(part.dictionary)), bool)
                    asked[lang_of[doc], which[term]] = True
                    asked &= pc.binary_length(part.dictionary).to_numpy() == cut
                    for k, lang in enumerate(languages):
                        whole_cut = np.flatnonzero(asked[k])
                        one, two = _bits(lang, part.dictionary.take(pa.array(whole_cut)), cut, 8 * len(alive))
                        good[k, whole_cut] = (alive[one >> 3] >> (one & 7)) & (alive[two >> 3] >> (two & 7)) & 1
                    go = good[lang_of[doc], which[term]] | ~long[term]
                    doc, term, n = doc[go], term[go], n[go]
                if whole and len(term):
                    key, at = np.unique(of[doc].astype(np.int64) * len(raw) + term, return_inverse=True)
                    g, t = np.divmod(key, len(raw))
                    total = np.bincount(at, n).astype(np.int64)
                    held.append(counted(list(zip(langs.to_pylist(), sources.to_pylist())), g, raw.take(pa.array(t)), np.bincount(at), pa.array(total)))
                elif len(term):
                    part = pc.binary_slice(raw, 0, size).dictionary_encode()
                    many = len(part.dictionary)
                    pair = np.unique(doc.astype(np.int64) * many + part.indices.to_numpy()[term])
                    key, docs = np.unique(lang_of[pair // many] * many + pair % many, return_counts=True)
                    g, t = np.divmod(key, many)
                    held.append(counted([(x, None) for x in languages], g, part.dictionary.take(pa.array(t)), docs, pa.nulls(len(g), pa.int64())))
                if sum(t.num_rows for t in held) > TASK_COUNTS:
                    yield from handed_on()
        if held:
            yield from handed_on()

    names = ("langs", "sources", "group", "terms", "doc", "term", "n")
    return parsed.where(F.col("longest") > before).select(*names).mapInArrow(run, "lang string, source string, term binary, n_docs long, n long")


def _filter(survivors: DataFrame, size: int) -> bytes:
    """A Bloom filter of (lang, term) of FILTER_BITS bits, terms of size bytes; it may name more than the survivors, never less."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for lang in pc.unique(b.column(0)):
                some = b.filter(pc.equal(b.column(0), lang))
                yield pa.record_batch([pa.array(np.concatenate(_bits(lang.as_py(), some.column(1), size, FILTER_BITS)))], names=["bit"])

    words = survivors.select("lang", "term").mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[[r.word for r in words]] = [r.bits for r in words]
    return out.astype("<i8").tobytes()


def frequent_terms(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n, n_lang, tid, first) of all terms that stand in at least least documents of their language, (lang, source) of all groups).

    n: occurrences in the group, n_lang: in the language; tid: a number of the term in its language; first: one row of it has it true.

    Terms are refined as byte prefixes, level by level: a level counts the distinct documents of each prefix and
    hands the prefixes that reach least to the next one, which looks only at terms behind them, until none is longer than
    the level. Then whole terms all of whose prefixes are left are counted exactly, with their groups. The survivors go to the tasks as a
    Bloom filter of fixed size; a prefix it names in error is counted later and falls there, so no result depends on it.
    """
    with _small_batches(docs.sparkSession):
        # a row has a whole block, so small row groups keep few of them in memory at a time; zstd, as it is the largest table on disk
        parsed = stored(_document_terms(docs), "divergence-terms", compression="zstd", **{"parquet.block.size": 4 << 20})
        filters: dict[int, bytes] = {}
        size = FIRST_BYTES
        while True:
            prefixes = _counts(parsed, size, size, filters, False).groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))
            survivors = stored(prefixes.where(F.col("n_docs") >= least).select("lang", "term"), "divergence-prefixes")
            filters[size] = _filter(survivors, size)
            if survivors.isEmpty():
                break
            size *= 2
        whole = _counts(parsed, 0, 0, filters, True)
        # one shuffle by term serves the counts of its sources and of its language
        w = Window.partitionBy("lang", "term")
        counts = whole.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")).withColumn("row", F.monotonically_increasing_id())
        counts = counts.withColumns({"docs": F.sum("n_docs").over(w), "n_lang": F.sum("n").over(w), "tid": F.min("row").over(w)}).where(F.col("docs") >= least)
        counts = stored(counts.select("lang", "source", "term", "n", "n_lang", "tid", (F.col("row") == F.col("tid")).alias("first")), "divergence-counts")
    groups = parsed.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select(F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct()
    return counts, groups


def _share(n, total) -> F.Column:
    """1 + floor(SCALE * (n + 1) / total), exactly; decimals only where the product would leave 64 bits."""
    wide = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), total)).otherwise(wide)


def _compare(counts, groups):
    """Summed differences of each pair of sources over the terms of one block: each term's shares in all sources, side by side."""
    import numpy as np
    import pandas as pd

    groups = groups.sort_values("number")
    size = len(groups)
    terms, row = np.unique(counts["tid"].to_numpy(), return_inverse=True)
    p = np.tile(groups["base"].to_numpy(np.int64), (len(terms), 1))
    p[row, counts["s"].to_numpy()] = counts["p"].to_numpy(np.int64)
    sums = np.zeros((size, size), np.int64)
    for i in range(size):
        d = p[:, i, None] - p
        sums[i] = (d * d // p).sum(0)
    i, j = np.nonzero(~np.eye(size, dtype=bool))
    return pd.DataFrame({"lang": groups["of"].iloc[0], "s": i, "o": j, "value": sums[i, j]})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's use of terms differs from other sources and its language.

    Part pair: value against each other source of the language, over all kept terms. Part term: the terms that the source uses
    more than its language, the first top by value. docs: lang, source, text; other columns are not read. Each row is a document,
    also a repeated one. Nulls read as empty; a group without terms is compared too; a language without kept terms
    has value 0 everywhere; an only source has no pairs; no rows, no rows. Pairs are compared in blocks of terms, whose
    number grows with terms and sources; a source's terms are cut to top in each task before they are dealt to one.
    """
    counts, groups = frequent_terms(docs, least)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    g = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    of_lang = Window.partitionBy("lang")
    many, number = F.count("*").over(of_lang), F.row_number().over(of_lang.orderBy("source")) - 1
    g = g.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("v") * many / BLOCK_CELLS)), "s": number, "whole": F.col("total") + F.col("v")})
    g = stored(g.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("whole"))).otherwise(1)), "divergence-groups")

    known = counts.join(g, ["lang", "source"])
    p = known.select("lang", "source", "s", "term", "tid", _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("n_lang"), F.col("lang_total") + F.col("v")).alias("q"), "blocks")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)

    blocks = p.select("lang", F.pmod(F.xxhash64("tid"), "blocks").alias("block"), "s", "tid", "p").groupBy("lang", "block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sides = g.select(F.col("lang").alias("of"), every.alias("at"), F.col("s").alias("number"), F.col("p0").alias("base")).groupBy("of", "at")
    sums = blocks.cogroup(sides).applyInPandas(_compare, "lang string, s int, o int, value long").groupBy("lang", "s", "o").agg(F.sum("value").alias("value"))
    name = lambda number, c: g.select("lang", F.col("s").alias(number), F.col("source").alias(c))
    pairs = sums.join(name("s", "source"), ["lang", "s"]).join(name("o", "item"), ["lang", "o"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return terms.unionByName(pairs)
