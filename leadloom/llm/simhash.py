"""SimHash near-dedup: 64-bit fingerprints, compared exactly in tiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_labels, stored, unused

#: Rows of a tile; a bucket with more is cut into tiles and worked on pair of tiles by pair.
TILE_ROWS = 4096
#: Above so many fingerprints, more and longer block keys keep the buckets short.
WIDE_KEYS_FROM = 1 << 24


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the word shingles of a text, unsigned; 0 if it has no word."""
    import numpy as np
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found]).tolist()
    k = min(words, len(found))
    ends = (ends - 1).tolist()[k - 1 :]
    h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(ends))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        votes += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((votes * 2 > len(h)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp, th) of each row; fp is the unsigned fingerprint's bits as a long, th the text's hash. Whole texts, null: no word."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "th"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, fp long, th long")


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks such that two fingerprints within radius are equal under one: any agree of agree + radius blocks."""
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, agree)]


def tile_links(fps, rep, bucket, tile, split: bool, radius: int):
    """Star links (rep, rep) of one unit of work: all pairs of a bucket, or all pairs across two tiles of it.

    Rows are ordered by bucket and population count; sub-tiles whose counts differ beyond the radius are skipped.
    """
    import numpy as np

    pop = np.bitwise_count(fps)
    order = np.lexsort((pop, tile, bucket))
    fps, rep, bucket, tile, pop = fps[order], rep[order], bucket[order], tile[order], pop[order].astype(np.int16)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    left, right = [], []
    for s, e in zip(edges[:-1], edges[1:]):
        if e - s < 2:
            continue
        cut = s + int(np.searchsorted(tile[s:e], tile[e - 1])) if split and tile[s] != tile[e - 1] else None
        ours = (s, cut) if cut else (s, e)
        theirs = (cut, e) if cut else (s, e)
        step = 256
        for i in range(*ours, step):
            x = slice(i, min(i + step, ours[1]))
            lo, hi = np.searchsorted(pop[theirs[0] : theirs[1]], [pop[x.start] - radius, pop[x.stop - 1] + radius + 1])
            first = theirs[0] + int(lo) if cut else max(theirs[0] + int(lo), i)
            for j in range(first, theirs[0] + int(hi), 8192):
                y = slice(j, min(j + 8192, theirs[0] + int(hi)))
                a, b = np.nonzero(np.bitwise_count(fps[x, None] ^ fps[None, y]) <= radius)
                a, b = a + i, b + j
                keep = a != b if cut else a < b
                left.append(a[keep])
                right.append(b[keep])
    if not left:
        return rep[:0], rep[:0]
    label = local_labels(len(fps), np.concatenate(left), np.concatenate(right))
    at = np.flatnonzero(label != np.arange(len(fps)))
    return rep[at], rep[label[at]]


def similar_fingerprints(fps: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect the reps of all fingerprints within radius. fps: distinct (fp, rep).

    Fingerprints within the radius agree on a block key (pigeonhole), so tiles are formed inside the
    buckets of equal keys; every pair of a bucket is compared exactly. A bucket beyond tile_rows is cut
    into tiles by a hash and each pair of tiles is a task's work of its own, so no bucket lands in one task.
    """
    n = fps.count()
    masks = block_masks(radius, 1 if n <= WIDE_KEYS_FROM else 4)
    keyed = stored(
        fps.select("fp", "rep", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])).alias("bucket")),
        "simhash-keys",
    )
    size = stored(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    units = max(24, n * len(masks) // 200_000)
    both = keyed.join(size, "bucket")
    tiles = F.ceil(F.col("n") / tile_rows).cast("int")
    both = both.withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int"))
    usual = both.where(f"n <= {tile_rows}").select("fp", "rep", "bucket", "tile", F.pmod("bucket", F.lit(units)).alias("unit"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    hot = (
        both.where(f"n > {tile_rows}")
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("fp", "rep", "bucket", "tile", F.col("bucket").alias("unit"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    )

    def work(pdf):
        import numpy as np
        import pandas as pd

        a, b = tile_links(pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), pdf["bucket"].to_numpy(), pdf["tile"].to_numpy(), bool(pdf["i"].iat[0] >= 0), radius)
        return pd.DataFrame({"a": a, "b": b})

    return usual.union(hot).groupBy("unit", "i", "j").applyInPandas(work, "a long, b long")


def fingerprint_components(found: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of found (doc_id, fp); null where no row reached has a doc_id."""
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-rep")
    links = similar_fingerprints(fps.where("rep is not null"), radius, tile_rows)
    comp = stored(connected_components(links), "simhash-cc")
    return stored(fps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-named")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; further columns are ignored).

    component_id is the smallest doc_id reachable over fingerprints that differ in at most radius bits.
    Null and empty texts have fingerprint zero and link like any other; repeated rows give repeated rows;
    a row without doc_id takes part with its fingerprint but names no component (null if no row there has an id);
    an empty table gives no rows.
    """
    found = stored(fingerprints(docs, words), "simhash-fp")
    named = fingerprint_components(found, radius, tile_rows)
    return found.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each group: the first by doc_id, then text hash. Columns as given.

    Rows that repeat a doc_id with other texts are judged by their own texts; of rows equal in doc_id and text one
    stays. Rows without doc_id stay all. Null and empty texts are one group.
    """
    found = stored(fingerprints(docs, words).where("doc_id is not null"), "simhash-fp")
    rows = found.join(fingerprint_components(found, radius), "fp").groupBy("component_id", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = stored(rows, "simhash-rows")
    # a component's first row has the doc_id that names it, so no component's rows are brought together
    first = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.min("th").alias("first"))
    stays = F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("first")), F.lit(False))
    marked = rows.join(first, "doc_id", "left").withColumn("stays", stays).where("not stays or n > 1")
    a, b, c = (unused(docs, x) for x in ("near_id", "near_hash", "near_again"))
    marked = stored(marked.select(F.col("doc_id").alias(a), F.col("th").alias(b), F.col("stays").alias(c)), "simhash-marked")
    key = (F.col("doc_id").cast("long") == F.col(a)) & (F.xxhash64("text") == F.col(b))
    out = docs.join(marked, key, "left_anti")
    if marked.where(F.col(c)).isEmpty():
        return out
    # rows equal in doc_id and text, of which one stays; what else differs in them is picked by its hash
    repeated = docs.join(marked.where(F.col(c)), key, "left_semi")
    names = [F.col(f"`{x}`") for x in docs.columns]
    one = repeated.groupBy("doc_id", "text").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return out.unionByName(one.select("row.*"))
