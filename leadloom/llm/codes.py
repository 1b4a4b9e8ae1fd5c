"""Vector code compression: product codes with integer codebooks, assigned by a depth-first walk of a trie of parts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_field

#: Equal consecutive parts of a vector, entries of a codebook, and rounds of assigning and averaging.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Nodes of the trie that are expanded at once; the walk holds at most so many rows of distances a level.
BLOCK = 1024
#: Components of at most so many bits and parts of at most so many of them have squared distances within 64 bits.
_SAFE_BITS, _SAFE_LENGTH = 26, 1 << 9


def walk(parts, entries):
    """(entry, distance) of each row of parts: the nearest row of entries by squared distance, ties to the smaller index.

    parts are distinct and in lexicographic order, so each node of their trie is a range of rows. The walk goes depth
    first: a node's distances to all entries, summed over its prefix, are computed once and handed to its children;
    siblings are expanded together, in blocks. Leaves take the argmin. All integers; wide ones as Python's own.
    """
    import numpy as np

    n, length = parts.shape
    if max((abs(int(f(v))) for v in (parts, entries) if v.size for f in (np.min, np.max)), default=0) >> _SAFE_BITS or length > _SAFE_LENGTH:
        parts, entries = parts.astype(object), entries.astype(object)
    code, distance = np.zeros(n, np.int64), np.zeros(n, entries.dtype)
    # differs[i]: the first dimension in which row i differs from the row before
    differs = np.zeros(n, np.int64)
    if n > 1 and length:
        differs[1:] = (parts[1:] != parts[:-1]).argmax(1)
    root = np.zeros((1, len(entries)), entries.dtype)
    stack = [(0, np.array([0]), np.array([n]), root)] if n else []
    while stack:
        depth, lo, hi, sums = stack.pop()
        if depth == length:
            best = sums.argmin(1)
            code[lo], distance[lo] = best, sums[np.arange(len(lo)), best]
            continue
        first, last = int(lo[0]), int(hi[-1])  # siblings of a block stand side by side
        cut = differs[first:last] <= depth
        cut[lo - first] = True
        starts = np.flatnonzero(cut) + first
        ends = np.append(starts[1:], last)
        parent = np.searchsorted(lo, starts, side="right") - 1
        for k in reversed(range(0, len(starts), BLOCK)):
            at = slice(k, k + BLOCK)
            step = parts[starts[at], depth][:, None] - entries[None, :, depth]
            stack.append((depth + 1, starts[at], ends[at], sums[parent[at]] + step * step))
    return code, distance


def _nearest(x, books):
    """For each position: the distinct parts of x's rows in order, their counts, (entry, distance), and each row's place."""
    import numpy as np

    w = x.shape[1] // len(books)
    for p, entries in enumerate(books):
        part = x[:, p * w : (p + 1) * w]
        order = np.lexsort(part.T[::-1]) if w else np.arange(len(part))
        part = part[order]
        new = np.r_[True, (part[1:] != part[:-1]).any(1)] if len(part) else np.zeros(0, bool)
        place = np.empty(len(part), np.int64)
        place[order] = np.cumsum(new) - 1
        yield part[new], np.diff(np.append(np.flatnonzero(new), len(part))), walk(part[new], entries), place


def _rows(column, length: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _means(kept: DataFrame, books, length: int) -> list:
    """(pos, entry, n, sums) of all parts by their nearest entry: a task adds up its own first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        for b in batches:
            for p, (part, count, (entry, _), _) in enumerate(_nearest(_rows(b.column(0), length), books)):
                np.add.at(n[p], entry, count)
                weighted = part.astype(object if len(part) and max(-int(part.min(initial=0)), int(part.max(initial=0))) >> _SAFE_BITS else np.int64) * count[:, None]
                some = np.zeros(books[p].shape, weighted.dtype)
                np.add.at(some, entry, weighted)
                total[p] += some
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(n[p]).tolist()]
        yield pa.record_batch(
            [
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(n[p][e]) for p, e in used], pa.int64()),
                pa.array([[Decimal(int(v)) for v in total[p][e]] for p, e in used], pa.list_(pa.decimal128(38, 0))),
            ],
            names=["pos", "entry", "n", "sums"],
        )

    sums = kept.select("x").mapInArrow(run, "pos int, entry int, n long, sums array<decimal(38,0)>")
    one = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(length // len(books))]
    return sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *one).collect()


def _coded(kept: DataFrame, books, length: int) -> DataFrame:
    names = [c for c in kept.columns if c != "x"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = _rows(b.column(b.schema.get_field_index("x")), length)
            codes, error = np.zeros((len(x), len(books)), np.int32), np.zeros(len(x), object)
            for p, (_, _, (entry, distance), place) in enumerate(_nearest(x, books)):
                codes[:, p] = entry[place]
                error += distance[place].astype(object)
            error = pa.array([Decimal(int(e)) if e < 10**38 else None for e in error], pa.decimal128(38, 0))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(books), pa.int32()), pa.array(codes.ravel()))
            yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in names], codes, error], names=[*names, "code", "error"])

    out = kept.select(*names, F.lit(None).cast("array<int>").alias("code"))
    return kept.mapInArrow(run, with_field(out, "error", "decimal(38,0)"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """((vec_id, label, code, error), codebooks): codes as arrays of entry indexes in part order, errors as decimals.

    vectors (vec_id, embedding, label) become integers floor(256 * x), cut into equal consecutive parts. Each task sorts the
    distinct parts of a batch and walks their trie, so no vector is shuffled and copies of a part cost one leaf;
    only sums by codebook entry leave the tasks, parts * entries rows a task, and reach the driver added up.

    Rows are left out whose vector is null or holds null or non-finite components, or any that as an integer does not fit
    64 bits (2^55 and above). The length is the commonest one (ties: the smaller); rows of another length are left out, and zeros
    behind make it a multiple of parts. Repeated rows count and are coded each; rows of one vec_id start codebooks in the order of
    their vectors, a null vec_id comes last. With fewer vectors than entries, codebooks are smaller; with none there are
    no rows and no codebooks. An error of 39 digits and more is null.
    """
    import numpy as np

    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**55), F.lit(False)))
    whole = F.when(finite, F.transform(x, lambda v: F.floor(v.cast("double") * 256)))
    named = vectors.select("vec_id", "label", whole.alias("x")).where("x is not null")
    common = named.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = common.size if common else 0
    length = -(-size // parts) * parts
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), length - size)) if length > size else F.col("x")
    kept = stored(named.where(F.size("x") == size).select("vec_id", "label", padded.alias("x")), "codes-vectors")
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    first = np.array([r.x for r in start], np.int64).reshape(len(start), length)
    books = list(first.reshape(len(start), parts, length // parts).transpose(1, 0, 2)) if start else []
    for _ in range(rounds if start and length else 0):
        books = [b.copy() for b in books]
        for r in _means(kept, books, length):
            books[r.pos][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(length // parts)]
    return _coded(kept, books, length), books
