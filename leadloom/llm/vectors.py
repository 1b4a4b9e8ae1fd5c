"""Embedding near-dedup: an inverted multi-index over vector halves, visited in multi-sequence order, then exact cosines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_labels, stored

#: Bound of the sample that fits the codebooks; every vector is indexed.
SAMPLE_ROWS = 8192
#: Vectors of a cell that the number of codewords aims at, and of a tile at most.
CELL_ROWS, TILE_ROWS = 512, 2048
#: Share of neighbours at any cosine from the threshold up that the cells visited have to hold, on the sample.
TARGET_RECALL = 0.985


def codebook(x, k: int, rounds: int = 12):
    """k codewords of the rows of x by k-means from a spread-out start; deterministic."""
    import numpy as np

    rng = np.random.default_rng(7)
    k = max(1, min(k, len(np.unique(x, axis=0))))
    words = [x[rng.integers(len(x))]]
    far = ((x - words[0]) ** 2).sum(1)
    for _ in range(k - 1):
        words.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
        far = np.minimum(far, ((x - words[-1]) ** 2).sum(1))
    words = np.array(words)
    for _ in range(rounds):
        near = distances(x, words).argmin(1)
        for j in range(k):
            if (near == j).any():
                words[j] = x[near == j].mean(0)
    return words


def scaled(x):
    """Rows times powers of two, so that squares neither vanish nor overflow; cosines stay the same to the bit."""
    import numpy as np

    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def distances(x, words):
    import numpy as np

    return np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * x @ words.T, 0)


def halves(x):
    return x[:, : max(1, x.shape[1] // 2)], x[:, x.shape[1] // 2 :]


def visit(x, books, n: int):
    """The n nearest cells of each row, nearest first: the multi-sequence order of the sums of both halves' distances."""
    import numpy as np

    d = [distances(h, b) for h, b in zip(halves(x), books)]
    k = len(books[0]), len(books[1])
    n = min(n, k[0] * k[1])
    # a cell among the first n has both its codewords among the first n of its half, and (i + 1) * (j + 1) <= n there
    o = [np.argsort(v, axis=1, kind="stable")[:, : min(n, m)] for v, m in zip(d, k)]
    s = [np.take_along_axis(v, w, 1) for v, w in zip(d, o)]
    i, j = np.nonzero((np.arange(o[0].shape[1])[:, None] + 1) * (np.arange(o[1].shape[1])[None, :] + 1) <= n)
    total = s[0][:, i] + s[1][:, j]
    first = np.argsort(total, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(o[0][:, i] * k[1] + o[1][:, j], first, 1)


def fit_index(sample, n_rows: int, threshold: float) -> dict:
    """Codebooks of both halves of unit vectors, and how many cells to visit for TARGET_RECALL.

    Recall is measured on the sample: neighbours at cosines from the threshold to 1, drawn around its vectors,
    count as found if either of the two visits the other's cell.
    """
    import numpy as np

    k = int(max(2, min(256, math.ceil(math.sqrt(n_rows / CELL_ROWS)))))
    books = [codebook(h, k) for h in halves(sample)]
    rng = np.random.default_rng(3)
    a = sample[rng.permutation(len(sample))[:2000]]
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    c = rng.uniform(threshold, 1.0, size=(len(a), 1))
    b = c * a + np.sqrt(1 - c**2) * noise
    cells = len(books[0]) * len(books[1])
    most = min(cells, 64)
    while True:
        va, vb = visit(a, books, most), visit(b, books, most)
        hit = lambda v, own: np.where((v == own[:, None]).any(1), (v == own[:, None]).argmax(1), cells)
        rank = np.sort(np.minimum(hit(va, vb[:, 0]), hit(vb, va[:, 0])))
        need = int(rank[min(len(rank) - 1, math.ceil(TARGET_RECALL * len(rank)))]) + 1
        if need <= most or most == cells:
            return {"books": books, "visits": min(need, cells)}
        most = min(cells, most * 4)


def vector_links(unique: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, root): partial counts of linked vectors, and a smaller vector that rep reaches. unique: rep, label, dim, m, embedding."""
    n = unique.count()
    books = {}
    sample = unique.select("dim", "embedding").orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(SAMPLE_ROWS).collect() if n else []
    import numpy as np

    for dim in {r.dim for r in sample}:
        x = scaled(np.array([r.embedding for r in sample if r.dim == dim], float))
        books[dim] = fit_index(x / np.linalg.norm(x, axis=1, keepdims=True), n, threshold)

    def index(frames):
        import pandas as pd

        for f in frames:
            probes = pd.Series([[0]] * len(f), index=f.index, dtype=object)
            for dim, rows in f.groupby("dim").groups.items():
                if dim in books:  # a length that the sample lacks has one cell
                    x = scaled(np.array(f.loc[rows, "embedding"].tolist(), float))
                    found = visit(x / np.linalg.norm(x, axis=1, keepdims=True), books[dim]["books"], books[dim]["visits"])
                    for r, p in zip(rows, found.tolist()):
                        probes.at[r] = p
            yield f.assign(probes=probes, cell=[p[0] for p in probes])

    kind = dict(unique.dtypes)["embedding"]
    # the cells of a vector come first in the frame's order, so every vector is indexed and asked
    indexed = stored(unique.mapInPandas(index, f"rep long, label string, dim int, m long, embedding {kind}, probes array<int>, cell int"), "vectors-index")
    asks = indexed.withColumn("at", F.explode("probes"))
    sizes = stored(
        indexed.groupBy("label", "dim", F.col("cell").alias("at")).agg(F.count("*").alias("n_in"))
        .join(asks.groupBy("label", "dim", "at").agg(F.count("*").alias("n_ask")), ["label", "dim", "at"])
        .select("label", "dim", "at", F.ceil(F.col("n_in") / TILE_ROWS).cast("int").alias("t_in"), F.ceil(F.col("n_ask") / (8 * TILE_ROWS)).cast("int").alias("t_ask")), "vectors-cells",
    )
    tile = lambda t: F.pmod(F.xxhash64("rep", F.lit(2)), t).cast("int")
    every = lambda t: F.explode(F.sequence(F.lit(0), F.col(t) - 1))
    inside = indexed.withColumn("at", F.col("cell")).join(sizes, ["label", "dim", "at"]).withColumn("i", tile(F.col("t_in"))).withColumn("j", every("t_ask")).withColumn("asks", F.lit(False))
    asking = asks.join(sizes, ["label", "dim", "at"]).withColumn("j", tile(F.col("t_ask"))).withColumn("i", every("t_in")).withColumn("asks", F.lit(True)).withColumn("probes", F.array().cast("array<int>"))
    names = ["label", "dim", "at", "i", "j", "asks", "rep", "m", "embedding", "probes", "cell"]

    def work(f):
        import pandas as pd

        def side(asks):
            s = f[f["asks"] == asks]
            x = scaled(np.array(s["embedding"].tolist(), float).reshape(len(s), -1))
            return s, x, np.sqrt((x**2).sum(1))

        (a, xa, na), (b, xb, nb) = side(True), side(False)
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        ra, rb, ma, mb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["m"].to_numpy(float), b["m"].to_numpy(float)
        cells, cell_of = np.unique(a["cell"].to_numpy(), return_inverse=True)
        asked = np.array([np.isin(cells, p) for p in b["probes"]]).T  # [cell of a, b]: b asks there as well and counts by itself
        reps = np.unique(np.r_[ra, rb])
        ia, ib = np.searchsorted(reps, ra), np.searchsorted(reps, rb)
        count, left, right = np.zeros(len(reps)), [], []
        for s in range(0, len(xa), 2048):
            t = slice(s, s + 2048)
            link = (xa[t] @ xb.T >= threshold * (na[t, None] * nb[None, :])) & (ra[t, None] != rb[None, :])
            np.add.at(count, ia[t], link @ mb)
            np.add.at(count, ib, ma[t] @ (link & ~asked[cell_of[t]]))
            u, v = np.nonzero(link)
            left.append(ia[t][u])
            right.append(ib[v])
        label = local_labels(len(reps), np.concatenate(left), np.concatenate(right))
        on = np.flatnonzero((count > 0) | (label != np.arange(len(reps))))
        return pd.DataFrame({"rep": reps[on], "n": count[on].astype(np.int64), "root": reps[label[on]]})

    return inside.select(*names).union(asking.select(*names)).groupBy("label", "dim", "at", "i", "j").applyInPandas(work, "rep long, n long, root long")


def vector_groups(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors of equal labels and lengths link at a cosine of threshold or more, in double precision. Null, empty
    and zero vectors, vectors with null or non-finite components, and rows without label or vec_id link with
    nothing (component_id is then vec_id). Equal vectors are compared as one and counted each; rows that repeat
    a vec_id are vectors of their own; further columns are ignored; an empty table gives no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", usable.alias("ok")).withColumns(
        {"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")}
    )
    unique = stored(
        rows.where("ok").groupBy("label", "h1", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
        .select("rep", "label", F.size("embedding").alias("dim"), "m", "embedding", "h1", "h2"), "vectors-unique",
    )
    found = stored(vector_links(unique.select("rep", "label", "dim", "m", "embedding"), threshold), "vectors-links")
    comp = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = stored(
        unique.select("rep", "label", "h1", "h2", "m")
        .join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vectors-result",
    )
    keyed = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), "h1", "h2")
    component = F.coalesce("component", "vec_id")
    return keyed.join(per, ["label", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
