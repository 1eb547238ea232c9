"""The k most similar vectors of every vector.

Method: a forest of random-projection trees searched through a shared priority queue
(``forest``), in two storeys. The trunk, TRUNK trees fitted on a sample, cuts a namespace
into cells of about CELL vectors: every vector is a member of its home cell in each trunk
tree, and as a query visits the cells of the first PROBES branches of the queue, one more
for each level of the trunk beyond the second. In a cell TREES trees are grown over all of
its members down to leaves of at most LEAF; a query visits LEAVES leaves of all these trees
in the order of one queue, and the members found there are ranked by their exact cosine.

Scale: one shuffle of the vectors, once per visited cell. Vectors travel as 24-bit
fixed-point numbers, whose cosines are right to about 1e-7, as those of 32-bit floats are.
The planes of the trunk are broadcast: at most MAX_CELLS cells a tree, 4 MB for two trees,
whatever the number of vectors; beyond CELL * MAX_CELLS vectors (268 million a namespace)
the cells grow, to 120,000 members (25 MB) at 1e9. The sample is max(SAMPLE, 32 a cell), at
most 67 MB. A cell costs members x LEAVES x LEAF products, whatever its size. Halves are cut
at the sample's median, so that a cell holds more than twice its share with a probability
below 1e-6. Of more than k + 1 equal vectors only k + 1 are indexed; the others'
neighbours are the first of these by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.forest import Forest, Tree
from docengine.session import partitions_for

DIM = 64
TRUNK, CELL, MAX_CELLS, PROBES = 2, 1 << 15, 1 << 13, 3
TREES, LEAF, LEAVES = 4, 256, 16
SAMPLE = 8192
BROADCAST_ROWS = 5_000
BLOCK = 4096  # queries searched at a time


def usable(records: DataFrame) -> DataFrame:
    """``ns, id, vid, values`` of the usable records: non-empty id, DIM values, none null,
    NaN or infinite and not all zero; per namespace and id the last ``upserted_at`` (of
    several at one time the one with the largest hash). ``vid`` is a 64-bit hash of
    namespace and id. Repeated rows may stay. A null namespace is one of its own."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = records.select(F.coalesce("namespace", F.lit("")).alias("ns"), "id", "values", "upserted_at").where(
        (F.col("id") != "") & (F.size("values") == DIM) & ~F.exists("values", bad) & F.exists("values", lambda x: x != 0)
    )
    rows = rows.withColumn("version", F.struct(F.coalesce("upserted_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.xxhash64("values").alias("h"))).withColumn("vid", F.xxhash64("ns", "id"))
    several = rows.groupBy("vid").agg(F.max("version").alias("last"), F.min("version").alias("first")).where("last <> first").select("vid", "last")
    if several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    return rows.join(several, "vid", "left").where(F.col("last").isNull() | (F.col("version") == F.col("last"))).select("ns", "id", "vid", "values")


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _coded(x: np.ndarray) -> list[bytes]:
    """Rows as 24-bit little-endian numbers, the largest of a row being 2^23 - 1."""
    x = x.astype(np.float64)
    n = np.rint(x * (8388607 / np.abs(x).max(axis=1, keepdims=True))).astype("<i4")
    return list(map(bytes, n.view(np.uint8).reshape(*x.shape, 4)[:, :, :3].reshape(len(x), -1)))


def _decoded(codes: pd.Series) -> np.ndarray:
    b = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1, 3)
    wide = np.zeros((*b.shape[:2], 4), dtype=np.uint8)
    wide[:, :, 1:] = b
    x = (wide.view("<i4")[:, :, 0] >> 8).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _visits(trunks: dict[str, tuple[int, Forest | None, int]]):
    """A row per vector and visited cell: ``cell, vid, home, code``. A trunk is the number
    of its first cell, its forest (none for a single cell) and the probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ns, part in pdf.groupby("ns"):
                first, trunk, probes = trunks[ns]
                x, vid = _unit(part["values"]), part["vid"].to_numpy()
                code = np.array(_coded(x), dtype=object)
                if trunk is None:
                    yield pd.DataFrame({"cell": first, "vid": vid, "home": True, "code": code})
                    continue
                cells = trunk.search(x, probes)
                row = np.repeat(np.arange(len(x)), cells.shape[1])
                home = np.tile(np.arange(cells.shape[1]) < len(trunk.roots), len(x))
                yield pd.DataFrame({"cell": first + cells.ravel(), "vid": vid[row], "home": home, "code": code[row]})

    return run


def _best(x: np.ndarray, own: np.ndarray, members: np.ndarray, forest: Forest, leaves: list[np.ndarray], probes: int, k: int):
    """For queries x (``own`` is a query's place among the members or -1): rows, member
    places and cosines of the k best members of the leaves its search visits."""
    visited = forest.search(x, probes)
    trees = len(forest.roots)
    bound = np.full(len(x), -2.0, dtype=np.float32)

    def by_leaf(some: np.ndarray):
        leaf, row = some.ravel(), np.repeat(np.arange(len(some)), some.shape[1])
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for rows in np.split(order, cuts):
            yield leaves[leaf[rows[0]]], row[rows]

    # the (k + 1)-th best of one leaf bounds the k-th best of all from below; one may be the query itself
    for some, rows in by_leaf(visited[:, :trees]):
        if len(some) > k:
            s = x[rows] @ members[some].T
            bound[rows] = np.maximum(bound[rows], np.partition(s, len(some) - k - 1, axis=1)[:, len(some) - k - 1])
    bound -= 1e-5  # the same product may differ in its last bits in another block
    found = []
    for some, rows in by_leaf(visited):
        s = x[rows] @ members[some].T
        i, j = np.nonzero(s >= bound[rows, None])
        r, m = rows[i], some[j]
        other = own[r] != m
        found.append((r[other], m[other], s[i, j][other]))
    row, col, sim = map(np.concatenate, zip(*found, strict=True))
    _, one = np.unique(row * len(members) + col, return_index=True)  # a member stands in a leaf of every tree
    row, col, sim = row[one], col[one], sim[one]
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], sim[keep]


def rank_cell(x: np.ndarray, home: np.ndarray, k: int, trees: int = TREES, leaf: int = LEAF, probes: int = LEAVES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of all rows of x among its home rows: row, home row, cosine."""
    at = np.flatnonzero(home)
    members = np.ascontiguousarray(x[at])
    grown = [Tree(members, leaf, np.random.default_rng(t)) for t in range(trees)]
    forest, leaves = Forest(grown), [rows for t in grown for rows in t.leaves]
    own = np.where(home, np.cumsum(home) - 1, -1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for a in range(0, len(x) if len(at) else 0, BLOCK):
        row, col, sim = _best(x[a : a + BLOCK], own[a : a + BLOCK], members, forest, leaves, probes, k)
        out.append((row + a, at[col], sim))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _ranked(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vid", "home"], ascending=[True, False]).drop_duplicates("vid")
        vid = pdf["vid"].to_numpy()
        row, other, sim = rank_cell(_decoded(pdf["code"]), pdf["home"].to_numpy(dtype=bool), k)
        return pd.DataFrame({"q": vid[row], "n": vid[other], "s": sim})

    return run


def _trunks(vectors: DataFrame, sizes: dict[str, int]) -> dict[str, tuple[int, Forest | None, int]]:
    cells = {ns: min(MAX_CELLS, -(-n // CELL)) for ns, n in sizes.items()}
    rate = {ns: max(1, sizes[ns] // max(SAMPLE, 32 * c)) for ns, c in cells.items() if c > 1}
    sample = {}
    if rate:
        every = F.create_map(*[F.lit(v) for pair in rate.items() for v in pair])
        rows = vectors.where(F.col("ns").isin(*rate)).where(F.pmod("vid", F.element_at(every, F.col("ns"))) == 0)
        sample = dict(list(rows.select("ns", "values").toPandas().groupby("ns")))
    out, first = {}, 0
    for ns in sorted(sizes):
        trunk, probes = None, 1
        if ns in sample:
            x = _unit(sample[ns]["values"])
            trunk = Forest([Tree(x, -(-len(x) // cells[ns]), np.random.default_rng(t)) for t in range(TRUNK)])
            probes = PROBES + max(0, int(np.ceil(np.log2(cells[ns]))) - 2)
        out[ns] = (first, trunk, probes)
        first += trunk.count if trunk else 1
    return out


def nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest of each vector within its namespace: ``q, n, s, rank`` (vids, cosine).

    vectors: ``ns, id, vid, values`` as from ``usable``. Fewer than k others give fewer
    rows; ties go to the smaller vid. Equal vectors in excess of k + 1 get k of the
    indexed ones.
    """
    spark = vectors.sparkSession
    vectors = vectors.withColumn("h", F.xxhash64("ns", "values"))
    sizes = {r["ns"]: r["n"] for r in vectors.groupBy("ns").agg(F.count("*").alias("n")).collect()}
    schema = "q long, n long, s float, rank int"
    if not sizes:
        return spark.createDataFrame([], schema)
    crowded = vectors.groupBy("h").agg(F.approx_count_distinct("vid").alias("m"), F.count("*").alias("rows")).where(F.col("rows") > k + 1).select("h")
    crowds = crowded.limit(BROADCAST_ROWS + 1).count()
    spare = None
    if crowds:
        if crowds <= BROADCAST_ROWS:
            crowded = F.broadcast(crowded)
        rank = F.row_number().over(Window.partitionBy("h").orderBy("vid"))
        first = vectors.select("h", "vid").join(crowded, "h", "left_semi").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
        kept = first.groupBy("h").agg(F.sort_array(F.collect_list("vid")).alias("kept"))
        crowd = vectors.select("h", "vid").join(kept, "h")
        spare = (
            crowd.where(~F.array_contains("kept", F.col("vid")))
            .select(F.col("vid").alias("q"), F.explode(F.slice("kept", 1, k)).alias("n"), F.lit(1.0).cast("float").alias("s"))
            .distinct()
        )
        vectors = vectors.join(kept, "h", "left").where(F.col("kept").isNull() | F.array_contains("kept", F.col("vid")))
    trunks = _trunks(vectors, sizes)
    visits = vectors.select("ns", "vid", "values").mapInPandas(_visits(trunks), "cell long, vid long, home boolean, code binary")
    # a cell is much work for few bytes: as many partitions as cells, which are not put together
    found = visits.repartition(partitions_for(spark, 1 + max(first + (trunk.count if trunk else 1) for first, trunk, _ in trunks.values()), 1), "cell").groupBy("cell").applyInPandas(lambda pdf: _ranked(k)(pdf), "q long, n long, s float")
    if spare is not None:
        found = found.unionByName(spare)
    pairs = found.repartition("q").groupBy("q", "n").agg(F.max("s").alias("s"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))).where(F.col("rank") <= k)


def neighbour_pairs(records: DataFrame, k: int = 5) -> DataFrame:
    """``id_a, id_b`` with a < b: one is among the k nearest of the other. No repeats."""
    vectors = usable(records)
    links = nearest(vectors, k).select(F.least("q", "n").alias("x"), F.greatest("q", "n").alias("y")).distinct()
    names = vectors.select("vid", "id").distinct()
    named = links.join(names.select(F.col("vid").alias("x"), F.col("id").alias("p")), "x").join(names.select(F.col("vid").alias("y"), F.col("id").alias("q")), "y")
    return named.where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()
