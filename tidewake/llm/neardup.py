"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.scratch import saved
from tidewake.operators.components import components

#: The index is fitted on about so many vectors (all, if there are fewer); every vector is indexed.
SAMPLE = 8192
#: Dimensions per subspace, codes per subspace, most lists, most vectors in a block.
SUBSPACE, CODES, MOST_LISTS, BLOCK = 4, 256, 1024, 4096
#: Queries and members of two blocks that are compared at a time.
_QUERIES, _MEMBERS = 512, 1024
#: Bytes of candidates' vectors that are gathered at a time for their cosines.
_RERANK_BYTES = 64_000_000


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (centres * centres).sum(1) / 2 - x @ centres.T
        near = own.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclasses.dataclass
class Index:
    """Coarse centres and one codebook per subspace of the residuals; its size does not depend on the data's."""

    centres: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x SUBSPACE

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 11) -> Index:
        rng, width = np.random.default_rng(seed), -(-x.shape[1] // SUBSPACE) * SUBSPACE
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        centres = _kmeans(x, lists, 8, rng)
        rest = x - centres[((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)]
        books = [_kmeans(rest[:, m : m + SUBSPACE], CODES, 6, rng) for m in range(0, width, SUBSPACE)]
        return cls(centres, np.stack(books))

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code per subspace) of unit vectors."""
        x = self.padded(x)
        at = self.distances(x).argmin(1)
        rest = x - self.centres[at]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            codes[:, m] = ((book * book).sum(1) / 2 - rest[:, m * SUBSPACE : (m + 1) * SUBSPACE] @ book.T).argmin(1)
        return at, codes

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - x.shape[1])))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres."""
        return (x * x).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * x @ self.centres.T

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius`` of each row (padded): a sufficient set.

        A member y of list j is no nearer to the row's own centre i than to j.  |z-j|^2 - |z-i|^2 is linear in z with slope
        2|i-j|, so within the radius it is at most 2 * radius * |i-j| at the row.
        """
        d = self.distances(x)
        own = d.argmin(1)
        return d - d[np.arange(len(x)), own][:, None] <= 2 * radius * self.apart[own] + 1e-6

    @functools.cached_property
    def apart(self) -> np.ndarray:
        """Distances between centres."""
        return np.sqrt(np.maximum(0, self.distances(self.centres)))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of each code with each row's parts: subspaces x codes x rows, so that a code's entries are adjacent."""
        return np.stack([book @ x[:, m * SUBSPACE : (m + 1) * SUBSPACE].T for m, book in enumerate(self.books)]).astype(np.float32)


def _unit(raw: bytes, dtype: str, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _found(index: Index, a: dict, b: dict, same: bool, threshold: float):
    """(i, j) of rows of block a and of block b whose cosine is ``threshold`` or more, in pieces; each pair once.

    Rows of ``a`` are the queries.  Asymmetric distances come from their tables and b's codes; a vector is at most its own
    quantisation error nearer than its code, so nothing within the radius is passed over.  Candidates are reranked by
    their cosine in double precision.
    """
    radius = float(np.sqrt(2 - 2 * threshold))
    xa, xb = index.padded(a["x"]), index.padded(b["x"])
    rough = index.decoded(b["codes"])
    error = np.linalg.norm(xb - index.centres[b["list"]] - rough, axis=1)
    fixed = ((rough * rough).sum(1) + 2 * (index.centres[b["list"]] * rough).sum(1)).astype(np.float32)
    reach = ((radius + error) ** 2 + 1e-3).astype(np.float32)
    order, by_list = np.argsort(a["list"], kind="stable"), np.argsort(b["list"], kind="stable")  # neighbours probe alike
    for at in range(0, len(xa), _QUERIES):
        mine = order[at : at + _QUERIES]
        q = xa[mine]
        near, probed, tables = index.distances(q).T.astype(np.float32), index.probes(q, radius).any(0), index.tables(2 * q)
        theirs = by_list[probed[b["list"][by_list]]]
        for i in range(0, len(theirs), _MEMBERS):
            members = theirs[i : i + _MEMBERS]
            far, entry = near[b["list"][members]], np.empty((len(members), len(q)), np.float32)
            far += (fixed[members] - reach[members])[:, None]
            for m, table in enumerate(tables):
                far -= table.take(b["codes"][members, m], axis=0, out=entry, mode="clip")
            c, r = np.nonzero(far <= 0)
            r, c = mine[r], members[c]
            if same:
                r, c = r[r < c], c[r < c]
            step = max(1, _RERANK_BYTES // (16 * xa.shape[1]))
            for k in range(0, len(r), step):
                some, others = r[k : k + step], c[k : k + step]
                hit = np.einsum("ij,ij->i", xa[some], xb[others]) >= threshold
                yield some[hit], others[hit]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in pairs:
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _links(vectors: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """``vectors(node, n, raw)`` of one dimension → ``(node, links, root)``, several rows per node that has links."""
    spark, kind = vectors.sparkSession, "<f8"
    share = min(1.0, SAMPLE / n)
    picked = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < share * 1_000_000).select("raw").toPandas()["raw"]
    sample = _unit(b"".join(picked), kind, dim) if len(picked) else _unit(vectors.first()["raw"], kind, dim)
    index = Index.fit(sample, max(1, min(MOST_LISTS, round(n**0.5), len(sample))))
    shared = spark.sparkContext.broadcast(index)

    def indexed(it):
        for batch in it:
            x = _unit(b"".join(batch.column(2).to_pylist()), kind, dim) if batch.num_rows else np.zeros((0, dim))
            at, codes = shared.value.add(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "n", "raw", "list", "codes"])

    rows = saved(vectors.select("node", "n", "raw").mapInArrow(indexed, "node long, n long, raw binary, list long, codes binary"), "index")
    # lists are cut into blocks of about BLOCK vectors, small lists share one
    sizes = rows.groupBy("list").agg(F.count("*").alias("size")).orderBy("list").collect()  # MOST_LISTS rows
    first, place, held = {}, 0, 0
    for r in sizes:
        if held and held + r["size"] > BLOCK:
            place, held = place + 1, 0
        parts = -(-r["size"] // BLOCK)
        first[r["list"]] = (place, parts)
        place, held = (place + parts, 0) if parts > 1 else (place, held + r["size"])
    blocks_of = spark.createDataFrame([(k, *v) for k, v in first.items()], "list long, first long, parts long")
    numbered = rows.join(F.broadcast(blocks_of), "list").withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")))
    packed_ddl = "block long, nodes binary, ns binary, lists binary, codes binary, raw binary"

    def pack(table: pa.Table) -> pa.Table:
        ints = lambda c: table.column(c).to_numpy().astype("<i8").tobytes()
        return pa.table({"block": [table.column("block")[0].as_py()], "nodes": [ints("node")], "ns": [ints("n")], "lists": [ints("list")], "codes": [b"".join(table.column("codes").to_pylist())], "raw": [b"".join(table.column("raw").to_pylist())]}, pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("nodes", "ns", "lists", "codes", "raw"))]))

    blocks = saved(numbered.groupBy("block").applyInArrow(pack, packed_ddl), "blocks")

    def unpack(row: dict, at: str) -> dict:
        ints = lambda c: np.frombuffer(row[at + c], "<i8")
        nodes = ints("nodes")
        return {"nodes": nodes, "n": ints("ns"), "list": ints("lists"), "codes": np.frombuffer(row[at + "codes"], np.uint8).reshape(len(nodes), -1), "x": _unit(row[at + "raw"], kind, dim)}

    total = max((p + c for p, c in first.values()), default=1)
    spans = {j: range(p, p + c) for j, (p, c) in first.items()}
    spans_shared = spark.sparkContext.broadcast(spans)

    def partners(it):
        """Blocks that each block's rows must look into, of either order of two blocks the one nearer around the circle."""
        radius = float(np.sqrt(2 - 2 * threshold))
        for batch in it:
            for row in batch.to_pylist():
                me, x = row["block"], shared.value.padded(_unit(row["raw"], kind, dim))
                lists = np.flatnonzero(np.any([shared.value.probes(x[i : i + _QUERIES], radius).any(0) for i in range(0, len(x), _QUERIES)], axis=0))
                others = sorted({o for j in lists.tolist() for o in spans_shared.value.get(j, ()) if ((o - me) % total, me) <= ((me - o) % total, o)})
                yield pa.RecordBatch.from_arrays([pa.array([me] * len(others), pa.int64()), pa.array(others, pa.int64())], ["block", "other"])

    pairs = blocks.select("block", "raw").mapInArrow(partners, "block long, other long")
    right = blocks.select(F.col("block").alias("other"), *[F.col(c).alias("o_" + c) for c in ("nodes", "ns", "lists", "codes", "raw")])

    def compared(it):
        for batch in it:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                a, b, same = unpack(row, ""), unpack(row, "o_"), row["block"] == row["other"]
                shift = 0 if same else len(a["nodes"])
                nodes, ns = (a["nodes"], a["n"]) if same else (np.concatenate([a["nodes"], b["nodes"]]), np.concatenate([a["n"], b["n"]]))
                links, kept = np.zeros(len(nodes), np.int64), []
                for r, c in _found(shared.value, a, b, same, threshold):
                    c = c + shift
                    np.add.at(links, r, ns[c])
                    np.add.at(links, c, ns[r])
                    kept.append((r.astype(np.int32), c.astype(np.int32)))
                hit = np.flatnonzero(links)
                root = _roots(len(nodes), kept)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(nodes[root[hit]])], ["node", "links", "root"])

    return pairs.join(blocks, "block").join(right, "other").mapInArrow(compared, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: links are pairs of rows with cosine ``threshold`` or more.

    * Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing; neither do vectors
      of different dimensions.  Their component is their own id.
    * NULL vec_id: no links, component NULL, not kept.
    * Repeated vec_ids give a row each; ``n_links`` counts other rows, and a component joins all vectors of one id.
    * Equal vectors are one node of the index, so a group of copies is never expanded.  Empty table: no rows.

    Lists that are probed are a proven superset of those that can hold a link, and table distances are widened by each
    vector's quantisation error, so the links are those of brute force.
    """
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    big = F.lit(float("inf"))
    fine = F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != big)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(fine, F.lit(False)).alias("fine"))
    able = rows.where(F.col("fine") & F.col("vec_id").isNotNull())

    def packed(it):
        for batch in it:
            raw = [np.array(v, "<f8") for v in batch.column(0).to_pylist()]
            raw = [v / s if 0 < (s := np.abs(v).max()) and not 1e-100 < s < 1e100 else v for v in raw]  # squares must not overflow
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in raw], pa.binary())], ["x", "least", "n", "node", "raw"])

    nodes = able.groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct")
    nodes = saved(nodes.mapInArrow(packed, "x array<double>, least long, n long, node long, raw binary"), "nodes")
    found = None
    for dim, n in nodes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect():
        part = _links(nodes.where(F.size("x") == dim), dim, n, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        spark = vectors.sparkSession
        found = spark.createDataFrame([], "node long, links long, root long")
    found = saved(found, "links")
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.select("node", "x", "least", "n").join(linked, "node", "left").join(classes, "node", "left").select("node", "x", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    whole = saved(whole, "whole")
    lowest = whole.groupBy("class").agg(F.min("least").alias("component_id"))
    known = able.select("vec_id", "x").join(whole.join(lowest, "class").select("x", "n_links", "component_id"), "x").select("vec_id", "n_links", "component_id")
    repeats = able.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    if not repeats.isEmpty():
        known = saved(known, "known")
        merged = components(known.join(repeats, "vec_id", "left_semi").select(F.col("vec_id").alias("u"), F.col("component_id").alias("v")))
        known = known.join(merged, known.component_id == merged.node, "left").select("vec_id", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    alone = rows.where(~(F.col("fine") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
