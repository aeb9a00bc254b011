"""Embedding near-dedup by an epsilon grid order join.

Cosine of at least `similarity` is a distance of at most epsilon between vectors of length one. These are projected on leading
principal dimensions, which are cut into cells of width epsilon, and sorted by label and cell: vectors of one grid cell stand
together, and what is near in the first dimensions is near in the order. The sorted sequence is dealt over the tasks by range and
cut into blocks, each with its bounding box; intervals of blocks have boxes of their own, in a tree. The join goes down that
tree: a pair of sequence intervals whose boxes are farther apart than epsilon is dropped, any other gives the pairs of its parts,
until blocks are left. Projections never lengthen a distance, so no pair within epsilon is lost, whatever the dimensions are;
they may thus come from a bounded sample (SAMPLE vectors by hash). A pair of blocks is then compared by centres and radii, which
may prove it all far or all near, and else by a matrix product in double precision.

Equal vectors of a label are one class with a count before all this (told by 128 bits of hash), so copies are neither compared
nor paired. A pair of blocks gives the number of links of each class and a spanning forest of them, never the links themselves.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and vectors with a null label link
with nothing; only vectors of one length are compared; rows that repeat an id are rows of their own and count as links of each
other if their vectors are near; a row with a null id is compared like any other, its component is the least id that it reaches,
null if there is none; extra columns are not read, so no name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, drop
from .simhash import components

SIMILARITY, LABEL = 0.98, "label"
#: Principal dimensions of the grid, vectors that they are fitted on at most, vectors and bytes of a block, parts of an interval.
DIMS, SAMPLE, BLOCK, BLOCK_BYTES, FAN = 6, 2048, 1024, 1 << 21, 16
#: Distances this much over epsilon are still compared, cosines this near to the limit are computed again from the vectors given.
MARGIN, TIE = 1e-6, 1e-9
BOX = [f"{side}{k}" for side in ("lo", "hi") for k in range(DIMS)]
NODE_BITS = 20


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, also where squares would not fit a double."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def principal(vectors: list[np.ndarray], dims: int = DIMS) -> dict[int, np.ndarray]:
    """Orthonormal columns by vector length: the leading principal dimensions of these vectors."""
    out = {}
    for n in {len(v) for v in vectors}:
        rows = unit(np.array([v for v in vectors if len(v) == n], float))
        _, axes = np.linalg.eigh(np.cov(rows.T).reshape(n, n) if len(rows) > 1 else np.eye(n))
        out[n] = np.ascontiguousarray(axes[:, ::-1][:, :dims])
    return out


def projected(rows: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """DIMS coordinates of unit rows; lengths without principal dimensions take the first components."""
    n = rows.shape[1]
    at = rows @ axes.get(n, np.eye(n, min(n, DIMS)))
    return np.pad(at, ((0, 0), (0, DIMS - at.shape[1])))


def _matrices(column: pa.Array):
    """(rows, matrix) of a list<double> column, by length of the lists."""
    starts = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(starts)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


def classes(df: DataFrame) -> DataFrame:
    """(label, k1, k2, v, rep, copies) of distinct vectors; rep is their least id."""
    return df.where("ok").groupBy("label", "k1", "k2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies"))


def grid_order(distinct: DataFrame, epsilon: float) -> DataFrame:
    """Classes in the order of label, length and grid cell, dealt by range; a cell of any size can be split."""
    axes = principal([np.array(r.v) for r in distinct.select("v").orderBy(F.xxhash64("v"), "k1", "k2").limit(SAMPLE).collect()])
    shared = distinct.sparkSession.sparkContext.broadcast(axes)

    def cells(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, DIMS), np.int32)
            for at, rows in _matrices(batch.column("v")):
                out[at] = np.floor(projected(unit(rows), shared.value) / epsilon)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), DIMS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cell"])

    label = distinct.schema["label"].dataType.simpleString()
    placed = distinct.mapInArrow(cells, f"label {label}, k1 bigint, k2 bigint, v array<double>, rep bigint, copies bigint, cell array<int>")
    order = ["label", F.size("v"), "cell", "k1", "k2"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order), shared


def blocks(ordered: DataFrame, axes) -> DataFrame:
    """Rows of kind 0, the blocks: (label, size, pid, idx, box, packed vectors and counts), and of kind 1, their classes."""
    label = ordered.schema["label"].dataType.simpleString()
    boxes = ", ".join(f"{b} double" for b in BOX)
    schema = f"label {label}, size int, pid int, idx bigint, {boxes}, pack binary, counts binary, node bigint, k1 bigint, k2 bigint, rep bigint, copies bigint, kind int"
    names = [c.split()[0] for c in schema.split(", ")]

    def out(like, rows: list[dict]) -> pa.RecordBatch:
        types = {"label": like, "size": pa.int32(), "pid": pa.int32(), "kind": pa.int32(), "pack": pa.binary(), "counts": pa.binary()} | dict.fromkeys(BOX, pa.float64())
        return pa.record_batch([pa.array([r.get(c) for r in rows], types.get(c, pa.int64())) for c in names], names)

    def work(batches):
        pid, idx, held = TaskContext.get().partitionId(), 0, []
        like = pa.int32()

        def block() -> list[dict]:
            nonlocal idx
            rows = np.array([r["v"] for r in held], float)
            at = projected(unit(rows), axes.value)
            where = {"label": held[0]["label"], "size": rows.shape[1], "pid": pid}
            first = (pid << 42) + (idx << NODE_BITS)
            made = [where | dict(zip(BOX, [*at.min(0).tolist(), *at.max(0).tolist()], strict=True)) | {"idx": idx, "kind": 0, "node": first, "pack": rows.tobytes(), "counts": np.array([r["copies"] for r in held], np.int64).tobytes()}]
            made += [{"label": r["label"], "node": first + k, "k1": r["k1"], "k2": r["k2"], "rep": r["rep"], "copies": r["copies"], "kind": 1} for k, r in enumerate(held)]
            idx += 1
            return made

        for batch in batches:
            like = batch.schema.field("label").type
            for r in batch.to_pylist():
                if held and ((held[0]["label"], len(held[0]["v"])) != (r["label"], len(r["v"])) or len(held) >= max(16, min(BLOCK, BLOCK_BYTES // (8 * len(r["v"]))))):
                    yield out(like, block())
                    held = []
                held.append(r)
        if held:
            yield out(like, block())

    return ordered.select("label", "v", "k1", "k2", "rep", "copies").mapInArrow(work, schema)


def _apart(a: str, b: str) -> Column:
    """Squared distance of two bounding boxes."""
    gap = lambda k: F.greatest(F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.lit(0.0))
    return sum((gap(k) * gap(k) for k in range(1, DIMS)), gap(0) * gap(0))


def near_blocks(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(pid_a, idx_a, pid_b, idx_b) of the pairs of blocks, a <= b, whose boxes are within epsilon: a join of sequence intervals
    that goes down from one interval for each label and length."""
    own = ["label", "size", "pid", "idx", *BOX]
    levels = [boxes.select(*own)]
    for part in ("idx", "pid"):
        while levels[-1].agg(F.max(part)).first()[0]:
            up = (F.col("pid"), F.floor(F.col("idx") / FAN)) if part == "idx" else (F.floor(F.col("pid") / FAN).cast("int"), F.lit(0).cast("bigint"))
            level = levels[-1].groupBy("label", "size", up[0].alias("pid"), up[1].alias("idx")).agg(*((F.max if b.startswith("hi") else F.min)(b).alias(b) for b in BOX))
            levels[-1] = levels[-1].withColumns({"up_pid": up[0], "up_idx": up[1]})
            levels.append(cut(level, "intervals"))
    top = levels.pop()
    pairs = top.select(*(F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("pid", "idx")), "label", "size")
    limit = (epsilon + MARGIN) ** 2
    for level in reversed(levels):
        a, b = (level.select(*(F.col(c).alias(f"{s}_{c}") for c in ("label", "size", "up_pid", "up_idx")), F.struct(*own).alias(s)) for s in ("a", "b"))
        near = pairs.join(a, (F.col("label") == F.col("a_label")) & (F.col("size") == F.col("a_size")) & (F.col("pid_a") == F.col("a_up_pid")) & (F.col("idx_a") == F.col("a_up_idx")))
        near = near.join(b, (F.col("label") == F.col("b_label")) & (F.col("size") == F.col("b_size")) & (F.col("pid_b") == F.col("b_up_pid")) & (F.col("idx_b") == F.col("b_up_idx")))
        same = (F.col("pid_a") == F.col("pid_b")) & (F.col("idx_a") == F.col("idx_b"))
        near = near.where((~same | (F.struct("a.pid", "a.idx") <= F.struct("b.pid", "b.idx"))) & (_apart("a", "b") <= limit))
        pairs = cut(near.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("pid", "idx")), F.col("a.label").alias("label"), F.col("a.size").alias("size")), "near-blocks")
    return pairs


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y) / math.sqrt(float(x @ x) * float(y @ y))


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray | None:
    """Which rows of two blocks have a cosine of `similarity` or more; None if centres and radii prove that none has."""
    x, y = unit(a), unit(b)
    c, d = x.mean(0), y.mean(0)
    r, s = (math.sqrt(((z - m) ** 2).sum(1).max()) for z, m in ((x, c), (y, d)))
    apart, epsilon = math.sqrt(((c - d) ** 2).sum()), math.sqrt(2 - 2 * similarity)
    if apart - r - s > epsilon + MARGIN:
        return None
    if apart + r + s < epsilon - MARGIN:
        return np.ones((len(a), len(b)), bool)
    cosines = x @ y.T
    out = cosines >= similarity
    for i, j in np.argwhere(np.abs(cosines - similarity) < TIE).tolist():
        out[i, j] = cosine(a[i], b[j]) >= similarity
    return out


def star_forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of the connected parts that links between nodes a and b make; parts of one node are left out."""
    far = np.iinfo(np.int64).max
    top, side = a.copy(), b.copy()
    rows, cols = links.any(1), links.any(0)
    part = links[np.ix_(rows, cols)]
    x, y = top[rows], side[cols]
    if np.array_equal(a, b):  # a block with itself: both sides are the same nodes
        while True:
            new = np.minimum(x, np.where(part, x[None], far).min(1)) if len(x) else x
            if np.array_equal(new, x):
                break
            x = new
        keep = a[rows] != x
        return a[rows][keep], x[keep]
    while len(x):
        new = np.minimum(x, np.where(part, y[None], far).min(1))
        other = np.minimum(y, np.where(part, new[:, None], far).min(0))
        if np.array_equal(new, x) and np.array_equal(other, y):
            break
        x, y = new, other
    nodes, roots = np.r_[a[rows], b[cols]], np.r_[x, y]
    return nodes[nodes != roots], roots[nodes != roots]


def block_links(pairs: DataFrame, packs: DataFrame, similarity: float) -> DataFrame:
    """(node, links, root): links that a pair of blocks adds to a class, counted in rows, and a star for each connected part."""

    def work(batches):
        for batch in batches:
            nodes, counts, roots = [], [], []
            for size, a, b, m, n, at, to in zip(*(batch.column(k) for k in range(7)), strict=True):
                size, first, second = size.as_py(), at.as_py(), to.as_py()
                x, y = (np.frombuffer(p.as_buffer(), np.float64).reshape(-1, size) for p in (a, b))
                links = linked(x, y, similarity)
                if links is None:
                    continue
                left, right = first + np.arange(len(x)), second + np.arange(len(y))
                w, v = (np.frombuffer(c.as_buffer(), np.int64) for c in (m, n))
                if first == second:
                    links[np.arange(len(x)), np.arange(len(x))] = False
                sides = [(left, links @ v)] if first == second else [(left, links @ v), (right, links.T @ w)]
                for node, count in sides:
                    nodes.append(node[count > 0])
                    counts.append(count[count > 0])
                    roots.append(np.full(len(nodes[-1]), -1))
                node, root = star_forest(links, left, right)
                nodes.append(node)
                counts.append(np.zeros(len(node), np.int64))
                roots.append(root)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, counts, roots)]
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in flat], ["node", "links", "root"])

    side = lambda s: packs.select(F.col("pid").alias(f"pid_{s}"), F.col("idx").alias(f"idx_{s}"), F.col("pack").alias(f"pack_{s}"), F.col("counts").alias(f"counts_{s}"), F.col("node").alias(f"node_{s}"))
    both = pairs.select("size", "pid_a", "idx_a", "pid_b", "idx_b").join(side("a"), ["pid_a", "idx_a"]).join(side("b"), ["pid_b", "idx_b"])
    return both.select("size", "pack_a", "pack_b", "counts_a", "counts_b", "node_a", "node_b").mapInArrow(work, "node bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = LABEL, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row: links of cosine >= similarity to other rows of the same label,
    and the least id that links reach, which is the row that stays."""
    epsilon = math.sqrt(2 - 2 * similarity)
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", "label", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"), ok.alias("ok"))
    distinct = cut(classes(rows), "vector-classes")
    ordered, axes = grid_order(distinct, epsilon)
    made = cut(blocks(ordered, axes), "vector-blocks", by=["kind"])
    drop(distinct)
    packs, nodes = made.where("kind = 0"), made.where("kind = 1").select("node", "label", "k1", "k2", "rep", "copies")
    found = cut(block_links(near_blocks(packs, epsilon), packs, similarity), "vector-links")

    links = found.where("root < 0").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("root >= 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
    parts = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    reps = parts.join(nodes.select("node", "rep"), "node")
    least = reps.groupBy("root").agg(F.min("rep").alias("least"))
    parts = parts.join(least, "root").select("node", "least")
    told = nodes.join(links, "node", "left").join(parts, "node", "left").where("copies > 1 OR links > 0")
    told = told.select(F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "rep").alias("least"), F.lit(True).alias("told"))
    match = F.col("ok") & (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    out = rows.select("id", "label", "k1", "k2", "ok").join(told, match, "left")
    component = F.when(F.col("told"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
