"""Hard negatives by dual-tree search for large inner products.

Candidates are routed through a tree fitted on a bounded sample, packed into blocks of one
leaf each and, within a block, into balls. Anchors are taken in passes of bounded number; a
pass has a tree of balls of its own, which every task gets. A task walks pairs of an anchor
node and a candidate node: the inner products of two balls lie in an interval around that of
their centres, and if it misses what every anchor of the node still looks for, the whole
group of anchors is done with that node. Pairs of leaves are scored exactly. Each search
first visits the anchors' own leaves, which gives bounds that the visit of all blocks starts
with."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, whole_vectors

#: Rows the splits are fitted on, rows of a block, anchors of a pass, and rows and anchors in
#: a ball without children.
SAMPLE, BLOCK, ANCHORS, BALL, GROUP = 8192, 2048, 65_536, 256, 64
MOST_LEAVES = 256
#: Below this, sums of products are exact in floating point.
EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def fit_splits(sample: np.ndarray, leaves: int) -> list:
    """A tree of ``[direction, cut, left, right]`` (children: trees or leaf numbers) with at
    most ``leaves`` leaves: halves along the line between two far rows."""
    numbered = [0]

    def grow(rows: np.ndarray, room: int):
        line = _line(rows) if room > 1 and len(rows) > 1 else None
        if line is None:
            numbered[0] += 1
            return numbered[0] - 1
        along = rows @ line
        cut = float(np.median(along))
        low = along <= cut
        if low.all():
            low = along < cut
            cut = float(along[low].max())
        return [line, cut, grow(rows[low], room // 2), grow(rows[~low], room - room // 2)]

    return [grow(sample.astype(np.float64), leaves), numbered]


def _line(rows: np.ndarray) -> np.ndarray | None:
    """A unit vector between two rows far from each other; None if all are equal."""
    off = rows - rows.mean(axis=0)
    one = rows[np.argmax((off**2).sum(axis=1))]
    off = rows - one
    far = (off**2).sum(axis=1)
    k = int(np.argmax(far))
    return off[k] / np.sqrt(far[k]) if far[k] > 0 else None


def route(tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    leaf = np.zeros(len(rows), np.int32)
    open_nodes = [(tree, np.arange(len(rows)))]
    while open_nodes:
        node, own = open_nodes.pop()
        if isinstance(node, int):
            leaf[own] = node
        elif len(own):
            low = rows[own] @ node[0] <= node[1]
            open_nodes += [(node[2], own[low]), (node[3], own[~low])]
    return leaf


class Balls:
    """A binary tree of balls over the rows of a matrix, which it puts in order."""

    def __init__(self, matrix: np.ndarray, most: int):
        rows = matrix.astype(np.float64)
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, children or -1
        centres, radii = [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            number = len(self.nodes)
            own = self.order[begin:end]
            part = rows[own]
            centre = part.mean(axis=0) if end > begin else np.zeros(rows.shape[1])
            centres.append(centre)
            radii.append(np.sqrt(((part - centre) ** 2).sum(axis=1).max(initial=0.0)))
            self.nodes.append((begin, end, -1, -1))
            if parent >= 0:
                a, b, *children = self.nodes[parent]
                children[side] = number
                self.nodes[parent] = (a, b, *children)
            line = _line(part) if end - begin > most else None
            if line is not None or end - begin > most:  # equal rows are halved as they stand
                along = part @ line if line is not None else np.zeros(end - begin)
                half = (end - begin) // 2
                self.order[begin:end] = own[np.argsort(along, kind="stable")]
                todo += [(begin, begin + half, number, 0), (begin + half, end, number, 1)]
        self.centre = np.array(centres)
        self.radius = np.array(radii) * (1 + 1e-9) + 1e-6
        self.norm = np.sqrt((self.centre**2).sum(axis=1)) * (1 + 1e-9)


def intervals(left: Balls, a: np.ndarray, right: Balls, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product between the balls of each pair of nodes."""
    middle = np.einsum("ij,ij->i", left.centre[a], right.centre[b])
    reach = left.norm[a] * right.radius[b] + right.norm[b] * left.radius[a] + left.radius[a] * right.radius[b]
    reach = reach * (1 + 1e-9) + 1e-6
    return middle - reach, middle + reach


class Search:
    """What a task looks for: for each anchor some windows ``low..high`` of scores, from each
    of which it wants the first ``top`` rows of the same label (other rows) or of another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int):
        self.tree = Balls(matrix, GROUP)
        put = self.tree.order
        self.put, self.ids, self.labels, self.matrix = put, ids[put], labels[put], matrix[put]
        self.low, self.high, self.same, self.top = low[put].copy(), high[put], same, top
        self.norm = float(np.sqrt((self.matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
        self.kept = (np.empty(0, np.int64),) * 3  # window (anchor * windows + which), score, id
        self.scored = 0

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node, the least score and the greatest that an anchor below looks for."""
        least, most = self.low.min(axis=1), self.high.max(axis=1)
        closed = least > most
        least, most = np.where(closed, HIGHEST, least), np.where(closed, LOWEST, most)
        n = len(self.tree.nodes)
        low, high = np.empty(n), np.empty(n)
        for k in range(n - 1, -1, -1):  # children have larger numbers
            begin, end, a, b = self.tree.nodes[k]
            low[k], high[k] = (least[begin:end].min(initial=HIGHEST), most[begin:end].max(initial=LOWEST)) if a < 0 else (min(low[a], low[b]), max(high[a], high[b]))
        return low, high

    def visit(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, only: np.ndarray | None = None) -> None:
        """A block of candidates; ``only``: the anchors that take part."""
        right = Balls(matrix, BALL)
        ids, labels, matrix = ids[right.order], labels[right.order], matrix[right.order]
        norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
        kind = np.float64 if norm * self.norm < EXACT else np.int64
        low, high = self.bounds()
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        left_nodes, right_nodes = np.array(self.tree.nodes), np.array(right.nodes)
        found: list[tuple] = []
        while len(a):  # one level of both trees after the other
            least, most = intervals(self.tree, a, right, b)
            live = (most >= low[a]) & (least <= high[a])
            a, b = a[live], b[live]
            left_leaf, right_leaf = left_nodes[a, 2] < 0, right_nodes[b, 2] < 0
            for x, y in zip(a[left_leaf & right_leaf].tolist(), b[left_leaf & right_leaf].tolist(), strict=True):
                self._score(left_nodes[x], right_nodes[y], ids, labels, matrix, kind, only, found)
            wide = ~(left_leaf & right_leaf)
            a, b, split_left, split_right = a[wide], b[wide], ~left_leaf[wide], ~right_leaf[wide]
            first = np.where(split_left, left_nodes[a, 2], a), np.where(split_left, left_nodes[a, 3], -1)
            second = np.where(split_right, right_nodes[b, 2], b), np.where(split_right, right_nodes[b, 3], -1)
            a = np.concatenate([x for x in first for _ in second])
            b = np.concatenate([y for _ in first for y in second])
            a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
        self._keep(found)

    def _score(self, left, right, ids, labels, matrix, kind, only, found) -> None:
        rows, cols = slice(left[0], left[1]), slice(right[0], right[1])
        scores = self.matrix[rows].astype(kind) @ matrix[cols].astype(kind).T
        self.scored += scores.size
        fit = (self.labels[rows, None] == labels[None, cols]) == self.same
        if self.same:
            fit &= self.ids[rows, None] != ids[None, cols]
        if only is not None:
            fit &= only[rows, None]
        for w in range(self.low.shape[1]):
            take = fit & (scores >= self.low[rows, w, None]) & (scores <= self.high[rows, w, None])
            some = np.flatnonzero(take.any(axis=1))
            if not len(some):
                continue
            part = np.where(take[some], scores[some], -np.inf)
            if part.shape[1] > self.top:  # no less than the last that can count, ties too
                cut = np.partition(part, -self.top, axis=1)[:, -self.top]
                chosen = take[some] & (part >= cut[:, None])
            else:
                chosen = take[some]
            r, c = np.nonzero(chosen)
            found.append(((some[r] + left[0]) * self.low.shape[1] + w, scores[some[r], c].astype(np.int64), ids[cols][c]))
        if sum(len(x[0]) for x in found[-64:]) > 1 << 18:
            self._keep(found)

    def _keep(self, found: list[tuple]) -> None:
        """The first ``top`` of each window stay, and raise what is looked for."""
        if not found:
            return
        window, score, who = (np.concatenate(x) for x in zip(self.kept, *found, strict=True))
        found.clear()
        order = np.lexsort((who, -score, window))
        window, score, who = window[order], score[order], who[order]
        begin = np.flatnonzero(np.concatenate([[True], np.diff(window) != 0]))
        rank = np.arange(len(window)) - np.repeat(begin, np.diff(np.append(begin, len(window))))
        full = rank == self.top - 1
        at = np.divmod(window[full], self.low.shape[1])
        self.low[at] = np.maximum(self.low[at], score[full])
        self.kept = window[rank < self.top], score[rank < self.top], who[rank < self.top]


FOUND = "anchor int, window int, id long, score long"


def _searching(sent, leaves_only: bool):
    """Found rows of a task's blocks. ``sent``: the pass, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        dims = given["dims"]
        as_matrix = lambda raw: np.frombuffer(raw, np.int32).reshape(-1, dims)
        search = Search(np.frombuffer(given["ids"], np.int64), np.frombuffer(given["labels"], np.int64), as_matrix(given["matrix"]), given["low"], given["high"], given["same"], given["top"])
        leaves = np.frombuffer(given["leaves"], np.int32)[search.put]
        for batch in batches:
            for row in batch.to_pylist():
                only = leaves == row["leaf"] if leaves_only else None
                if only is None or only.any():
                    search.visit(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), as_matrix(row["matrix"]), only)
        window, score, who = search.kept
        place, which = np.divmod(window, search.low.shape[1])
        for at in range(0, len(window), 10_000):
            some = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(search.put[place[some]], pa.int32()), pa.array(which[some], pa.int32()), pa.array(who[some], pa.int64()), pa.array(score[some], pa.int64())], ["anchor", "window", "id", "score"])

    return run


def _pack_blocks(dims: int):
    def run(group: pa.Table) -> pa.Table:
        matrix = np.asarray(group.column("vector").combine_chunks().flatten(), np.int32)
        one = {"leaf": [group.column("leaf")[0].as_py()], "ids": [np.asarray(group.column("id"), np.int64).tobytes()], "labels": [np.asarray(group.column("label"), np.int64).tobytes()], "matrix": [matrix.tobytes()]}
        return pa.table({k: pa.array(v, pa.int32() if k == "leaf" else pa.binary()) for k, v in one.items()})

    return run


def _first(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each window over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pass(spark, blocks: DataFrame, anchors: dict, low: np.ndarray, high: np.ndarray, same: bool, top: int) -> DataFrame:
    """A search of one pass: own leaves, then, with the bounds from there, all blocks."""
    given = anchors | {"low": low, "high": high, "same": same, "top": top}
    sent = spark.sparkContext.broadcast(given)
    near = _first(blocks.mapInArrow(_searching(sent, True), FOUND), top)
    full = near.where(F.col("rank") == top).select("anchor", "window", "score").toPandas()  # one a window of the pass at most
    at = full["anchor"].to_numpy(), full["window"].to_numpy()
    given["low"][at] = np.maximum(low[at], full["score"].to_numpy(np.int64))
    sent.destroy()
    sent = spark.sparkContext.broadcast(given)
    found = materialize(_first(blocks.mapInArrow(_searching(sent, False), FOUND), top), "negatives-found")
    sent.destroy()
    return found


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100, scale: int = 256, positives: int = 5, negatives: int = 5, lowest: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``, a score is the whole-number inner product; higher
    scores come first, ties by smaller id. Anchors are the rows whose id ``anchor_every``
    divides. A positive is one of an anchor's first ``positives`` rows of its label and
    another id; for each, the first ``negatives`` rows of other labels whose score is at
    least ``lowest`` percent of the positive's and not above it (none below a score of 0).

    Rows without id, label or vector, or with a null or non-finite component, take no part,
    nor those with ``|scale * x|`` of 2^27 or more, whose products may not fit a long. A
    shorter vector counts as followed by zeros. Repeated rows count each, as candidates and
    as anchors; a row of the anchor's own id is no positive. An empty table gives no rows."""
    spark = df.sparkSession
    whole = whole_vectors(df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), vector_col, scale, None, [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label")])
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not size.n or not size.dims:
        return empty
    dims, leaves = size.dims, max(1, min(MOST_LEAVES, size.n // BLOCK))
    whole = whole.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0), F.lit(dims) - F.size("vector"))))
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas() if leaves > 1 else None
    tree = fit_splits(np.stack(sample["vector"].to_numpy()), leaves)[0] if leaves > 1 else 0

    def routing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route(tree, rows))], [*batch.schema.names, "leaf"])

    routed = materialize(whole.mapInArrow(routing, "id long, label long, vector array<int>, leaf int"), "negatives-rows")
    counts = {r.leaf: r["count"] for r in routed.groupBy("leaf").count().collect()}  # MOST_LEAVES at most
    parts = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-n // BLOCK))]), F.col("leaf"))
    dealt = routed.withColumn("part", F.pmod(F.monotonically_increasing_id(), parts))  # equal rows too are dealt out
    blocks = materialize(dealt.groupBy("leaf", "part").applyInArrow(_pack_blocks(dims), "leaf int, ids binary, labels binary, matrix binary"), "negatives-blocks")
    chosen = routed.where(F.col("id") % anchor_every == 0)
    passes = -(-chosen.count() // ANCHORS)
    chosen = chosen.withColumn("pass", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(max(1, passes))))
    out = []
    for k in range(passes):
        rows = chosen.where(F.col("pass") == k).drop("pass").toPandas()
        if not len(rows):
            continue
        ids, matrix = rows["id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.int32)
        anchors = {"dims": dims, "ids": ids.tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes(), "matrix": matrix.tobytes(), "leaves": rows["leaf"].to_numpy(np.int32).tobytes()}
        n = len(ids)
        near = _pass(spark, blocks, anchors, np.full((n, 1), LOWEST), np.full((n, 1), HIGHEST), True, positives)
        low, high = np.full((n, positives), HIGHEST), np.full((n, positives), LOWEST)  # closed windows
        pairs = near.toPandas()
        at = pairs["anchor"].to_numpy(), pairs["rank"].to_numpy() - 1
        score = pairs["score"].to_numpy(np.int64)
        high[at] = score
        low[at] = -(-score * lowest // 100)
        far = _pass(spark, blocks, anchors, low, high, False, negatives)
        named = spark.createDataFrame(list(enumerate(ids.tolist())), "anchor int, anchor_id long")
        positive = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["anchor", "window"]).join(F.broadcast(named), "anchor")
        out.append(materialize(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-pass"))
        release(near)
        release(far)
    release(blocks)
    release(routed)
    return reduce(DataFrame.unionByName, out) if out else empty


def brute_force(rows: list[tuple], anchor_every: int = 100, positives: int = 5, negatives: int = 5, lowest: int = 80) -> list[tuple]:
    """The same from all scores, over ``(id, label, whole vector)`` (small fixtures)."""
    out = []
    product = lambda v, w: sum(a * b for a, b in zip(v, w, strict=False))
    for anchor, label, vector in rows:
        if anchor % anchor_every:
            continue
        scored = [(-product(vector, v), i, other) for i, other, v in rows]
        own = sorted(s[:2] for s in scored if s[2] == label and s[1] != anchor)[:positives]
        for p, i in own:
            hard = sorted(s[:2] for s in scored if s[2] != label and -lowest * p <= -100 * s[0] <= -100 * p)[:negatives]
            out += [(anchor, i, rank, j, -p, -q) for rank, (q, j) in enumerate(hard, 1)]
    return out
