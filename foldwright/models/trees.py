"""Histogram boosting and extremely randomised trees grown on Spark.

Rows are binned once and persisted in packed blocks, a row for each block. Each step is one job: tasks turn their rows
into partial statistics per (tree, node, feature, bin), Spark sums them and picks
the best split per node, and only the chosen splits come back to the driver.

The booster grows its trees best first: a step takes all nodes that the leaf budget
can still reach, counts the rows of the smaller child of every split, and takes the
larger child as the parent's sums minus those. Raw scores move once a round. Gradients
are summed as whole multiples of a power of two, so the sums, and with them the trees,
do not depend on the order of tasks or the number of partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.models.arrays import (
    block_arrays,
    list_column,
    matrix,
    packed_column,
    packed_rows,
    spread,
    vector,
    with_computed,
)
from foldwright.models.linear import class_predictions
from foldwright.operators.columns import TARGET
from foldwright.operators.ordering import grouped_quantiles
from foldwright.session import cut_lineage

CHECKPOINT_ROUNDS = 10
#: Steps of a round whose sums may rest on each other before they are written: a plan names every cached table below it.
CHECKPOINT_STEPS = 4
_CELL_BUDGET = 8_000_000  # counters a task holds at once; wider steps take several blocks of features
_GRADIENT_BITS = 30
_WHOLE_DEPTH = 12  # of trees whose leaves are found without dropping rows that have arrived


@dataclass
class Tree:
    """A binary tree over binned features; node 0 is the root, leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, left_value, right_value) -> tuple[int, int]:
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, child
        for v in (left_value, right_value):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.value.append(v)
            self.depth.append(self.depth[node] + 1)
        return child, child + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf index of each row (a row goes left when bin <= cut)."""
        feature, cut, left = np.asarray(self.feature), np.asarray(self.cut), np.asarray(self.left)
        if max(self.depth) <= _WHOLE_DEPTH:
            # All rows take every step: a leaf leads to itself, as no bin lies above its cut.
            inner = feature >= 0
            column, child = np.where(inner, feature, 0), np.where(inner, left, np.arange(len(left)))
            cut = np.where(inner, cut, np.iinfo(np.int16).max)
            flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
            node = np.zeros(len(bins), dtype=np.int64)
            for _ in range(max(self.depth)):
                node = child.take(node) + (flat.take(first + column.take(node)) > cut.take(node))
            return node
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while rows.size:
            at = node[rows]
            rows, at = rows[feature[at] >= 0], at[feature[at] >= 0]
            if rows.size:
                node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(bins)]

    def state(self) -> dict:
        return {"feature": self.feature, "cut": self.cut, "left": self.left,
                "value": np.asarray(self.value).tolist(), "depth": self.depth}


def tree_from_state(s: dict) -> Tree:
    return Tree(s["feature"], s["cut"], s["left"], s["value"], s["depth"])


def bin_edges(df: DataFrame, width: int, max_bins: int) -> list[list[float]]:
    """Cut points per feature from mergeable quantile sketches, one job."""
    probs = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(
        *[F.percentile_approx(F.get("features", F.lit(j)), probs, 10_000).alias(f"q{j}") for j in range(width)]
    ).first()
    return [sorted(set(row[f"q{j}"] or [])) for j in range(width)]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def binned(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """row_id, target, row hash and the packed bins (int16 per feature)."""
    arrays = [np.asarray(e) for e in edges]

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"bins": packed_column(to_bins(matrix(batch), arrays))}

    base = df.select("row_id", F.col(TARGET).cast("double").alias(TARGET), "features")
    out = with_computed(base, compute, [T.StructField("bins", T.BinaryType())], drop=["features"])
    return out.withColumn("row_hash", F.xxhash64("row_id"))


def binned_blocks(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """The rows of ``binned`` in packed blocks: target, row hash and bins."""
    arrays = [np.asarray(e) for e in edges]

    def compute(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {TARGET: vector(batch, TARGET), "row_hash": vector(batch, "row_hash", np.int64), "bins": to_bins(matrix(batch), arrays)}

    base = df.select(F.col(TARGET).cast("double").alias(TARGET), F.xxhash64("row_id").alias("row_hash"), "features")
    return packed_rows(base, compute, [TARGET, "row_hash", "bins"])


_BLOCK = {TARGET: np.float64, "row_hash": np.int64, "bins": np.int16, "raw": np.float64}


def _blocks(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """target, bins and, where they are there, row_hash and raw of a batch: of each packed block, or of its plain rows."""
    if pa.types.is_binary(batch.schema.field(TARGET).type):
        yield from block_arrays(batch, _BLOCK, TARGET)
    elif batch.num_rows:
        one = {"bins": matrix(batch, "bins", np.int16), TARGET: vector(batch, TARGET)}
        if batch.schema.get_field_index("raw") >= 0:
            one |= {"raw": matrix(batch, "raw"), "row_hash": vector(batch, "row_hash", np.int64)}
        yield one


def _targets(blocks: DataFrame) -> DataFrame:
    """The target of every row of packed blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(block[TARGET], from_pandas=True)], [TARGET])

    return blocks.select(TARGET).mapInArrow(run, f"`{TARGET}` double")


def _mix(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Uniform [0, 1) per row and salt (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) / 2.0**53


def gradients(loss: str, raw: np.ndarray, y: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives per output (n x K)."""
    if loss == "squared":
        return raw - y[:, None], np.ones_like(raw)
    if loss == "quantile":
        return np.where(y[:, None] > raw, -quantile, 1 - quantile), np.ones_like(raw)
    if loss == "logistic":
        p = 1 / (1 + np.exp(-raw))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-12)
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    goal = y[:, None] == np.arange(raw.shape[1])[None, :]
    return p - goal, np.maximum(p * (1 - p), 1e-12)


class Growth:
    """One tree grown best first, with the nodes whose best split is known."""

    def __init__(self) -> None:
        self.tree = Tree()
        self.splits: dict[int, dict] = {}

    def order(self, max_leaves: int) -> list[int]:
        """Nodes to split, the highest gain first, until there are ``max_leaves`` leaves.

        Nodes not looked at yet count as leaves. Knowing them can only move other nodes
        back, so a node that is not taken now is never taken later.
        """
        heap = [(-self.splits[0]["gain"], 0)] if 0 in self.splits else []
        taken = []
        while heap and len(taken) + 1 < max_leaves:
            node = heapq.heappop(heap)[1]
            taken.append(node)
            left = self.tree.left[node]
            for child in (left, left + 1) if left >= 0 else ():
                if child in self.splits:
                    heapq.heappush(heap, (-self.splits[child]["gain"], child))
        return taken

    def grown(self, max_leaves: int) -> Tree:
        """The tree of the taken splits only, numbered in the order they were taken."""
        tree = Tree(value=[self.tree.value[0]])
        place = {0: 0}
        for node in self.order(max_leaves):
            left = self.tree.left[node]
            place[left], place[left + 1] = tree.split(
                place[node], self.tree.feature[node], self.tree.cut[node], *self.tree.value[left : left + 2])
        return tree


@dataclass(frozen=True)
class Units:
    """The powers of two that gradients and second derivatives are counted in."""

    g: float
    h: float

    @staticmethod
    def of(n_rows: int, largest: float) -> Units:
        """So fine that the sum over all rows still fits a long."""
        bits = min(_GRADIENT_BITS, 62 - int(n_rows).bit_length())
        exponent = int(np.ceil(np.log2(largest))) if largest > 0 else 0
        return Units(2.0 ** (exponent - bits), 2.0**-bits)


@dataclass
class Booster:
    """Second-order histogram gradient boosting.

    ``loss``: squared, quantile, logistic or softmax. Trees grow best first to
    ``max_leaves`` leaves, without a depth limit unless ``max_depth`` is given; all class
    trees of a round grow in the same jobs.
    """

    task: str
    rounds: int = 100
    learning_rate: float = 0.1
    max_leaves: int = 31
    max_depth: int | None = None
    min_rows: int = 20
    min_child_weight: float = 1e-3
    l2: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    max_bins: int = 255
    quantile: float | None = None
    classes: int = 2
    seed: int = 0

    @property
    def loss(self) -> str:
        if self.quantile is not None:
            return "quantile"
        if self.task == "regression":
            return "squared"
        return "logistic" if self.classes == 2 else "softmax"

    def _base(self, data: DataFrame, n_rows: int) -> list[float]:
        if self.quantile is not None:
            return [leaf_quantiles(data.select(F.lit(0).alias("leaf"), F.col(TARGET).alias("residual")),
                                   self.quantile).first()["value"]]
        if self.task == "regression":
            unit = Units.of(n_rows, data.agg(F.max(F.abs(TARGET))).first()[0]).g
            total = data.agg(F.sum(F.round(F.col(TARGET) / unit).cast("long"))).first()[0]
            return [total / n_rows * unit]
        counts = {int(r[TARGET]): r["n"] for r in data.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
        share = [min(max(counts.get(c, 0) / n_rows, 1e-9), 1 - 1e-9) for c in range(self.classes)]
        if self.classes == 2:
            return [float(np.log(share[1] / share[0]))]
        return [float(np.log(s)) for s in share]

    def fit(self, train: DataFrame) -> BoosterModel:
        n_rows = train.count()
        width = len(train.select("features").first()[0])
        edges = bin_edges(train, width, self.max_bins)
        # Written once, so that no job's plan holds the plans that prepared the rows.
        data = cut_lineage(binned_blocks(spread(train, n_rows), edges)).persist()
        held = [data]
        try:
            base = self._base(_targets(data), n_rows)
            # Every state adds the rounds since the last written one to that one's scores, in their order: a state that
            # were made from the state before would name all of those in its plan, and in the plans of its round's jobs.
            written = state = _started(data, base)
            rounds: list[list[Tree]] = []
            for r in range(self.rounds):
                rounds.append(self.grow_round(state, n_rows, r, width, len(base)))
                if r + 1 < self.rounds:
                    since = r % CHECKPOINT_ROUNDS + 1
                    state = _advanced(written, rounds[-since:])
                    if since == CHECKPOINT_ROUNDS:
                        written = state = cut_lineage(state)
                        held.append(state.persist())
                        while len(held) > 1:
                            held.pop(0).unpersist()
                    else:
                        # The last written one stays; the state before is not read again.
                        held.append(state.persist())
                        while len(held) > 2:
                            held.pop(1).unpersist()
        finally:
            for table in held:
                table.unpersist()
        return BoosterModel(self.task, self.loss, edges, base, rounds)

    def _columns(self, r: int, k: int, width: int) -> np.ndarray:
        if self.colsample >= 1:
            return np.arange(width)
        keep = max(1, int(np.ceil(width * self.colsample)))
        return np.sort(np.random.default_rng([self.seed, r, k]).permutation(width)[:keep])

    def _units(self, state: DataFrame, n_rows: int) -> Units:
        """Gradients of the squared loss have no fixed range; all others lie within -1 and 1."""
        largest = 1.0
        if self.loss == "squared":
            largest = _residual_bounds(state).agg(F.max("largest")).first()[0]
        return Units.of(n_rows, largest)

    def grow_round(self, state: DataFrame, n_rows: int, r: int, width: int, outputs: int) -> list[Tree]:
        """The trees of one round, one for each output, for state(target, bins, row_hash, raw)."""
        units = self._units(state, n_rows)
        growths = [Growth() for _ in range(outputs)]
        columns = [self._columns(r, k, width) for k in range(outputs)]
        counted: list[DataFrame] = []
        # Per output: the nodes whose rows are counted, each with the parent and the sibling found from it.
        step: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] for _ in range(outputs)]
        try:
            while any(step):
                sums = self._node_sums(state, [g.tree for g in growths], step, columns, r, units, counted)
                sums = cut_lineage(sums) if len(counted) % CHECKPOINT_STEPS == CHECKPOINT_STEPS - 1 else sums.persist()
                counted.append(sums)
                for s in self._best_splits(sums, units).collect():
                    growth = growths[s["k"]]
                    if s["node"] == 0:
                        growth.tree.value[0] = self._leaf(s["g"], s["h"])
                    if s["feature"] >= 0:
                        growth.splits[s["node"]] = s.asDict()
                step = [self._expanded(g) for g in growths]
        finally:
            for sums in counted:
                sums.unpersist()
        trees = [g.grown(self.max_leaves) for g in growths]
        if self.loss == "quantile":
            self._quantile_leaves(state, trees)
        return trees

    def _expanded(self, growth: Growth) -> list[tuple[int, int, int]]:
        """Split the taken nodes that are still leaves: (smaller child, parent, larger child) of each to be looked at."""
        tree, out = growth.tree, []
        for node in growth.order(self.max_leaves):
            if tree.left[node] >= 0:
                continue
            s = growth.splits[node]
            left, right = tree.split(
                node, s["feature"], s["bin"], self._leaf(s["gl"], s["hl"]), self._leaf(s["g"] - s["gl"], s["h"] - s["hl"]))
            rows = {left: s["nl"], right: s["n"] - s["nl"]}
            deep = self.max_depth is not None and tree.depth[left] >= self.max_depth
            if not deep and max(rows.values()) >= 2 * self.min_rows:
                small = left if rows[left] <= rows[right] else right
                out.append((small, node, left + right - small))
        return out

    def _leaf(self, g: float, h: float) -> float:
        return -self.learning_rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0

    def _node_sums(self, state, trees, step, columns, r, units, counted) -> DataFrame:
        """Sums (g, h, n) per (k, node, feature, bin) of the step's nodes in units: counted rows, and parents minus those.

        With them the sums up to the bin (gl, hl, nl) and over all bins (ga, ha, na).
        """
        cells = sum(3 * len(nodes) * len(cols) * self.max_bins for nodes, cols in zip(step, columns))
        blocks = -(-cells // _CELL_BUDGET)
        rows = state.select(TARGET, "bins", "row_hash", "raw")
        schema = "k int, node int, feature int, bin int, g long, h long, n long"
        parts = [
            rows.mapInArrow(self._counted(trees, step, [c[block::blocks] for c in columns], r, units), schema)
            for block in range(blocks)
        ]
        larger = {(k, parent): child for k, nodes in enumerate(step) for _, parent, child in nodes if parent >= 0}
        if larger:
            sibling = F.create_map(*[F.lit(v) for (k, node), child in larger.items() for v in (f"{k} {node}", child)])
            parents = counted[-1].withColumn("node", F.try_element_at(sibling, F.concat_ws(" ", "k", "node")))
            parts.append(parents.filter("node IS NOT NULL").select(*parts[0].columns))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        # One shuffle: the sums and the bin scan (at most max_bins rows per feature) share the partitioning.
        upto = "OVER (PARTITION BY k, node, feature ORDER BY bin)"
        whole = "OVER (PARTITION BY k, node, feature)"
        return (
            out.repartition("k", "node", "feature")
            .groupBy("k", "node", "feature", "bin")
            .agg(*[F.sum(v).alias(v) for v in ("g", "h", "n")])
            .filter("n > 0")
            .selectExpr("*", *[f"sum({v}) {upto} AS {v}l" for v in "ghn"], *[f"sum({v}) {whole} AS {v}a" for v in "ghn"])
        )

    def _counted(self, trees, step, columns, r, units):
        loss, q = self.loss, self.quantile or 0.5
        subsample, seed, n_bins = self.subsample, self.seed, self.max_bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {
                k: np.zeros((3, len(nodes) * len(columns[k]) * n_bins), dtype=np.int64)
                for k, nodes in enumerate(step) if nodes and len(columns[k])
            }
            for block in (block for batch in batches for block in _blocks(batch)):
                bins = block["bins"]
                use = np.ones(len(bins), dtype=bool)
                if subsample < 1:
                    use = _mix(block["row_hash"].ravel(), seed * 100_003 + r) < subsample
                g, h = gradients(loss, block["raw"], block[TARGET], q)
                for k, total in sums.items():
                    slot = np.full(len(trees[k].feature), -1)
                    slot[[node for node, _, _ in step[k]]] = np.arange(len(step[k]))
                    at = slot[trees[k].leaves(bins)]
                    rows = np.flatnonzero(use & (at >= 0))
                    cols = columns[k]
                    first = at[rows, None] * len(cols) + np.arange(len(cols))
                    cell = (first * n_bins + bins[np.ix_(rows, cols)]).ravel()
                    # A batch's sums of whole numbers are exact as doubles, the totals are longs.
                    for i, (value, unit) in enumerate(((g, units.g), (h, units.h))):
                        whole = np.repeat(np.rint(value[rows, k] / unit), len(cols))
                        total[i] += np.bincount(cell, whole, total.shape[1]).astype(np.int64)
                    total[2] += np.bincount(cell, minlength=total.shape[1])
            for k, total in sums.items():
                yield from _emitted(k, step[k], columns[k], n_bins, total)

        return run

    def _best_splits(self, sums: DataFrame, units: Units) -> DataFrame:
        """Best split of every node of the sums."""
        gain = (
            f"gl * gl / nullif(hl + {self.l2!r}D, 0D) "
            f"+ (g - gl) * (g - gl) / nullif(h - hl + {self.l2!r}D, 0D) - g * g / nullif(h + {self.l2!r}D, 0D)"
        )
        allowed = (
            f"nl >= {self.min_rows} AND n - nl >= {self.min_rows} "
            f"AND hl >= {self.min_child_weight!r}D AND h - hl >= {self.min_child_weight!r}D"
        )
        return (
            sums.selectExpr(
                "k", "node", "feature", "bin", "nl", "na AS n",
                *[f"{v}{of} * {unit!r}D AS {v}{side}" for v, unit in (("g", units.g), ("h", units.h))
                  for of, side in (("l", "l"), ("a", ""))],
            )
            .selectExpr("*", f"CASE WHEN {allowed} THEN coalesce({gain}, -1D) ELSE -1D END AS gain")
            .groupBy("k", "node")
            .agg(
                F.expr(
                    "max_by(struct(feature, bin, gain, gl, hl, nl, g, h, n), "
                    "struct(gain, -feature, -bin)) AS s"
                )
            )
            .selectExpr(
                "k", "node", "if(s.gain > 1e-9, s.feature, -1) AS feature", "s.bin", "s.gain", "s.gl",
                "s.hl", "s.nl", "s.g", "s.h", "s.n",
            )
        )

    def _quantile_leaves(self, state: DataFrame, trees: list[Tree]) -> None:
        """Replace leaf values by the residual quantile of the leaf's rows."""
        tree = trees[0]
        residuals = _leaf_residuals(state, tree).persist()
        try:
            for r in leaf_quantiles(residuals, self.quantile).collect():
                tree.value[r["leaf"]] = self.learning_rate * r["value"]
        finally:
            residuals.unpersist()


def _with_raw(blocks: DataFrame, scores) -> DataFrame:
    """Packed blocks with the raw scores that ``scores`` gives for a block's arrays."""
    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"raw": pa.array([np.ascontiguousarray(scores(block)).tobytes() for block in _blocks(batch)], pa.binary())}

    return with_computed(blocks, compute, [T.StructField("raw", T.BinaryType())], drop=["raw"])


def _started(blocks: DataFrame, base: list[float]) -> DataFrame:
    """Packed blocks whose rows all have the base as their raw scores."""
    return _with_raw(blocks, lambda block: np.tile(np.asarray(base, dtype=float), (len(block[TARGET]), 1)))


def _advanced(state: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
    """state with the values of the rounds' trees added to its raw scores."""
    return _with_raw(state, lambda block: _raw_scores(block["bins"], block["raw"], rounds))


def _residual_bounds(state: DataFrame) -> DataFrame:
    """The largest distance between score and target in each block; rows without a target are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(np.fmax.reduce(np.abs(block["raw"][:, 0] - block[TARGET]))) for block in _blocks(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64(), from_pandas=True)], ["largest"])

    return state.select(TARGET, "raw").mapInArrow(run, "largest double")


def _leaf_residuals(state: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                yield pa.RecordBatch.from_pydict({
                    "leaf": pa.array(tree.leaves(block["bins"]).astype(np.int32)),
                    "residual": pa.array(block[TARGET] - block["raw"][:, 0])})

    return state.select(TARGET, "bins", "raw").mapInArrow(run, "leaf int, residual double")


def leaf_quantiles(residuals: DataFrame, q: float) -> DataFrame:
    """(leaf, value): exact residual quantile per leaf."""
    return grouped_quantiles(residuals, ["leaf"], "residual", {"value": q})


def _raw_scores(bins: np.ndarray, raw: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    raw = raw.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            raw[:, k] += tree.predict(bins)
    return raw


def _emitted(k: int, nodes, cols: np.ndarray, n_bins: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums of the counted nodes, and the same taken off their siblings."""
    cell = np.flatnonzero(total[2])
    at, rest = np.divmod(cell, len(cols) * n_bins)
    feature, b = np.divmod(rest, n_bins)
    names = np.asarray(nodes, dtype=np.int32)
    for side, sign in ((0, 1), (2, -1)):
        node = names[at, side]
        some = node >= 0
        yield pa.RecordBatch.from_pydict(
            {
                "k": pa.array(np.full(int(some.sum()), k, dtype=np.int32)),
                "node": pa.array(node[some]),
                "feature": pa.array(cols[feature[some]].astype(np.int32)),
                "bin": pa.array(b[some].astype(np.int32)),
                **{name: pa.array(sign * total[i][cell[some]]) for i, name in enumerate(("g", "h", "n"))},
            }
        )


@dataclass
class BoosterModel:
    task: str
    loss: str
    edges: list[list[float]]
    base: list[float]
    trees: list[list[Tree]]

    def predict(self, df: DataFrame) -> DataFrame:
        edges = [np.asarray(e) for e in self.edges]
        base, trees, loss = np.asarray(self.base), self.trees, self.loss

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            bins = to_bins(matrix(batch), edges)
            raw = _raw_scores(bins, np.tile(base, (len(bins), 1)), trees)
            if loss in ("squared", "quantile"):
                return {"pred": pa.array(raw[:, 0])}
            if loss == "logistic":
                p = 1 / (1 + np.exp(-raw[:, 0]))
                return {"proba": list_column(np.column_stack([1 - p, p]))}
            e = np.exp(raw - raw.max(axis=1, keepdims=True))
            return {"proba": list_column(e / e.sum(axis=1, keepdims=True))}

        if self.task == "regression":
            return with_computed(df, compute, [T.StructField("pred", T.DoubleType())])
        proba = T.StructField("proba", T.ArrayType(T.DoubleType()))
        return class_predictions(with_computed(df, compute, [proba]))

    def state(self) -> dict:
        return {"kind": "booster", "task": self.task, "loss": self.loss, "edges": self.edges,
                "base": self.base, "trees": [[t.state() for t in r] for r in self.trees]}


# ---------------------------------------------------------------- extra trees


@dataclass
class ExtraTrees:
    """Extremely randomised trees: one random cut per drawn feature and node.

    All trees grow together. A level takes two jobs: the bin range of every
    (tree, node, feature), then the class sums left of a cut drawn in that range.
    """

    task: str
    n_estimators: int = 300
    max_depth: int = 10
    min_rows_leaf: int = 1
    max_features: float | str | None = None
    classes: int = 2
    max_bins: int = 64
    seed: int = 0

    def _drawn(self, width: int) -> int:
        m = self.max_features
        if m is None:
            m = "sqrt" if self.task == "classification" else 1.0
        return max(1, int(np.sqrt(width)) if m == "sqrt" else int(width * float(m)))

    def fit(self, train: DataFrame) -> ExtraTreesModel:
        edges, data = self.bin(train)
        try:
            return self.grow(data, edges)
        finally:
            data.unpersist()

    def bin(self, train: DataFrame) -> tuple[list[list[float]], DataFrame]:
        """Bin edges of every feature, and the persisted rows in packed blocks of bins."""
        edges = bin_edges(train, len(train.select("features").first()[0]), self.max_bins)
        return edges, binned_blocks(spread(train, train.count()), edges).persist()

    def grow(self, data: DataFrame, edges: list[list[float]], kept: list[int] | None = None) -> ExtraTreesModel:
        """The model of binned rows, of all features or of those at the kept positions only."""
        edges = edges if kept is None else [edges[i] for i in kept]
        width, outputs = len(edges), self.classes if self.task == "classification" else 1
        root = self._root(data, outputs)
        trees = [Tree(value=[root]) for _ in range(self.n_estimators)]
        importances = np.zeros(width)
        active = [[0] for _ in trees]
        for _ in range(self.max_depth):
            if not any(active):
                break
            active = self._grow(data, trees, active, kept, width, outputs, importances)
        total = importances.sum()
        return ExtraTreesModel(
            self.task, edges, trees, list(importances / total if total else importances)
        )

    def _root(self, blocks: DataFrame, outputs: int) -> list[float]:
        data = _targets(blocks)
        if self.task == "regression":
            return [float(data.agg(F.avg(TARGET)).first()[0])]
        rows = data.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {int(r[TARGET]): r["n"] for r in rows}
        total = sum(counts.values())
        return [counts.get(c, 0) / total for c in range(outputs)]

    def _grow(self, data, trees, active, kept, width, outputs, importances) -> list[list[int]]:
        seed, m = self.seed, self._drawn(width)
        # Regression sums are taken around the root mean, so large targets do not cancel.
        shift = trees[0].value[0][0] if self.task == "regression" else 0.0
        chosen = {
            (t, node): np.random.default_rng([seed, t, node]).permutation(width)[:m]
            for t, nodes in enumerate(active)
            for node in nodes
        }
        ranges = data.select(TARGET, "bins").mapInArrow(
            _range_partials(trees, active, chosen, kept, self.max_bins), "t int, node int, feature int, lo int, hi int"
        ).groupBy("t", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("hi > lo")
        cuts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # One row per drawn (tree, node, feature): bounded by the size of the forest.
        for r in ranges.collect():
            u = np.random.default_rng([seed, r["t"], r["node"], r["feature"] + 1]).random()
            cut = r["lo"] + int(u * (r["hi"] - r["lo"]))
            cuts.setdefault((r["t"], r["node"]), []).append((r["feature"], cut))
        if not cuts:
            return [[] for _ in trees]
        sides = data.select(TARGET, "bins").mapInArrow(
            _side_partials(trees, active, cuts, kept, self.task, outputs, shift),
            "t int, node int, feature int, cut int, c int, ls double, s double, ln double, n double",
        )
        sums = (
            sides.repartition("t", "node")
            .groupBy("t", "node", "feature", "cut", "c")
            .agg(*[F.sum(v).alias(v) for v in ("ls", "s", "ln", "n")])
        )
        # Between-group sum of squares over the outputs, i.e. n times the impurity decrease.
        rs, rn = F.col("s") - F.col("ls"), F.col("n") - F.col("ln")
        gain = (
            F.col("ls") * F.col("ls") / F.col("ln") + rs * rs / rn - F.col("s") * F.col("s") / F.col("n")
        )
        ok = (F.col("ln") >= self.min_rows_leaf) & (rn >= self.min_rows_leaf)
        per_cut = sums.filter(ok).groupBy("t", "node", "feature", "cut").agg(
            F.sum(gain).alias("gain"),
            F.sort_array(F.collect_list(F.struct("c", "ls", "s"))).alias("sides"),
            F.max("ln").alias("ln"),
            F.max("n").alias("n"),
        )
        best = per_cut.filter(F.col("gain") > 1e-12).groupBy("t", "node").agg(
            F.max_by(
                F.struct("feature", "cut", "gain", "sides", "ln", "n"),
                F.struct("gain", (-F.col("feature")).alias("f")),
            ).alias("b")
        )
        following: list[list[int]] = [[] for _ in trees]
        # One row per node: sorted here, a sort by Spark would take two more jobs.
        for r in sorted(best.select("t", "node", "b.*").collect(), key=lambda r: (r["t"], r["node"])):
            left = np.array([x["ls"] for x in r["sides"]])
            both = np.array([x["s"] for x in r["sides"]])
            ln, rn_ = r["ln"], r["n"] - r["ln"]
            a, b = trees[r["t"]].split(
                r["node"], r["feature"], r["cut"], list(left / ln + shift), list((both - left) / rn_ + shift)
            )
            importances[r["feature"]] += r["gain"]
            for child, n, share in ((a, ln, left / ln), (b, rn_, (both - left) / rn_)):
                pure = self.task == "classification" and share.max() >= 1.0
                if n >= max(2, 2 * self.min_rows_leaf) and not pure:
                    following[r["t"]].append(child)
        return following


def _kept_bins(bins: np.ndarray, kept: list[int] | None) -> np.ndarray:
    return bins if kept is None else np.ascontiguousarray(bins[:, kept])


def _choices(nodes: list[int], size: int, choice: dict[int, np.ndarray], fill: int, per_node: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each of a tree's nodes, or -1; a row of ``per_node`` choices for each slot, filled up)."""
    slot = np.full(size, -1, dtype=np.int32)
    slot[nodes] = np.arange(len(nodes))
    table = np.full((len(nodes), per_node), fill, dtype=np.int32)
    for i, node in enumerate(nodes):
        table[i, : len(choice[node])] = choice[node]
    return slot, table


def _slots(tree: Tree, slot: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that lie in a looked at node, and the slot of each."""
    at = slot.take(tree.leaves(bins))
    rows = np.flatnonzero(at >= 0)
    return rows, at.take(rows)


def _cells_of(rows: np.ndarray, at: np.ndarray, bins: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot times features plus place of the feature, bin there) of each row."""
    width = bins.shape[1]
    value = bins.ravel().take((rows * width)[:, None] + features.take(at, axis=0))
    return at[:, None] * features.shape[1] + np.arange(features.shape[1], dtype=np.int32), value


def _range_partials(trees, active, chosen, kept, n_bins):
    # Per tree with nodes: where its nodes' bounds are, and their drawn features, as many for each node.
    plan = {}
    for t, nodes in enumerate(active):
        if nodes:
            drawn = {node: chosen[t, node] for node in nodes}
            plan[t] = _choices(nodes, len(trees[t].feature), drawn, 0, len(drawn[nodes[0]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {t: np.full(features.size, n_bins, dtype=np.int32) for t, (_, features) in plan.items()}
        high = {t: np.full(features.size, -1, dtype=np.int32) for t, (_, features) in plan.items()}
        for block in (block for batch in batches for block in _blocks(batch)):
            bins = _kept_bins(block["bins"], kept)
            for t, (slot, features) in plan.items():
                rows, at = _slots(trees[t], slot, bins)
                if not rows.size:
                    continue
                cell, value = _cells_of(rows, at, bins, features)
                seen = np.bincount((cell * n_bins + value).ravel(), minlength=features.size * n_bins).reshape(-1, n_bins) > 0
                some = seen.any(axis=1)
                np.minimum(low[t], np.where(some, seen.argmax(axis=1), n_bins), out=low[t])
                np.maximum(high[t], np.where(some, n_bins - 1 - seen[:, ::-1].argmax(axis=1), -1), out=high[t])
        for t, (_, features) in plan.items():
            cell = np.flatnonzero(high[t] >= 0)
            if cell.size:
                yield pa.RecordBatch.from_pydict(
                    {
                        "t": pa.array(np.full(cell.size, t, dtype=np.int32)),
                        "node": pa.array(np.asarray(active[t], dtype=np.int32)[cell // features.shape[1]]),
                        "feature": pa.array(features.ravel()[cell].astype(np.int32)),
                        "lo": pa.array(low[t][cell]),
                        "hi": pa.array(high[t][cell]),
                    }
                )

    return run


def _side_partials(trees, active, cuts, kept, task, outputs, shift):
    plan = {}
    for t, nodes in enumerate(active):
        wanted = [n for n in nodes if (t, n) in cuts]
        if wanted:
            most = max(len(cuts[t, n]) for n in wanted)
            slot, features = _choices(wanted, len(trees[t].feature), {n: np.array([f for f, _ in cuts[t, n]]) for n in wanted}, 0, most)
            # No bin lies at or below -1, so nothing goes left of a place without a cut.
            bounds = _choices(wanted, len(trees[t].feature), {n: np.array([c for _, c in cuts[t, n]]) for n in wanted}, -1, most)[1]
            plan[t] = wanted, slot, features, bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per tree: sums and rows left of each cut, sums and rows of each node, by output.
        sums = {
            t: (np.zeros((features.size, outputs)), np.zeros(features.size), np.zeros((len(wanted), outputs)), np.zeros(len(wanted)))
            for t, (wanted, _, features, _) in plan.items()
        }
        for block in (block for batch in batches for block in _blocks(batch)):
            bins = _kept_bins(block["bins"], kept)
            y = block[TARGET]
            # A class that is none of the outputs counts as a row only.
            label = np.where((y >= 0) & (y < outputs), y, outputs).astype(np.int64) if task == "classification" else None
            for t, (wanted, slot, features, bounds) in plan.items():
                rows, at = _slots(trees[t], slot, bins)
                if not rows.size:
                    continue
                cell, value = _cells_of(rows, at, bins, features)
                goes = value <= bounds.take(at, axis=0)
                left_cell, left_row = cell[goes], rows[np.nonzero(goes)[0]]
                left, left_n, total, total_n = sums[t]
                if label is None:
                    goal = y - shift
                    left[:, 0] += np.bincount(left_cell, goal[left_row], features.size)
                    left_n += np.bincount(left_cell, minlength=features.size)
                    total[:, 0] += np.bincount(at, goal[rows], len(wanted))
                    total_n += np.bincount(at, minlength=len(wanted))
                else:
                    parts = outputs + 1
                    found = np.bincount(left_cell * parts + label[left_row], minlength=features.size * parts).reshape(-1, parts)
                    left += found[:, :outputs]
                    left_n += found.sum(axis=1)
                    found = np.bincount(at * parts + label[rows], minlength=len(wanted) * parts).reshape(-1, parts)
                    total += found[:, :outputs]
                    total_n += found.sum(axis=1)
        for t, (wanted, _, features, bounds) in plan.items():
            left, left_n, total, total_n = sums[t]
            # The cuts of nodes that the task has rows of.
            cell = np.flatnonzero((bounds.ravel() >= 0) & np.repeat(total_n > 0, features.shape[1]))
            if not cell.size:
                continue
            at = cell // features.shape[1]
            each = np.repeat(cell, outputs)
            yield pa.RecordBatch.from_pydict(
                {
                    "t": pa.array(np.full(each.size, t, dtype=np.int32)),
                    "node": pa.array(np.repeat(np.asarray(wanted, dtype=np.int32)[at], outputs)),
                    "feature": pa.array(features.ravel()[each].astype(np.int32)),
                    "cut": pa.array(bounds.ravel()[each].astype(np.int32)),
                    "c": pa.array(np.tile(np.arange(outputs), cell.size).astype(np.int32)),
                    "ls": pa.array(left[cell].ravel()),
                    "s": pa.array(total[at].ravel()),
                    "ln": pa.array(np.repeat(left_n[cell], outputs)),
                    "n": pa.array(np.repeat(total_n[at], outputs)),
                }
            )

    return run


@dataclass
class ExtraTreesModel:
    task: str
    edges: list[list[float]]
    trees: list[Tree]
    importances: list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        edges, trees = [np.asarray(e) for e in self.edges], self.trees
        regression = self.task == "regression"

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            bins = to_bins(matrix(batch), edges)
            mean = sum(t.predict(bins) for t in trees) / len(trees)
            return {"pred": pa.array(mean[:, 0])} if regression else {"proba": list_column(mean)}

        if regression:
            return with_computed(df, compute, [T.StructField("pred", T.DoubleType())])
        return class_predictions(
            with_computed(df, compute, [T.StructField("proba", T.ArrayType(T.DoubleType()))])
        )

    def state(self) -> dict:
        return {"kind": "extra_trees", "task": self.task, "edges": self.edges,
                "trees": [t.state() for t in self.trees], "importances": list(self.importances)}
