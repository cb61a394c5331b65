"""Hard negatives by a pivot table.

Rows become vectors of whole numbers. One more component, the square root of M^2 - |x|^2 with M the largest length of all,
puts every row on a sphere, and 0 in the same place of an anchor makes the distance of the two a falling function of their
inner product: d^2 = |q|^2 + M^2 - 2 qx. The pivot table stores each row's distances to a few pivots. By the triangle
inequality, |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) for every pivot p, which brackets the score; only rows whose
bracket meets what an anchor still looks for are multiplied out, in whole numbers.

Rows are dealt by hash into parts, so no label, cell or group of copies fills one; anchors into groups of bounded size. Each
part meets each group in one task (a stated query set against all rows, in blocks). Within a part, rows lie in cells by their
nearest pivot, and a cell whose range of distances rules an anchor out is skipped for it. A task hands on its five best for
each thing looked for, and a window over these takes the best of all: none is lost.

Two rounds: the first five of an anchor's label, then for each of them the first five of other labels in its interval of
scores. Before both, a bounded sample of rows, which also holds the pivots, gives every anchor scores that some row
surely reaches, so that brackets cut from the start. The sample only saves work: every row is in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.llm.common import settle

#: How many pivots, and of how many rows at most they and the first thresholds are chosen.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a part and anchors of a group at most, on average; and how many parts there should be where rows are few.
PART_ROWS, GROUP_ANCHORS, LEAST_PARTS, LEAST_ROWS = 16_384, 16_384, 48, 512
#: Components are whole numbers of at most this size; beyond it they count as this.
LARGEST = 1 << 24
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 80, 100


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, flip: int = 7, labels: int = 10) -> DataFrame:
    """id, label, v (floor of scale times each component) of the rows that take part: those with a label and a vector of
    finite components. A label becomes (label + 1) % labels where ``flip`` divides the id."""
    v = F.col(vector_col)
    double = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col(label_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    clamp = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(x * F.lit(scale)).cast("double"))).cast("int")
    label = F.col(label_col).cast("long")
    label = F.when(F.coalesce(F.col(id_col) % flip == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
    return kept.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(double, clamp).alias("v"))


class Pivots:
    """Distances on the sphere, as numbers with an error far below ``slack``."""

    def __init__(self, sample: np.ndarray, largest: float, count: int):
        self.m2 = largest  # M^2
        self.pivots, self.height = sample[:0].astype(np.float64), np.zeros(0)
        if len(sample):  # farthest first
            x = sample.astype(np.float64)
            rise = np.sqrt(np.maximum(0, largest - (x * x).sum(1)))
            chosen, far = [0], np.full(len(x), np.inf)
            while len(chosen) < min(count, len(x)):
                last = chosen[-1]
                far = np.minimum(far, ((x - x[last]) ** 2).sum(1) + (rise - rise[last]) ** 2)
                if far.max() <= 0:
                    break
                chosen.append(int(far.argmax()))
            self.pivots, self.height = x[chosen], rise[chosen]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self._distance(x, np.sqrt(np.maximum(0, self.m2 - (x * x).sum(1))))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distance(q.astype(np.float64), np.zeros(len(q)))

    def _distance(self, x: np.ndarray, height: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + height[:, None] ** 2 + (self.pivots**2).sum(1) + self.height**2
        return np.sqrt(np.maximum(0, square - 2 * (x @ self.pivots.T + height[:, None] * self.height)))

    def most(self, q2: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The highest score that rows at least so far apart can have, rounded up generously."""
        whole = q2 + self.m2
        return (whole - apart**2) / 2 + 1e-7 * whole + 1e-3


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by floating point where that is exact, else by integers."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if size < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _apart(dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far anchors are from a cell at least, whose distances to the pivots lie between low and high."""
    return np.maximum(0, np.maximum(dq - high, low - dq).max(1, initial=0))


#: A null id comes after all others. A floor that every score reaches, and one that none does.
NO_ID = np.iinfo(np.int64).max
NO_FLOOR, NO_SCORE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores a task holds before it keeps only the best.
HELD = 1_000_000


class Best:
    """The k highest scores of each key so far, ties by the smaller id and row."""

    def __init__(self, k: int, keys: int):
        self.k, self.floors = k, np.full(keys, NO_FLOOR)
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(4))  # key, score, id, row
        self.new: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        self.new.append((key, score, id_, row))
        self.size += len(key)
        if self.size > HELD:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        key, score, id_, row = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((row, id_, -score, key))
        key, score, id_, row = (x[order] for x in (key, score, id_, row))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        last = nth == self.k - 1
        self.floors[key[last]] = np.maximum(self.floors[key[last]], score[last])
        self.kept, self.new, self.size = tuple(x[nth < self.k] for x in (key, score, id_, row)), [], 0
        return self.kept


class Part:
    """The rows of one part in cells by their nearest pivot, ordered within a cell by their distance to it."""

    def __init__(self, rows, wide: int, pivots: int):
        stored = _matrix(rows["d"], pivots)
        near = stored.argmin(1) if pivots else np.zeros(len(stored), np.int64)
        own = stored[np.arange(len(near)), near] if pivots else np.zeros(len(near))
        order = np.lexsort((own, near))
        self.stored, self.own = stored[order], own[order]
        self.ids, self.labels, self.rows = (rows[c].fill_null(NO_ID).to_numpy()[order] for c in ("id", "label", "row"))
        self.x = _matrix(rows["v"], wide).astype(np.int64)[order]
        near = near[order]
        edges = np.append(np.flatnonzero(np.diff(near, prepend=-1)), len(near))
        self.cells = list(zip(edges[:-1].tolist(), edges[1:].tolist(), near[edges[:-1]].tolist(), strict=True))
        self.checked = self.met = 0

    def search(self, pivots: Pivots, q: np.ndarray, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All (anchors, rows, scores) of this part that reach their anchor's floor, and none below; floors may rise
        between two steps."""
        dq, q2 = pivots.of_anchors(q), (q.astype(np.float64) ** 2).sum(1)
        bounds = [pivots.most(q2, _apart(dq, self.stored[lo:hi].min(0), self.stored[lo:hi].max(0))) for lo, hi, _ in self.cells]
        for c in sorted(range(len(self.cells)), key=lambda c: -float(bounds[c].max(initial=0))):
            lo, hi, near = self.cells[c]
            self.met += (hi - lo) * len(q)
            alive = np.flatnonzero((bounds[c] >= floors) & (floors < NO_SCORE))
            for at in range(0, len(alive), 256):
                some = alive[at : at + 256]
                a, b = lo, hi
                if dq.shape[1]:  # of the cell's rows, ordered by distance to its pivot, only a range can be near enough
                    most = q2[some] + pivots.m2
                    reach = np.sqrt(np.maximum(0, most - 2 * np.maximum(floors[some], -most))) * (1 + 1e-6) + 1e-3
                    a = lo + int(np.searchsorted(self.own[lo:hi], dq[some, near] - reach).min())
                    b = lo + int(np.searchsorted(self.own[lo:hi], dq[some, near] + reach, "right").max())
                if b > a:
                    self.checked += (b - a) * len(some)
                    scores = exact_scores(q[some], self.x[a:b])
                    i, j = np.nonzero(scores >= floors[some][:, None])
                    yield some[i], a + j, scores[i, j]


def _matrix(column, wide: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, padded by zeros."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(sizes), wide), flat.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def mine(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    pivots: int = PIVOTS, sample: int = SAMPLE, part_rows: int = PART_ROWS, group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """Of :func:`whole_vectors`: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are rows
    whose id ``every`` divides; positives their first other rows of the same label, negatives the first rows of another
    label with lowest * p <= 100 * n <= highest * p.

    Edge cases: a null id is no anchor, and in ties comes last. Repeated rows are rows each: an anchor listed twice is
    two anchors with the same results (both are returned), each the other's positive. Vectors of other lengths count as
    padded by zeros; of no components, all scores are 0. Components beyond 2^24 count as that. An empty table, a label of
    one row, or no row in an interval gives no rows.
    """
    spark = vectors.sparkSession
    held = settle(vectors.withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    head = held.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m2"), F.max(F.size("v")).alias("wide"), F.count_if(F.col("id") % every == 0).alias("anchors")).first()
    n, m2, wide = head.n, float(head.m2 or 0), int(head.wide or 0)
    # A bounded sample: SAMPLE rows by hash.
    some = held.select("id", "label", "v", "row").orderBy(F.xxhash64("id", "row"), "row").limit(sample).collect()
    known = np.zeros((len(some), wide), np.int64)
    for i, r in enumerate(some):
        known[i, : len(r.v)] = r.v
    known_ids, known_labels, known_rows = (np.array([x if x is not None else NO_ID for x in (r[c] for r in some)], np.int64) for c in ("id", "label", "row"))
    table_of = Pivots(known, m2, pivots)
    parts = max(1, -(-n // part_rows), min(LEAST_PARTS, -(-n // LEAST_ROWS)))
    groups = max(1, -(-head.anchors // group_anchors))

    def store(batches) -> Iterator:
        """The pivot table: each row's distances to the pivots."""
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"], wide)
                d = table_of.of_rows(x)
                columns = [batch["id"], batch["label"], batch["row"], pa.array(list(x.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(d), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "row", "v", "d"])

    def seed(batches) -> Iterator:
        """Anchors, with scores that so many rows of the sample reach."""
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            q, labels, rows = _matrix(batch["v"], wide), batch["label"].to_numpy(), batch["row"].to_numpy()
            scores = exact_scores(q, known)
            fits = (labels[:, None] == known_labels) & (rows[:, None] != known_rows)
            floor = np.sort(np.where(fits, scores, NO_FLOOR), 1)[:, -positives] if len(some) >= positives else np.full(len(q), NO_FLOOR)
            columns = [batch["id"], batch["label"], batch["row"], batch["v"], pa.array(floor)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "row", "v", "floor"])

    held = held.select("id", "label", "row", "v")
    pivot_table = settle(held.mapInArrow(store, "id bigint, label bigint, row bigint, v array<int>, d array<double>").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")))
    anchors = held.filter(F.col("id") % every == 0)
    anchors = settle(anchors.mapInArrow(seed, "id bigint, label bigint, row bigint, v array<int>, floor bigint").withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int")))

    def meet(wanted: DataFrame, search, schema: str) -> DataFrame:
        """Every part with every group of what is wanted."""
        left = pivot_table.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else pivot_table.withColumn("group", F.lit(0))
        right = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(search, schema)

    def rows_of(own: np.ndarray, best: Best, each: int):
        import pyarrow as pa

        key, score, id_, row = best.shrink()
        columns = {"anchor": own[key // each], "nth": (key % each).astype(np.int32), "row": row, "score": score}
        return pa.table({c: pa.array(x) for c, x in columns.items()} | {"id": pa.array(id_, mask=id_ == NO_ID)}).select(["anchor", "nth", "row", "id", "score"])

    def find_positives(rows, wanted):
        own = wanted["row"].to_numpy()
        best = Best(positives, len(own))
        if rows.num_rows and wanted.num_rows:
            part = Part(rows, wide, len(table_of.pivots))
            best.floors = wanted["floor"].to_numpy().copy()
            labels = wanted["label"].to_numpy()
            for a, x, scores in part.search(table_of, _matrix(wanted["v"], wide).astype(np.int64), best.floors):
                fits = (part.labels[x] == labels[a]) & (part.rows[x] != own[a])
                best.add(a[fits], scores[fits], part.ids[x[fits]], part.rows[x[fits]])
        return rows_of(own, best, 1)

    def find_negatives(rows, wanted):
        own = wanted["row"].to_numpy()
        best = Best(negatives, len(own) * positives)
        if rows.num_rows and wanted.num_rows:
            part = Part(rows, wide, len(table_of.pivots))
            q, labels = _matrix(wanted["v"], wide).astype(np.int64), wanted["label"].to_numpy()
            seeds = exact_scores(q, known)
            low, high = np.full((2, len(own), positives), NO_SCORE)  # what a negative must reach, and may not pass
            for a, ask in enumerate(wanted["positives"].to_pylist()):
                other = seeds[a][known_labels != labels[a]]
                for x in ask:
                    k, p = x["nth"] - 1, x["score"]
                    least, most = -(-lowest * p // 100), highest * p // 100
                    if least <= most:
                        fits = np.sort(other[(other >= least) & (other <= most)])
                        low[a, k], high[a, k] = max(least, int(fits[-negatives]) if len(fits) >= negatives else NO_FLOOR), most
            best.floors = low.reshape(-1).copy()
            floors = best.floors.reshape(len(own), positives).min(1)
            for a, x, scores in part.search(table_of, q, floors):
                fits = part.labels[x] != labels[a]
                a, x, scores = a[fits], x[fits], scores[fits]
                for k in range(positives):
                    ok = np.flatnonzero((scores >= best.floors[a * positives + k]) & (scores <= high[a, k]))
                    best.add(a[ok] * positives + k, scores[ok], part.ids[x[ok]], part.rows[x[ok]])
                floors[:] = best.floors.reshape(len(own), positives).min(1)
        return rows_of(own, best, positives)

    in_order = (F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    schema = "anchor bigint, nth int, row bigint, id bigint, score bigint"
    found = meet(anchors, find_positives, schema).drop("nth")
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("anchor").orderBy(*in_order))).filter(F.col("nth") <= positives)
    chosen = found.groupBy("anchor").agg(F.collect_list(F.struct("nth", "id", "score")).alias("positives"))  # a few each
    wanted = settle(anchors.join(chosen, F.col("anchor") == F.col("row")).select("id", "label", "row", "v", "group", "positives"))

    bad = meet(wanted, find_negatives, schema)
    rank = F.row_number().over(W.partitionBy("anchor", "nth").orderBy(*in_order)).alias("rank")
    bad = bad.select("anchor", "nth", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), rank).filter(F.col("rank") <= negatives)
    good = wanted.select(F.col("row").alias("of"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    out = bad.join(good, (F.col("anchor") == F.col("of")) & (F.col("nth") == F.col("p.nth") - 1))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
