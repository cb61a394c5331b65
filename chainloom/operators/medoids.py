"""Exact k-medoids of point sets, whatever their number: no sample, no cap.

A medoid is the member with the least sum of distances to its class, ties to the smaller key. The first is that of all
members; each further start is the member farthest from those before it. A round deals members to their nearest medoid and
finds each class's own, until nothing changes.

Distances of superposed shapes obey the triangle inequality, so a member's sum is at least |S(c) - n d(c, member)| for any
c of its class. A pass sums up some members with the least bounds and raises all others' bounds; a class is done
when no bound lies below its best sum. A pass reads the members once and hands the driver a few rows for each class, never
members; up to LOCAL members, one task does the same by itself. Equal shapes are one member with a weight.

Where the first pass leaves more than a quarter of a class open, bounds are raised without decompositions
(:func:`chainloom.functions.rigid.floor_sums`). Some members are pivots, whose sums over each cell of their class are found; what is
near a pivot has at least its sum over a cell, less the distance for each member there, and each cell takes the pivot that gives the most.
Then what is open meets one share of the cells after the other, and leaves once it lies above the best sum. Pivots, cells
and bounds only save work: what stays open at the end is summed up exactly.

How many members the bounds rule out depends on the shapes: in the worst case all pairs of a class are measured. A
``budget`` bounds that for very large classes: at most about so many members of a class are summed up (each over the whole class) and the
best of them is its medoid, so that work is linear in the members. Without one, which is the default, medoids are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.rigid import MICRO, SUM_SLACK, Floors, floor_blocks, floor_sums, rmsd_table, superposed_pairs
from chainloom.storage import settle

LOCAL = 4096
#: Candidates of the first pass over a class; later passes take four times as many as the one before, up to the last.
CANDIDATES, MOST_CANDIDATES = 32, 2048
ROUNDS = 10
#: Members of a part of a class that meets another one in a task, at most; parts are smaller where there would be fewer tasks than TASKS.
PART, TASKS = 16384, 64
#: Pivots of a class: one of PER_PIVOT members, PIVOTS at most.
PIVOTS, PER_PIVOT = 8192, 32
#: Cells of a class, at most, and the pivots near a member that bound its sums.
CELLS, NEAR = 256, 128
#: Sixteenths of the cells that open members meet one after the other; before each, CHECKED members with the least bounds are summed up.
SHARES, CHECKED = (1, 1, 2, 2, 2, 2, 3, 3), 16
#: So many pairs or less are met at once, as another round would take longer.
AT_ONCE = 1_000_000_000
#: How many passes bounds have to rule out three quarters of a class.
TRIALS = 1

Member = tuple[tuple, list[float]]  # key (chain, start) and flat shape


def _points(shapes) -> np.ndarray:
    x = np.array(shapes, float)
    return x.reshape(len(x), -1, 3)


class Here:
    """Members in memory, in the order of their keys."""

    def __init__(self, keys: list[tuple], shapes, budget: int | None = None):
        self.budget = budget
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        self.keys, self.x = [keys[i] for i in order], _points([shapes[i] for i in order])

    def _member(self, i: int) -> Member:
        return self.keys[i], self.x[i].reshape(-1).tolist()

    def farthest(self, medoids: list[Member]) -> Member | None:
        d = rmsd_table(self.x, _points([m[1] for m in medoids])).min(1)
        return self._member(int(d.argmax())) if d.max() > 0 else None

    def centres(self, medoids: list[Member]) -> list[Member]:
        own = rmsd_table(self.x, _points([m[1] for m in medoids])).argmin(1) if len(medoids) > 1 else np.zeros(len(self.x), int)
        out = []
        for c, medoid in enumerate(medoids or [None]):
            inside = np.flatnonzero(own == c)
            if not len(inside):
                out.append(medoid)
                continue
            least, sums, n = np.zeros(len(inside), np.int64), np.full(len(inside), -1), len(inside)
            best, some, passes = None, CANDIDATES, 0
            while len(at := np.flatnonzero((sums < 0) & ((least <= best) if best is not None else True))):
                at = at[np.argsort(least[at], kind="stable")][:some]
                some = min(MOST_CANDIDATES, 4 * some)
                d = rmsd_table(self.x[inside[at]], self.x[inside])
                sums[at] = d.sum(1)
                best = int(sums[sums >= 0].min())
                least = np.maximum(least, (np.abs(sums[at][:, None] - n * d) - 2 * n).max(0))
                if self.budget and (sums >= 0).sum() >= self.budget:
                    break
                passes += 1
                left = np.flatnonzero((sums < 0) & (least <= best))
                if passes == TRIALS and not self.budget and 4 * len(left) > n:
                    floors = floor_sums(Floors(self.x[inside[left]]), Floors(self.x[inside]), np.ones(n))
                    least[left], some = np.maximum(least[left], np.floor(MICRO * floors).astype(np.int64) - n), CANDIDATES
            out.append(self._member(int(inside[np.flatnonzero(sums == best)[0]])))
        return out


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of a batch's rows."""
    return batch["shape"].flatten().to_numpy().reshape(batch.num_rows, -1, 3), batch["w"].to_numpy()


class Spread:
    """Members of a table (chain, start, shape)."""

    def __init__(self, rows: DataFrame, budget: int | None = None):
        self.budget = budget
        same = settle(rows.groupBy("shape").agg(F.min(F.struct("chain", "start")).alias("k"), F.count(F.lit(1)).alias("w")).select("k.*", "shape", "w"))
        # As many files as tasks can work on, whatever their size.
        self.rows = settle(same.repartition(max(1, min(1024, -(-same.count() // 2048))), "chain", "start"))
        self.kind = self.rows.schema["chain"].dataType.simpleString()

    def farthest(self, medoids: list[Member]) -> Member | None:
        known = _points([m[1] for m in medoids])

        def far(batches) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    d = rmsd_table(_points(batch["shape"].to_pylist()), known).min(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], names=["chain", "start", "shape", "d"])

        found = self.rows.select("chain", "start", "shape").mapInArrow(far, f"chain {self.kind}, start bigint, shape array<double>, d bigint")
        r = found.orderBy(F.desc("d"), "chain", "start").first()
        return ((r["chain"], r["start"]), list(r["shape"])) if r and r["d"] > 0 else None

    def _sums(self, held: DataFrame, some: list, best: dict) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Points and exact sums of some members (own, chain, start, shape) by class; ``best`` follows."""
        of: dict[int, list] = {}
        for r in some:
            of.setdefault(r["own"], []).append(r)
        points = {c: _points([r["shape"] for r in rs]) for c, rs in of.items()}

        def add(batches) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    own, (x, w) = batch["own"].to_numpy(), _arrays(batch)
                    sums = [(c, i, int(s)) for c, q in points.items() if (own == c).any() for i, s in enumerate(w[own == c] @ rmsd_table(x[own == c], q))]
                    yield pa.RecordBatch.from_arrays([pa.array([s[j] for s in sums], pa.int64()) for j in range(3)], names=["own", "i", "s"])

        rows = held.filter(F.col("own").isin(list(of))).mapInArrow(add, "own bigint, i bigint, s bigint").groupBy("own", "i").agg(F.sum("s").alias("s")).collect()
        told = {c: np.zeros(len(rs), np.int64) for c, rs in of.items()}
        for own, i, s in rows:
            told[own][i] = s
            r = of[own][i]
            if own not in best or (s, (r["chain"], r["start"])) < best[own][:2]:
                best[own] = (s, (r["chain"], r["start"]), list(r["shape"]))
        return points, told

    def _least(self, held: DataFrame, open_: DataFrame, classes: list[int], sizes: dict, best: dict) -> DataFrame:
        """The open members of some classes that bounds by pivots and by shares of their class leave open; ``best`` follows."""
        kind, weight = self.kind, {c: sizes[c][1] for c in classes}
        deal = lambda k, seed: F.pmod(F.xxhash64("chain", "start", F.lit(seed)), F.lit(k)).cast("int")
        own = held.filter(F.col("own").isin(classes))
        wanted = F.lit(False)
        for c in classes:
            wanted = wanted | ((F.col("own") == c) & (deal(1 << 20, 1) < int((1 << 20) * min(PIVOTS, sizes[c][0] / PER_PIVOT) / sizes[c][0])))
        pivots: dict[int, list] = {c: [{"own": c, "chain": best[c][1][0], "start": best[c][1][1], "shape": best[c][2]}] for c in classes}
        for r in own.filter(wanted).select("own", "chain", "start", "shape").collect():
            pivots[r["own"]].append(r)
        points = {c: _points([r["shape"] for r in rs]) for c, rs in pivots.items()}
        cells = {c: max(1, min(CELLS, len(q) // 4)) for c, q in points.items()}
        ends = np.cumsum(SHARES)

        def place(batches) -> Iterator:
            import pyarrow as pa

            floors = {c: Floors(q[: cells[c]]) for c, q in points.items()}
            for batch in batches:
                at, (x, _) = batch["own"].to_numpy(), _arrays(batch)
                cell, share = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
                for c in np.unique(at).tolist():
                    i = np.flatnonzero(at == c)
                    for rows, _, d in floor_blocks(Floors(x[i]), floors[c]):  # one block wide
                        cell[i[rows]] = d.argmin(1)
                    share[i] = np.searchsorted(ends, cell[i] * ends[-1] // cells[c], "right")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(share)], names=[*batch.schema.names, "cell", "share"])

        own = settle(own.select("own", "chain", "start", "shape", "w").mapInArrow(place, f"own bigint, chain {kind}, start bigint, shape array<double>, w bigint, cell int, share int"))

        def add(table):
            import pyarrow as pa

            c, (x, w) = table["own"][0].as_py(), _arrays(table.combine_chunks().to_batches()[0])
            sums = floor_sums(Floors(points[c]), Floors(x), w)
            return pa.table({"own": pa.array([c]), "cell": table["cell"][:1], "w": pa.array([int(w.sum())]), "s": pa.array([sums.tolist()], pa.list_(pa.float64()))})

        chunks = -(-own.groupBy("own", "cell").count().agg(F.max("count")).first()[0] // PART)
        inside, means = {c: np.zeros(k) for c, k in cells.items()}, {c: np.zeros((len(q), cells[c])) for c, q in points.items()}
        for c, cell, w, s in own.groupBy("own", "cell", deal(chunks, 2)).applyInArrow(add, "own bigint, cell int, w bigint, s array<double>").collect():  # a few for each cell
            inside[c][cell] += w
            means[c][:, cell] += s
        whole = {c: m.sum(1) for c, m in means.items()}
        self._sums(held, [pivots[c][i] for c in classes for i in np.argsort(whole[c], kind="stable")[:CHECKED].tolist()], best)
        means = {c: (m / np.maximum(inside[c], 1) * (1 - 1e-6)).astype(np.float32) for c, m in means.items()}
        in_share = {c: inside[c][:, None] * (np.searchsorted(ends, np.arange(k) * ends[-1] // k, "right")[:, None] == np.arange(len(SHARES))) for c, k in cells.items()}
        top = {c: best[c][0] for c in classes}

        def near(batches) -> Iterator:
            import pyarrow as pa

            floors = {c: Floors(q) for c, q in points.items()}
            for batch in batches:
                at, x = batch["own"].to_numpy(), batch["shape"].flatten().to_numpy().reshape(batch.num_rows, -1, 3)
                floor = np.zeros((len(at), len(SHARES)), np.int64)
                for c in np.unique(at).tolist():
                    q, some = points[c], min(NEAR, len(points[c]))
                    slack = 1e-6 * means[c].max()
                    for lo in range(0, len(i := np.flatnonzero(at == c)), 64):
                        own = i[lo : lo + 64]
                        d = np.zeros((len(own), len(q)), np.float32)
                        for rows, columns, v in floor_blocks(Floors(x[own]), floors[c]):
                            d[rows, columns] = v
                        which = np.argpartition(d, some - 1, 1)[:, :some]
                        off = superposed_pairs(np.repeat(x[own], some, 0), q[which.reshape(-1)]).reshape(len(own), some).astype(np.float32)
                        most = np.stack([(means[c][p] - o[:, None]).max(0) for p, o in zip(which, off, strict=True)])
                        floor[own] = np.floor(MICRO * (np.maximum(most - slack, 0) @ in_share[c]))
                least = np.maximum(batch["least"].to_numpy(), floor.sum(1) - np.array([2 * weight[c] for c in at.tolist()], np.int64))
                kept = pa.RecordBatch.from_arrays([*(batch[n] for n in names[:4]), pa.array(least), pa.array(list(floor), pa.list_(pa.int64())), pa.array(np.zeros(len(at)))], names=names)
                yield kept.take(pa.array(np.flatnonzero(least <= np.array([top[c] for c in at.tolist()], np.int64))))

        names = ["own", "chain", "start", "shape", "least", "floor", "got"]
        schema = f"own bigint, chain {kind}, start bigint, shape array<double>, least bigint, floor array<bigint>, got double"
        left = settle(open_.select(*names[:5]).mapInArrow(near, schema))

        def meet(x, y):
            import pyarrow as pa

            s = np.zeros(x.num_rows)
            if x.num_rows and y.num_rows:
                p, (q, w) = x["shape"].combine_chunks().flatten().to_numpy().reshape(x.num_rows, -1, 3), _arrays(y.combine_chunks().to_batches()[0])
                s = floor_sums(Floors(p), Floors(q), w)
            return x.select(["own", "chain", "start"]).append_column("s", pa.array(s))

        other = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        j = 0
        while j < len(SHARES):
            n = max([r["n"] for r in left.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
            if n <= CANDIDATES:
                break
            end = j + 1 if n * max(in_share[c][:, j:].sum() for c in classes) > AT_ONCE else len(SHARES)
            met = max(int(in_share[c][:, j:end].sum()) for c in classes) + 1
            part = max(1, min(PART, int((n * met / TASKS) ** 0.5)))
            a, b = -(-n // part), -(-met // part)
            x = left.select("own", "chain", "start", "shape", deal(a, 3).alias("p"), other(b).alias("q"))
            y = own.filter(F.col("share").between(j, end - 1)).select("own", "shape", "w", other(a).alias("p"), deal(b, 3).alias("q"))
            sums = x.groupBy("own", "p", "q").cogroup(y.groupBy("own", "p", "q")).applyInArrow(meet, f"own bigint, chain {kind}, start bigint, s double")
            sums = sums.groupBy("own", "chain", "start").agg(F.sum("s").alias("s"))

            def raised(batches, end=end) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    floor = np.floor(MICRO * batch["got"].to_numpy() * (1 - SUM_SLACK)).astype(np.int64)
                    floor += batch["floor"].flatten().to_numpy().reshape(-1, len(SHARES))[:, end:].sum(1) - np.array([2 * weight[c] for c in batch["own"].to_pylist()], np.int64)
                    yield batch.set_column(4, "least", pa.array(np.maximum(batch["least"].to_numpy(), floor)))

            left = settle(left.join(sums, ["own", "chain", "start"]).withColumn("got", F.col("got") + F.col("s")).select(*names).mapInArrow(raised, schema))
            nth = F.row_number().over(W.partitionBy("own").orderBy("least", "chain", "start"))
            self._sums(held, left.withColumn("nth", nth).filter(F.col("nth") <= CHECKED).select(*names[:4]).collect(), best)
            left, j = left.filter(_below(best)), end
        return left.select(*names[:5])

    def centres(self, medoids: list[Member]) -> list[Member]:
        known = _points([m[1] for m in medoids]) if medoids else None

        def deal(batches) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    own = rmsd_table(_arrays(batch)[0], known).argmin(1) if known is not None and len(known) > 1 else np.zeros(batch.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["chain", "start", "shape", "w", "own"])

        held = settle(self.rows.mapInArrow(deal, f"chain {self.kind}, start bigint, shape array<double>, w bigint, own bigint"))
        sizes = {r["own"]: (r["n"], r["w"]) for r in held.groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()}
        best: dict[int, tuple[int, tuple, list[float]]] = {}
        was = F.lit(False)
        for (chain, start), _ in medoids:
            was = was | ((F.col("chain") == chain) & (F.col("start") == start))
        open_ = held.select("own", "chain", "start", "shape", F.when(was, -1).otherwise(0).cast("long").alias("least"))  # medoids come first
        most, summed, passes = CANDIDATES, 0, 0
        while not self.budget or summed < self.budget:
            nth = F.row_number().over(W.partitionBy("own").orderBy("least", "chain", "start"))
            some = open_.withColumn("nth", nth).filter(F.col("nth") <= most).select("own", "chain", "start", "shape").collect()
            if not some:
                break
            summed, most = summed + most, min(MOST_CANDIDATES, 4 * most)
            points, told = self._sums(held, some, best)
            keys = {(r["chain"], r["start"]) for r in some}
            top = {c: b[0] for c, b in best.items()}

            def bound(batches, points=points, keys=keys, told=told, top=top) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    if not batch.num_rows:
                        continue
                    own, x, least = batch["own"].to_numpy(), batch["shape"].flatten().to_numpy().reshape(batch.num_rows, -1, 3), batch["least"].to_numpy().copy()
                    for c, q in points.items():
                        at = np.flatnonzero(own == c)
                        if len(at):
                            new = np.abs(told[c] - sizes[c][1] * rmsd_table(x[at], q)) - 2 * sizes[c][1]
                            least[at] = np.maximum(least[at], new.max(1))
                    alive = least <= np.array([top[c] for c in own.tolist()], np.int64)
                    alive &= np.array([k not in keys for k in zip(batch["chain"].to_pylist(), batch["start"].to_pylist(), strict=True)], bool)
                    yield batch.set_column(4, "least", pa.array(least)).take(pa.array(np.flatnonzero(alive)))

            open_ = settle(open_.mapInArrow(bound, f"own bigint, chain {self.kind}, start bigint, shape array<double>, least bigint"))
            passes += 1
            if passes == TRIALS and not self.budget:
                left = open_.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()
                whole = [r["own"] for r in left if 4 * r["n"] > sizes[r["own"]][0] or r["n"] > MOST_CANDIDATES]
                if whole:
                    rest = open_.filter(~F.col("own").isin(whole))
                    open_, most = settle(self._least(held, open_.filter(F.col("own").isin(whole)), whole, sizes, best).unionByName(rest)), CANDIDATES
        return [(best[c][1], best[c][2]) if c in best else m for c, m in enumerate(medoids or [None])]


def _below(best: dict[int, tuple]) -> Column:
    """Whether a member's bound leaves it open."""
    out = F.lit(False)
    for c, b in best.items():
        out = out | ((F.col("own") == c) & (F.col("least") <= b[0]))
    return out


def find_medoids(rows: DataFrame, k: int, local: int = LOCAL, rounds: int = ROUNDS, budget: int | None = None) -> list[Member]:
    """At most ``k`` medoids of a table (chain, start, shape); fewer where there are fewer different shapes, none where it
    is empty. Keys must differ; shapes have equally many points."""
    rows = settle(rows.select("chain", F.col("start").cast("long").alias("start"), F.col("shape").cast("array<double>").alias("shape")))
    if rows.limit(local + 1).count() > local:
        return lloyd(Spread(rows, budget), k, rounds)
    kind = rows.schema["chain"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        found = lloyd(Here(list(zip(pdf["chain"], pdf["start"], strict=True)), list(pdf["shape"]), budget), k, rounds)
        return pd.DataFrame({"nth": range(len(found)), "chain": [m[0][0] for m in found], "start": [m[0][1] for m in found], "shape": [m[1] for m in found]})

    found = rows.groupBy(F.lit("all")).applyInPandas(run, f"nth bigint, chain {kind}, start bigint, shape array<double>").orderBy("nth").collect()
    return [((r["chain"], r["start"]), list(r["shape"])) for r in found]


def lloyd(members: Here | Spread, k: int, rounds: int = ROUNDS) -> list[Member]:
    medoids = members.centres([])
    while len(medoids) < k and (m := members.farthest(medoids)):
        medoids.append(m)
    for _ in range(rounds if len(medoids) > 1 else 0):
        now = members.centres(medoids)
        if now == medoids:
            break
        medoids = now
    return medoids
