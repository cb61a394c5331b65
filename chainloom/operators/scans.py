"""Long chains by scans: blocks are summed up side by side, their sums put together level by level.

Everything here is an associative product over the rows of a chain, so no task holds more than ``block`` rows of it, and
the number of levels is the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.rigid import Summary
from chainloom.functions.rigid import walk as walk_bonds
from chainloom.storage import settle

BLOCK = 256

#: So many numbers, about, stand in a list of products.
NUMBERS = 4096

#: Products of many lists of rows at once: (lists of flat rows) -> one flat row each.
Product = Callable[[list[np.ndarray]], np.ndarray]


def product_of_summaries(lists: list[np.ndarray]) -> np.ndarray:
    """The summary of each list's blocks, in order; all lists advance together."""
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    rows = [lists[i] for i in order]
    sizes = np.array([len(x) for x in rows])
    done = np.stack([x[0] for x in rows])
    for k in range(1, int(sizes[0])):
        n = int((sizes > k).sum())
        done[:n] = Summary.of_flat(done[:n]).then(Summary.of_flat(np.stack([x[k] for x in rows[:n]]))).flat()
    out = np.empty_like(done)
    out[order] = done
    return out


def arrays(column) -> list[np.ndarray]:
    """Each row's numbers of an Arrow column of lists, nulls as NaN; of lists of equally long lists, a table a row."""
    inner, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1]
    if hasattr(inner, "flatten") and hasattr(inner, "value_lengths"):
        flat = inner.flatten().to_numpy(zero_copy_only=False)
        return np.split(flat.reshape(len(inner), -1 if len(flat) else 0), ends)
    return np.split(inner.to_numpy(zero_copy_only=False), ends)


def few_rows(batches, rows: int) -> Iterator:
    """The batches in slices of some rows, so that what a task makes of them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def flat_lists(table: np.ndarray):
    """An Arrow column with a row of a table in each row."""
    import pyarrow as pa

    table = np.ascontiguousarray(table, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.reshape(-1)))


def products(rows: DataFrame, product: Product = product_of_summaries, block: int = BLOCK) -> DataFrame:
    """(chain, sums): the product over each chain of a table (chain, pos, sums), positions from 0 without gaps."""
    kind = rows.schema["chain"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa

        for part in few_rows(batches, 64):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat_lists(product(arrays(part.column(2))))], names=["chain", "pos", "sums"])

    rows = rows.select("chain", F.col("pos").cast("long").alias("pos"), "sums")
    most = rows.agg(F.max("pos")).first()[0]
    while most is not None:
        lists = rows.groupBy("chain", F.floor(F.col("pos") / block).cast("long").alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "sums"))).alias("all"))
        rows = settle(lists.select("chain", "at", F.transform("all", lambda x: x["sums"]).alias("all")).mapInArrow(run, f"chain {kind}, pos bigint, sums array<double>"))
        most //= block
        if most == 0:
            break
    return rows.select("chain", "sums")


#: Of rows of products: (n, width) and (n, width) -> (n, width).
Then = Callable[[np.ndarray, np.ndarray], np.ndarray]


def running(rows: DataFrame, unit: np.ndarray, then: Then, block: int = BLOCK, apply: Then | None = None) -> DataFrame:
    """(chain, pos, sums): the product of all that stands before each row of a chain, from ``unit`` on, by the associative
    ``then``, which takes many rows at once. Each level multiplies its blocks by themselves; on the way back it hands every
    block what lies before it. Where a product acts on something smaller than itself, as a matrix on a vector, ``apply`` and
    its ``unit`` say so. A task holds a few blocks at a time, whose rows advance together."""
    kind = rows.schema["chain"].dataType.simpleString()
    schema = f"chain {kind}, pos bigint, sums array<double>"
    act = apply or then

    def walk(up: bool):
        def run(batches) -> Iterator:
            import pyarrow as pa

            for part in few_rows(batches, 64):
                own = arrays(part.column(2))
                order = sorted(range(len(own)), key=lambda i: -len(own[i]))
                sizes = np.array([len(own[i]) for i in order])
                sorted_ = part.take(pa.array(order, pa.int64()))
                at = sorted_.column(1).to_numpy()
                if up:
                    now = np.stack([own[i][0] for i in order])
                else:
                    before = arrays(sorted_.column(3))
                    now = np.stack([b if len(b) else unit for b in before])
                out: tuple[list, list, list] = ([], [], [])
                for k in range(1 if up else 0, int(sizes[0])):
                    n = int((sizes > k).sum())
                    if not up:
                        out[0].append(np.arange(n)), out[1].append(at[:n] * block + k), out[2].append(now[:n].copy())
                    now[:n] = (then if up else act)(now[:n], np.stack([own[i][k] for i in order[:n]]))
                rows_, places, sums = (np.arange(len(own)), at, now) if up else (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([sorted_.column(0).take(pa.array(rows_, pa.int64())), pa.array(places, pa.int64()), flat_lists(sums)], names=["chain", "pos", "sums"])

        return run

    def lists(level: DataFrame) -> DataFrame:
        each = level.groupBy("chain", F.floor(F.col("pos") / block).cast("long").alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "sums"))).alias("all"))
        return each.select("chain", "at", F.transform("all", lambda x: x["sums"]).alias("all"))

    level = settle(rows.select("chain", F.col("pos").cast("long").alias("pos"), "sums"))
    most, levels = level.agg(F.max("pos")).first()[0], [level]
    while most is not None and most >= block:
        level = settle(lists(level).mapInArrow(walk(True), schema))
        levels.append(level)
        most //= block
    before = None
    for level in reversed(levels):
        each = lists(level)
        if before is None:
            each = each.withColumn("before", F.lit(None).cast("array<double>"))
        else:
            each = each.join(before.select("chain", F.col("pos").alias("at"), F.col("sums").alias("before")), ["chain", "at"])
        before = settle(each.select("chain", "at", "all", "before").mapInArrow(walk(False), schema))
    return before


NO_MOTION = np.concatenate([np.eye(3).reshape(-1), np.zeros(3)])


def motion_then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of rigid motions (12 numbers: rotation, move), each after another."""
    r, s = a[:, :9].reshape(-1, 3, 3), b[:, :9].reshape(-1, 3, 3)
    return np.concatenate([(r @ s).reshape(-1, 9), a[:, 9:] + np.einsum("nij,nj->ni", r, b[:, 9:])], 1)


def running_motions(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chain, pos, sums): the motion before each row of a chain."""
    return running(rows, NO_MOTION, motion_then, block)


def rebuild_long(rows: DataFrame, chain: str, pos: str, length: str, angle: str, torsion: str, block: int = BLOCK) -> DataFrame:
    """(chain, pos, x, y, z) of every point from internal coordinates, as ``clusters.rebuild`` gives it, where a chain is
    dealt over many tasks. Bonds are numbered from 0 without gaps; the first angle and the first two torsions don't count.

    Only the motions of whole blocks are multiplied up; then each block walks its own bonds from the motion before it, a few
    blocks of a task side by side. Edge cases: a chain of no bonds has no rows; equal chain names are one chain."""
    kind = rows.schema[chain].dataType.simpleString()
    bonds = rows.select(F.col(chain).alias("chain"), F.col(pos).cast("long").alias("pos"), F.col(length).cast("double").alias("len"), F.when(F.col(pos) > 0, F.col(angle)).cast("double").alias("ang"), F.when(F.col(pos) > 1, F.col(torsion)).cast("double").alias("dih"))
    each = bonds.groupBy("chain", F.floor(F.col("pos") / block).cast("long").alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "len", "ang", "dih"))).alias("all"))
    each = settle(each.select("chain", F.col("at").alias("pos"), *[F.col(f"all.{c}").alias(c) for c in ("len", "ang", "dih")]))

    def walked(batches) -> Iterator:
        """Of rows with equally many bonds: these rows, their atoms, and their motions."""
        import pyarrow as pa

        for part in few_rows(batches, 64):
            sizes = part.column(2).value_lengths().to_numpy()
            for n in np.unique(sizes):
                own = part.filter(pa.array(sizes == n))
                atoms, r, t = walk_bonds(*(np.stack(arrays(own.column(c))) for c in (2, 3, 4)))
                yield own, atoms, np.concatenate([r.reshape(-1, 9), t], 1)

    def motion(batches) -> Iterator:
        import pyarrow as pa

        for own, _, sums in walked(batches):
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), flat_lists(sums)], names=["chain", "pos", "sums"])

    def place(batches) -> Iterator:
        import pyarrow as pa

        for own, atoms, _ in walked(batches):
            m, at, n = np.stack(arrays(own.column(5))), own.column(1).to_numpy(), atoms.shape[1]
            points = np.einsum("nij,nkj->nki", m[:, :9].reshape(-1, 3, 3), atoms) + m[:, None, 9:]
            first = np.flatnonzero(at == 0)  # these chains' own first points
            which = pa.array(np.concatenate([first, np.repeat(np.arange(len(at)), n)]), pa.int64())
            places = np.concatenate([np.zeros(len(first), np.int64), (at[:, None] * block + 1 + np.arange(n)).reshape(-1)])
            xyz = np.concatenate([np.zeros((len(first), 3)), points.reshape(-1, 3)])
            yield pa.RecordBatch.from_arrays([own.column(0).take(which), pa.array(places, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in xyz.T)], names=["chain", "pos", "x", "y", "z"])

    before = running_motions(each.mapInArrow(motion, f"chain {kind}, pos bigint, sums array<double>"), block)
    both = each.join(before.select("chain", "pos", F.col("sums").alias("before")), ["chain", "pos"])
    return both.select("chain", "pos", "len", "ang", "dih", "before").mapInArrow(place, f"chain {kind}, pos bigint, x double, y double, z double")


def segment_long(rows: DataFrame, chain: str, pos: str, value: str, most: int, penalty: float, block: int = BLOCK) -> DataFrame:
    """(chain, best, lo, hi): the best segmentation of each chain as ``clusters.segment`` scores it (minus the squared
    deviation from the segment's mean, minus a penalty), where a chain is dealt over many tasks.

    A block of items turns the best scores at the last ``most`` cuts before it into those at its own last cuts: a matrix
    of maxima and sums. Their products reach every block; backwards, each block says from which cut before it the best way
    to any of its own comes, maps that are put together the same way; then each block traces its own part. A segment
    belongs to the block that it ends in. Positions count from 0 without gaps; ties go to the shorter last segment."""
    if block < most:
        raise ValueError("a block must hold the longest segment")
    kind = rows.schema[chain].dataType.simpleString()
    own = rows.select(F.col(chain).alias("chain"), F.col(pos).cast("long").alias("pos"), F.col(value).cast("double").alias("v"))
    at = F.floor(F.col("pos") / block).cast("long")
    # The last items before a block are needed there as well.
    places = F.when((F.col("pos") % block) >= block - (most - 1), F.array(at, at + 1)).otherwise(F.array(at))
    each = own.select("chain", F.explode(places).alias("at"), "pos", "v").groupBy("chain", "at").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("all"))
    each = settle(each.select("chain", F.col("at").alias("pos"), F.transform("all", lambda x: x["v"]).alias("v"), F.element_at("all", -1)["pos"].alias("last")).filter(F.col("last") >= F.col("pos") * block))

    def scores(x: np.ndarray, before: int) -> np.ndarray:
        """score[i, e, l]: of the segment of l + 1 items that ends with item e of block i; ``before`` items come first."""
        zero = np.zeros((len(x), 1))
        s, q = np.concatenate([zero, np.cumsum(x, 1)], 1), np.concatenate([zero, np.cumsum(x * x, 1)], 1)
        n = x.shape[1] - before
        table = np.full((len(x), n, most), -np.inf)
        for width in range(1, most + 1):
            e = np.arange(n) + before + 1
            ok = e - width >= 0
            total = s[:, e[ok]] - s[:, e[ok] - width]
            table[:, ok, width - 1] = -(q[:, e[ok]] - q[:, e[ok] - width] - total**2 / width) - penalty
        return table

    def forward(table: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores at the cuts (most before the block, newest last, then its own) of each block for columns of starts;
        back pointers."""
        k, n = table.shape[:2]
        best = np.concatenate([start, np.full((k, n, start.shape[2]), -np.inf)], 1)
        back = np.zeros((k, n, start.shape[2]), np.int64)
        for e in range(n):
            ways = best[:, e : e + most][:, ::-1] + table[:, e, :, None]
            back[:, e] = ways.argmax(1) + 1
            best[:, most + e] = ways.max(1)
        return best, back

    def alike(batches) -> Iterator:
        """Rows with equally many items, and their scores."""
        import pyarrow as pa

        for part in few_rows(batches, 64):
            at, values = part.column(1).to_numpy(), arrays(part.column(2))
            shapes = np.array([(min(most - 1, int(a) * block), len(v)) for a, v in zip(at, values, strict=True)])
            for before, n in np.unique(shapes, axis=0):
                same = (shapes == (before, n)).all(1)
                yield part.filter(pa.array(same)), scores(np.stack([values[i] for i in np.flatnonzero(same)]), int(before))

    def starts(column) -> np.ndarray:
        return np.stack(arrays(column))[:, :, None]

    def matrices(batches) -> Iterator:
        import pyarrow as pa

        for own, table in alike(batches):
            start = np.broadcast_to(np.where(np.eye(most, dtype=bool), 0.0, -np.inf), (len(table), most, most))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), flat_lists(forward(table, start)[0][:, -most:].reshape(len(table), -1))], names=["chain", "pos", "sums"])

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, most, most), b.reshape(-1, most, most)
        return (b[:, :, :, None] + a[:, None]).max(2).reshape(len(a), -1)

    steps = each.select("chain", "pos", "v").mapInArrow(matrices, f"chain {kind}, pos bigint, sums array<double>")
    start = np.full(most, -np.inf)
    start[-1] = 0.0
    # Matrices are wide: so few in a list that it stays small.
    entry = running(steps, start, product, max(2, min(block, NUMBERS // most**2)), lambda v, m: (m.reshape(-1, most, most) + v[:, None]).max(2))

    def maps(batches) -> Iterator:
        import pyarrow as pa

        for own, table in alike(batches):
            back_, n = forward(table, starts(own.column(3)))[1][:, :, 0], table.shape[1]
            # origin[:, most - 1 + e]: of the cut that the best way to cut e of the block comes from, at or before its start
            origin = np.tile(np.arange(most + n), (len(table), 1))
            for e in range(1, n + 1):
                origin[:, most - 1 + e] = np.take_along_axis(origin, most - 1 + e - back_[:, e - 1 : e], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), flat_lists(origin[:, n : n + most])], names=["chain", "pos", "sums"])

    # Settled, so that the plan knows how few there are: one chain's blocks don't gather in one task for its end.
    lasts = settle(each.groupBy("chain").agg(F.max("pos").alias("end")))
    both = each.select("chain", "pos", "v").join(entry.select("chain", "pos", F.col("sums").alias("entry")), ["chain", "pos"])
    back = both.mapInArrow(maps, f"chain {kind}, pos bigint, sums array<double>").join(lasts, "chain")
    back = back.select("chain", (F.col("end") - F.col("pos")).alias("pos"), "sums")  # from the last block on
    exits = running(back, np.array([most - 1.0]), lambda a, b: np.take_along_axis(b, a.astype(int), 1), block)
    exits = exits.join(lasts, "chain").select("chain", (F.col("end") - F.col("pos")).alias("pos"), F.col("sums").alias("exit"))

    def trace(batches) -> Iterator:
        import pyarrow as pa

        for own, table in alike(batches):
            best, back_ = (x[:, :, 0] for x in forward(table, starts(own.column(3))))
            at, i = own.column(1).to_numpy(), np.arange(len(table))
            e = table.shape[1] - (most - 1) + np.stack(arrays(own.column(4)))[:, 0].astype(int)
            out: tuple[list, list, list, list] = ([], [], [], [])
            while len(i := i[e[i] > 0]):
                lo = e[i] - back_[i, e[i] - 1]
                for column, v in zip(out, (i, at[i] * block + lo, at[i] * block + e[i], best[i, most - 1 + e[i]]), strict=True):
                    column.append(v)
                e[i] = lo
            if out[0]:
                which, lo, hi, so_far = (pa.array(np.concatenate(c)) for c in out)
                yield pa.RecordBatch.from_arrays([own.column(0).take(which), lo, hi, so_far], names=["chain", "lo", "hi", "so_far"])

    met = each.select("chain", "pos", "v").join(entry.select("chain", "pos", F.col("sums").alias("entry")), ["chain", "pos"]).join(exits, ["chain", "pos"])
    found = settle(met.select("chain", "pos", "v", "entry", "exit").mapInArrow(trace, f"chain {kind}, lo bigint, hi bigint, so_far double"))
    total = settle(found.groupBy("chain").agg(F.max_by("so_far", "hi").alias("best")))
    return found.join(total, "chain").select("chain", "best", "lo", "hi")
