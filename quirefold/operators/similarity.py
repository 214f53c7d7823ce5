"""Texts compared by their pairs of neighbouring characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import bigrams, normalize
from quirefold.session import cut_lineage

#: Rows of one side that a task compares at once; larger groups are cut into
#: tiles of it, smaller ones share a task.
TILE = 2000
#: Cells of a table of counts, and grams, that are held at once.
_CELLS, _GRAMS = 1 << 21, 2048


def with_features(df: DataFrame, text: str, into: str = "grams") -> DataFrame:
    """Adds the bigram set of the normalised text."""
    return df.withColumn("__norm", normalize(text)).withColumn(into, bigrams("__norm")).drop("__norm")


class _Rows:
    """Rows of one side of a tile: ids, sizes of their sets, and their grams
    as (row, number) in order of rows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
        self.ids, self.sizes, self.grams = ids, sizes, grams
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def cut(self, at: int, end: int) -> _Rows:
        return _Rows(self.ids[at:end], self.sizes[at:end], self.grams[self.starts[at] : self.starts[end]])


def _rows(ids: list[str], grams: list[str]) -> _Rows:
    """Pairs of characters strung together, as two code points in one number."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return _Rows(np.array(ids, dtype=object), np.array([len(x) // 2 for x in grams], dtype=np.int64), points[0::2] << 21 | points[1::2])


def _common(a: _Rows, b: _Rows) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of a, counts): how many grams rows of ``a`` share with every
    row of ``b``, for some rows at a time. Frequent grams are counted as a
    product of 0/1 tables, rare ones pair by pair."""
    step = max(1, _CELLS // max(1, len(b.ids)))
    for at in range(0, len(a.ids), step):
        part = a.cut(at, min(at + step, len(a.ids)))
        na, nb = len(part.ids), len(b.ids)
        words, col_a = np.unique(part.grams, return_inverse=True)
        row_a, row_b = np.repeat(np.arange(na), part.sizes), np.repeat(np.arange(nb), b.sizes)
        col_b = np.minimum(np.searchsorted(words, b.grams), max(0, len(words) - 1))
        known = words[col_b] == b.grams if len(words) else np.zeros(len(b.grams), dtype=bool)
        row_b, col_b = row_b[known], col_b[known]
        in_a, in_b = np.bincount(col_a, minlength=len(words)), np.bincount(col_b, minlength=len(words))
        often = in_a * in_b > na * nb / 1500
        counts = np.zeros((na, nb), dtype=np.float32)
        places = np.cumsum(often) - 1
        for first in range(0, int(often.sum()), _GRAMS):
            sides = []
            for n, row, col in ((na, row_a, col_a), (nb, row_b, col_b)):
                take = often[col] & (places[col] >= first) & (places[col] < first + _GRAMS)
                flags = np.zeros((n, min(_GRAMS, int(often.sum()) - first)), dtype=np.float32)
                flags[row[take], places[col[take]] - first] = 1
                sides.append(flags)
            counts += sides[0] @ sides[1].T
        seldom = ~often[col_a] & (in_b[col_a] > 0)
        row, col = row_a[seldom], col_a[seldom]
        if len(row):
            by = np.argsort(col_b, kind="stable")
            begins = np.cumsum(in_b) - in_b
            ends = np.cumsum(in_b[col])
            flat, low = counts.reshape(-1), 0
            while low < len(row):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _CELLS, "right")))
                n = in_b[col[low:high]]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                np.add.at(flat, np.repeat(row[low:high], n) * nb + row_b[by[np.repeat(begins[col[low:high]], n) + inside]], 1)
                low = high
        yield at, counts


def _tiles(sides: list[DataFrame], on: list[str]) -> DataFrame:
    """Rows (on, side, id, grams) dealt to the tasks that compare them:
    ``unit``, ``u`` and ``v`` (the tile on either side), ``side`` (0, 1, or 0
    in both roles if there is one table). A group is cut into tiles by the
    hash of its ids, each pair of tiles is a unit; small groups lie together
    in one."""
    alone = len(sides) == 1
    rows = None
    for i, side in enumerate(sides):
        side = side.select(*on, F.lit(i).alias("side"), "id", F.array_join("grams", "").alias("grams"))
        rows = side if rows is None else rows.unionByName(side)
    rows = rows.where(" and ".join(f"{c} is not null" for c in on))
    sizes = cut_lineage(rows.groupBy(*on).agg(*[F.sum((F.col("side") == i).cast("long")).alias(f"n{i}") for i in range(len(sides))]))
    last = f"n{len(sides) - 1}"
    large = F.greatest("n0", F.col(last) + 0) > TILE
    small = sizes.where(~large).agg(F.coalesce(F.sum("n0" if alone else F.col("n0") + F.col("n1")), F.lit(0))).first()[0]
    units = max(1, -(-small // TILE))
    deal = lambda n: F.ceil(F.greatest(F.col(n), F.lit(1)) / F.lit(TILE)).cast("int")
    # one row for each TILE rows at most: these are few
    cut = sizes.where(large).select(*[F.col(c).alias(f"__{c}") for c in on], deal("n0").alias("t0"), deal(last).alias("t1"))
    rows = rows.join(F.broadcast(cut), [F.col(c) == F.col(f"__{c}") for c in on], "left").drop(*[f"__{c}" for c in on]).fillna(1, ["t0", "t1"])
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("t0")).otherwise(F.col("t1"))).cast("int")
    rows = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("t1")).otherwise(F.col("t0")) - 1)))
    if alone:
        u, v = F.least("tile", "other"), F.greatest("tile", "other")
    else:
        u, v = F.when(F.col("side") == 0, F.col("tile")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("tile"))
    rows = rows.withColumns({"u": u, "v": v})
    unit = F.when((F.col("t0") == 1) & (F.col("t1") == 1), F.concat(F.lit("s"), F.pmod(F.xxhash64(*on), F.lit(units)).cast("string"))).otherwise(F.concat_ws("/", F.lit("t"), F.hex(F.xxhash64(*on)), "u", "v"))
    return rows.select(unit.alias("unit"), F.struct(*on).alias("g"), "u", "v", "tile", "side", "id", "grams")


def _groups(table: pa.Table) -> Iterator[tuple[dict, int, int, list[int], list[str], list[str], list[int]]]:
    """The groups of a unit: key, tiles, and what its rows are."""
    found: dict[tuple, list] = {}
    cols = [table.column(c).to_pylist() for c in ("g", "u", "v", "tile", "side", "id", "grams")]
    for g, u, v, tile, side, key, grams in zip(*cols, strict=True):
        found.setdefault((tuple(g.values()), u, v), [g, u, v, []])[3].append((side, tile, key, grams))
    yield from found.values()


def _two(rows: list[tuple], first: Callable[[tuple], bool]) -> tuple[_Rows, _Rows]:
    rows.sort(key=lambda r: r[2])
    a, b = [r for r in rows if first(r)], [r for r in rows if not first(r)]
    return _rows([r[2] for r in a], [r[3] for r in a]), _rows([r[2] for r in b], [r[3] for r in b])


def _pairs(table: pa.Table, keep: Callable) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the groups of a unit, some at a time: key, ids of the lesser and
    the greater row of pairs that ``keep(common, size, size)`` takes, their
    sizes, and what they share."""
    for g, u, v, rows in _groups(table):
        a, b = _two(rows, lambda r: r[1] == u)  # noqa: B023
        if u == v:
            b = a
        for at, counts in _common(a, b):
            part = slice(at, at + len(counts))
            hit = (counts > 0) & keep(counts.astype(np.float64), a.sizes[part, None], b.sizes[None, :])
            i, j = np.nonzero(hit)
            k, i = counts[i, j].astype(np.int64), i + at
            ids_a, ids_b, size_a, size_b = a.ids[i], b.ids[j], a.sizes[i], b.sizes[j]
            less = (i < j) if u == v else (ids_a < ids_b).astype(bool)
            if u == v:  # each pair lies twice in the table
                yield g, ids_a[less], ids_b[less], size_a[less], size_b[less], k[less]
            else:
                yield g, np.where(less, ids_a, ids_b), np.where(less, ids_b, ids_a), np.where(less, size_a, size_b), np.where(less, size_b, size_a), k


def _keyed(df: DataFrame, on: list[str]) -> str:
    return "g " + df.select(F.struct(*on).alias("g")).schema["g"].dataType.simpleString()


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def counted_pairs(df: DataFrame, on: list[str], key: str, keep: Callable) -> DataFrame:
    """Pairs of rows of one group that ``keep(common, n_a, n_b)``, on arrays,
    takes: ``on``, key_a < key_b, n_a, n_b, common. Needs ``grams``, pairs of
    characters, distinct by key (a string).

    Plan: groups are cut into tiles of TILE rows; a task gets two tiles and
    counts what all their rows share, as a product of 0/1 tables. So nothing
    is written per gram or per pair that isn't kept, and a hot group is spread
    over as many tasks as it has pairs of tiles.
    """
    tiles = _tiles([df.select(*on, F.col(key).alias("id"), "grams")], on)
    schema = f"{_keyed(df, on)}, key_a string, key_b string, n_a bigint, n_b bigint, common bigint"
    arrow = _arrow(schema, df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([g] * len(a), arrow.field("g").type), pa.array(a, pa.string()), pa.array(b, pa.string()), *map(pa.array, (n, m, k))], schema=arrow) for g, a, b, n, m, k in _pairs(table, keep) if len(a)]
        return pa.concat_tables(out) if out else arrow.empty_table()

    return tiles.groupBy("unit").applyInArrow(run, schema).select("g.*", "key_a", "key_b", "n_a", "n_b", "common")


def earlier_alike(df: DataFrame, on: list[str], key: str, keep: Callable) -> DataFrame:
    """Per row the rows of lesser key in its group that ``keep`` takes, as in
    :func:`counted_pairs`: ``on``, key, ``first`` (the least), n. Added up in
    the tasks, so the pairs aren't written."""
    tiles = _tiles([df.select(*on, F.col(key).alias("id"), "grams")], on)
    schema = f"{_keyed(df, on)}, id string, first string, n bigint"
    arrow = _arrow(schema, df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for g, a, b, _, _, _ in _pairs(table, keep):
            if len(a):
                names, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
                low, high = numbers[: len(a)], numbers[len(a) :]
                first = np.full(len(names), len(names))
                np.minimum.at(first, high, low)
                n = np.bincount(high, minlength=len(names))
                some = n > 0
                out.append(pa.table([pa.array([g] * int(some.sum()), arrow.field("g").type), pa.array(names[some], pa.string()), pa.array(names[first[some]], pa.string()), pa.array(n[some])], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    parts = tiles.groupBy("unit").applyInArrow(run, schema)
    return parts.groupBy("g", "id").agg(F.min("first").alias("first"), F.sum("n").alias("n")).select("g.*", F.col("id").alias(key), "first", "n")


def best_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """For each left row the right row of the same ``on`` that covers most of
    its bigrams: ``on``, left_id, right_id, score; ties go to the least
    right_id. Both sides need ``grams`` and ids that are strings; rows of a
    group and an id are the same. Left rows that share no bigram with any right row give none.

    Plan: as :func:`counted_pairs`; of each pair of tiles only the best of
    each left row is written.
    """
    tiles = _tiles([left.select(*on, F.col(left_id).alias("id"), "grams"), right.select(*on, F.col(right_id).alias("id"), "grams")], on)
    schema = f"{_keyed(left, on)}, l string, r string, n bigint, k bigint"
    arrow = _arrow(schema, left.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        for g, _, _, rows in _groups(table):
            a, b = _two(rows, lambda r: r[0] == 0)
            for at, counts in _common(a, b) if len(a.ids) and len(b.ids) else ():
                j = counts.argmax(axis=1)  # the first, that is the least id
                k = counts[np.arange(len(j)), j].astype(np.int64)
                some = np.nonzero(k)[0]
                for x, y in zip(cols, ([g] * len(some), a.ids[at + some], b.ids[j[some]], a.sizes[at + some].tolist(), k[some].tolist()), strict=True):
                    x.extend(y)
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    parts = tiles.groupBy("unit").applyInArrow(run, schema)
    best = parts.groupBy("g", "l").agg(F.min_by(F.struct("r", "n", "k"), F.struct(-F.col("k"), F.col("r"))).alias("b"))
    return best.select("g.*", F.col("l").alias(left_id), F.col("b.r").alias(right_id), (F.col("b.k") / F.col("b.n")).alias("score"))


def near_pairs(df: DataFrame, on: list[str], key: str, least: float = 0.8) -> DataFrame:
    """Pairs of rows of one group whose bigram sets have a Dice value of at
    least ``least``: ``on``, key_a < key_b, dice. Needs ``grams``, distinct by
    key; copies of one set should be reduced to one row before.

    Plan: :func:`counted_pairs`.
    """
    pairs = counted_pairs(df, on, key, lambda k, n, m: 2 * k / (n + m) >= least - 1e-12)
    return pairs.select(*on, "key_a", "key_b", (2 * F.col("common") / (F.col("n_a") + F.col("n_b"))).alias("dice"))


def greedy_novelty(nodes: DataFrame, pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Of ``nodes`` those that are not alike to any kept one before them in
    ``order`` (distinct per key): the result of going through them one by one.

    ``pairs``: key_a, key_b of alike nodes. Done in rounds instead of one by
    one: an undecided node is kept when all its earlier partners are dropped,
    and dropped when one of them is kept. Each round settles at least the
    first undecided node of every connected part; only nodes with partners
    take part, and each round's state is written.
    """
    at = nodes.select(F.col(key).alias("k"), F.col(order).alias("o")).distinct()
    a = at.select(F.col("k").alias("key_a"), F.col("o").alias("oa"))
    b = at.select(F.col("k").alias("key_b"), F.col("o").alias("ob"))
    both = pairs.select("key_a", "key_b").join(a.hint("merge"), "key_a").join(b.hint("merge"), "key_b")
    first = F.when(F.struct("oa", "key_a") < F.struct("ob", "key_b"), F.struct(F.col("key_a").alias("early"), F.col("key_b").alias("late"))).otherwise(F.struct(F.col("key_b").alias("early"), F.col("key_a").alias("late")))
    edges = cut_lineage(both.select(first.alias("e")).select("e.early", "e.late").distinct())
    kept = dropped = None
    open_ = edges
    while not open_.isEmpty():
        late = open_.select(F.col("late").alias("k")).distinct()
        now = open_.select(F.col("early").alias("k")).distinct().join(late, "k", "left_anti")  # no earlier partner is open
        now = cut_lineage(now)
        gone = cut_lineage(open_.join(now.select(F.col("k").alias("early")), "early").select(F.col("late").alias("k")).distinct())
        kept = now if kept is None else kept.unionByName(now)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        settled = now.unionByName(gone)
        open_ = cut_lineage(open_.join(settled.select(F.col("k").alias("early")), "early", "left_anti").join(settled.select(F.col("k").alias("late")), "late", "left_anti"))
    if dropped is None:
        return nodes
    return nodes.join(dropped.select(F.col("k").alias(key)).distinct().hint("merge"), key, "left_anti")
