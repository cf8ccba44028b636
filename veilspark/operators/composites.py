"""Keys and foreign keys of several columns, found without a hint which columns to try."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import per_table, quoted
from . import keys as K

_AT_A_TIME = 64  # sets of columns that one pass over a table sketches
_LARGE = 100_000  # rows from which on a set of columns is tried on a part of its tuples first
_PARTS = 64
_SLACK = 1 + K._SKETCH_MARGIN * K._SKETCH_ERROR  # a true distinct count is at most so many times its estimate

_KEY_TYPE = "table_name string, columns string, width int, n_rows bigint, n_nulls bigint, kind string"
_EDGE_TYPE = (
    "child_table string, child_columns string, parent_table string, parent_columns string,"
    " n_values bigint, n_matched bigint, coverage double"
)


def _filled(columns: Sequence[str]) -> str:
    return " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)


class _Lattice:
    """The sets of columns of one table, level by level.

    A set is open if it may be part of a larger key: it is no key, and neither is a part of it. Sets of the next level
    are those all of whose parts are open. A set has at most as many distinct tuples as the product of the distinct
    counts of two sets that make it up; if that is below the number of rows, it is no key and is not looked at.
    The others are sketched, and counted exactly where the sketch allows a key.
    """

    def __init__(self, df: DataFrame, ranges: Sequence[K.ColumnRange], unique: set[str]):
        self.df = df
        self.columns = [r.column for r in ranges if r.n_filled and r.column not in unique]
        self.place = {c: i for i, c in enumerate(self.columns)}
        self.nulls = {r.column: r.n_rows - r.n_filled for r in ranges}
        self.n_rows = ranges[0].n_rows if ranges else 0
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.seen: dict[tuple[str, ...], int] = {}  # estimated distinct counts
        self.sketched = 0

    def _sketch(self, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
        """Estimates for the sets, and how many rows have all columns of each filled."""
        filled = {}
        for at in range(0, len(sets), _AT_A_TIME):
            part = sets[at : at + _AT_A_TIME]
            aggs = []
            for i, s in enumerate(part):
                value = f"CASE WHEN {_filled(s)} THEN struct({', '.join(map(quoted, s))}) END"
                aggs += [f"approx_count_distinct({value}, {K._SKETCH_ERROR}) AS d{i}", f"count_if({_filled(s)}) AS n{i}"]
            row = self.df.selectExpr(*aggs).first()
            for i, s in enumerate(part):
                self.seen[s], filled[s] = row[f"d{i}"], row[f"n{i}"]
        self.sketched += len(sets)
        return filled

    def _possible(self, s: tuple[str, ...]) -> bool:
        least = self.n_rows - sum(self.nulls[c] for c in s)  # rows that surely have all columns filled
        parts = [(s[:i] + s[i + 1 :], (c,)) for i, c in enumerate(s)]
        return all(self.seen[a] * _SLACK * self.seen[b] * _SLACK >= least for a, b in parts)

    def _exact(self, s: tuple[str, ...]) -> tuple[int, int]:
        """Rows with all columns filled and their distinct tuples, of all rows or of a part in which a tuple is repeated.

        Equal tuples have one digest, so a repeated tuple among those of some digests is proof that the set is no key. All
        rows are counted where that part has none.
        """
        values = [f"{K._compared(c, self.types[c])} AS c{i}" for i, c in enumerate(s)]
        names = ", ".join(f"c{i}" for i in range(len(s)))
        rows = self.df.filter(_filled(s)).selectExpr(*values)
        part = [rows.filter(f"pmod(xxhash64({names}), {_PARTS}) = 0")] if self.n_rows >= _LARGE else []
        for df in [*part, rows]:
            row = df.selectExpr("count(1) AS n", f"count(DISTINCT {names}) AS d").first()
            if row["n"] != row["d"]:
                break
        return row["n"], row["d"]

    def keys(self, max_width: int) -> list[tuple[tuple[str, ...], int]]:
        """(columns, rows with all of them filled) of the least sets of 2 to ``max_width`` columns that are unique."""
        found = []
        singles = [(c,) for c in self.columns]
        self._sketch(singles)
        open_ = {s for s in singles if self.seen[s] > 1}  # a constant column tells no rows apart
        base = sorted(open_, key=lambda s: self.place[s[0]])
        for width in range(2, max_width + 1):
            grown = {s + c for s in open_ for c in base if self.place[c[0]] > self.place[s[-1]]}
            whole = sorted(
                (s for s in grown if all(p in open_ for p in combinations(s, width - 1))),
                key=lambda s: [self.place[c] for c in s],
            )
            # what the bound refuses is open without a sketch of its own: the bound stands for its count
            likely = [s for s in whole if self._possible(s)]
            for s in set(whole).difference(likely):
                self.seen[s] = min(self.seen[s[:i] + s[i + 1 :]] * self.seen[(c,)] for i, c in enumerate(s))
            filled = self._sketch(likely)
            open_ = set(whole)
            for s in likely:
                if filled[s] and self.seen[s] >= filled[s] * (1 - K._SKETCH_MARGIN * K._SKETCH_ERROR):
                    n, distinct = self._exact(s)
                    if n == distinct:
                        found.append((s, n))
                        open_.discard(s)
        return found


def composite_keys(
    tables: Mapping[str, DataFrame], max_width: int = 3, ranges: Sequence[K.ColumnRange] | None = None,
    singles: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """The least groups of 2 to ``max_width`` columns whose values together identify a row.

    ``kind`` is PRIMARY KEY if no value of the group is null, else UNIQUE: rows with all columns filled differ. Groups that
    hold a key, of one column (``singles``, measured if not given) or of several, are not given. Floating-point, binary and nested
    columns take no part. Groups are refused by bounds, then by a sketch six standard deviations below the rows; all others
    are counted exactly, each by an aggregate of its own. A pass over a table sketches up to 64 groups.
    """
    spark = K._session(tables)
    ranges = K.column_ranges(tables) if ranges is None else ranges
    if singles is None:
        unique = K.candidate_keys(tables, ranges=ranges).filter("is_unique").collect()
        singles = [(r.table_name, r.columns) for r in unique]

    def one(name: str) -> list[tuple]:
        own = [r for r in ranges if r.table == name and r.kind not in ("nested", "other")]
        lattice = _Lattice(tables[name], own, {c for t, c in singles if t == name})
        rows = []
        for s, n in lattice.keys(max_width) if lattice.n_rows else ():
            kind = "PRIMARY KEY" if n == lattice.n_rows else "UNIQUE"
            rows.append((name, ",".join(s), len(s), lattice.n_rows, lattice.n_rows - n, kind))
        return rows

    found = [row for rows in per_table(spark, one, sorted(tables)) for row in rows]
    return spark.createDataFrame(found, _KEY_TYPE)


def _tuple(columns: Sequence[K.ColumnRange]) -> str:
    """The values of several columns as one text, equal for equal values only; null if one is null."""
    values = ", ".join(f"CAST({K._value(r)} AS string)" for r in columns)
    return f"CASE WHEN {_filled([r.column for r in columns])} THEN to_json(array({values})) END"


def composite_fks(
    tables: Mapping[str, DataFrame], max_width: int = 3, min_coverage: float = 1.0,
    ranges: Sequence[K.ColumnRange] | None = None, parents: Sequence[tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """Groups of child columns whose values together occur in a composite key: child_columns in the order of parent_columns.

    ``parents`` are the keys to refer to, by default what ``composite_keys`` finds. Pairs of single columns come first, by kind,
    range and sketch. Pairs with one table in common are joined, column by column of the key, to groups; no
    column is used twice or stands for itself. Sketches of the groups refute most of these, and the tuples of what is left
    meet in one shuffle, pre-aggregated. Rows with a null part refer to nothing. ``min_coverage`` counts distinct tuples;
    below 1 single columns are not refuted, only compared.
    """
    spark = K._session(tables)
    ranges = K.column_ranges(tables) if ranges is None else ranges
    if parents is None:
        found = composite_keys(tables, max_width, ranges).collect()
        parents = [(r.table_name, r.columns.split(",")) for r in found]
    members = {(t, c) for t, columns in parents for c in columns}
    ranges, pairs = K._pairs(tables, ranges, members, min_coverage)
    number = {(r.table, r.column): i for i, r in enumerate(ranges)}
    parents = [(t, list(columns)) for t, columns in parents if all((t, c) in number for c in columns)]
    if not parents:
        return spark.createDataFrame([], _EDGE_TYPE)
    rows = [(k, len(c), i, number[t, x]) for k, (t, c) in enumerate(parents) for i, x in enumerate(c)]
    wanted = spark.createDataFrame(rows, "key int, width int, nth int, parent int")
    single = wanted.join(pairs.select("child", "parent", "child_table"), "parent")
    grown = single.filter("nth = 0").selectExpr("key", "width", "child_table", "array(child) AS columns")
    done = [grown.filter("width = 1")]
    for nth in range(1, max(len(c) for _, c in parents)):
        step = single.filter(F.col("nth") == nth).select("key", "child_table", "child")
        grown = grown.filter(F.col("width") > nth).join(step, ["key", "child_table"]).filter("NOT array_contains(columns, child)")
        grown = grown.selectExpr("key", "width", "child_table", "array_append(columns, child) AS columns")
        done.append(grown.filter(F.col("width") == nth + 1))
    groups = K._union(done).select("key", "columns")
    # one row per pair of groups comes to the driver: which columns are to be read together
    chosen = groups.collect()
    expressions: dict[tuple[int, ...], int] = {}
    edges, parts = [], {}

    def numbered(columns: tuple[int, ...]) -> int:
        if columns not in expressions:
            expressions[columns] = len(expressions)
            parts.setdefault(ranges[columns[0]].table, []).append((expressions[columns], _tuple([ranges[i] for i in columns])))
        return expressions[columns]

    for r in chosen:
        table, columns = parents[r["key"]]
        child, parent = tuple(r["columns"]), tuple(number[table, c] for c in columns)
        edges.append((numbered(child), numbered(parent), ranges[child[0]].table, ",".join(ranges[i].column for i in child), table, ",".join(columns)))
    if not edges:
        return spark.createDataFrame([], _EDGE_TYPE)
    pairs = spark.createDataFrame(edges, "child int, parent int, child_table string, child_columns string, parent_table string, parent_columns string")
    if min_coverage >= 1.0:
        pairs = K.not_refuted(pairs, K.sketches(tables, parts))
    used = K._used(pairs)
    parts = {t: kept for t, x in parts.items() if (kept := [(i, v) for i, v in x if i in used])}
    if not parts:
        return spark.createDataFrame([], _EDGE_TYPE)
    counts = K._shared_values(K._union_values(tables, parts))
    names = ["child_table", "child_columns", "parent_table", "parent_columns"]
    return K._covered(counts, pairs, min_coverage).select(*names, "n_values", "n_matched", "coverage")
