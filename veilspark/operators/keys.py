"""Keys, foreign keys and rules, measured from the data.

Statistics are taken table by table, by independent jobs from a bounded pool, so that time and plans grow with
the tables asked for and not with their product. What comes to the driver is one row per column.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..sources.tables import per_table, quoted
from .catalog import _union

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_PREFIX = 64  # texts are compared by their first characters for ranges, and by digest when longer
_SKETCH_ERROR = 0.05  # relative standard deviation of the distinct-count sketch
_SKETCH_MARGIN = 6  # standard deviations below its values at which a column is no key

# types of columns that can refer to each other, and how their values compare
_KINDS = (
    ("int", _INTEGRAL),
    ("text", (T.StringType,)),
    ("date", (T.DateType,)),
    ("timestamp", (T.TimestampType, T.TimestampNTZType)),
    ("decimal", (T.DecimalType,)),
    ("boolean", (T.BooleanType,)),
    ("nested", _NESTED),
)


@dataclass(frozen=True)
class ColumnRange:
    """What one scan tells about a column; texts are cut to a prefix, which keeps their order."""

    table: str
    column: str
    kind: str
    n_rows: int
    n_filled: int
    low: int | str | None
    high: int | str | None

    def may_be_unique(self) -> bool:
        """False if there are more values than whole numbers between the smallest and the largest."""
        if self.kind != "int" or self.low is None:
            return True
        return self.high - self.low + 1 >= self.n_filled


def _kind(data_type: T.DataType) -> str:
    return next((name for name, types in _KINDS if isinstance(data_type, types)), "other")


def _session(tables: Mapping[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def column_ranges(tables: Mapping[str, DataFrame]) -> list[ColumnRange]:
    """Row and value counts of all columns, and ranges of whole numbers.

    One row per table comes to the driver. Over ``footer_tables`` no data is read for it.
    """

    def one(name: str) -> list[ColumnRange]:
        df = tables[name]
        aggs = ["count(1) AS n"]
        for i, f in enumerate(df.schema.fields):
            c = quoted(f.name)
            aggs.append(f"count({c}) AS filled{i}")
            if isinstance(f.dataType, _INTEGRAL):
                aggs += [f"min({c}) AS low{i}", f"max({c}) AS high{i}"]
        r = df.selectExpr(*aggs).first().asDict()
        return [
            ColumnRange(name, f.name, _kind(f.dataType), r["n"], r[f"filled{i}"], r.get(f"low{i}"), r.get(f"high{i}"))
            for i, f in enumerate(df.schema.fields)
        ]

    return [r for rows in per_table(_session(tables), one, sorted(tables)) for r in rows]


def with_text_ranges(
    tables: Mapping[str, DataFrame], ranges: Sequence[ColumnRange]
) -> list[ColumnRange]:
    """The same with ranges of text columns; reads the text columns once."""
    texts: dict[str, list[str]] = {}
    for r in ranges:
        if r.kind == "text":
            texts.setdefault(r.table, []).append(r.column)

    def one(name: str) -> dict:
        aggs = []
        for i, c in enumerate(texts[name]):
            aggs += [f"min(left({quoted(c)}, {_PREFIX})) AS low{i}", f"max(left({quoted(c)}, {_PREFIX})) AS high{i}"]
        r = tables[name].selectExpr(*aggs).first()
        return {(name, c): (r[f"low{i}"], r[f"high{i}"]) for i, c in enumerate(texts[name])}

    ends: dict = {}
    for found in per_table(_session(tables), one, list(texts)):
        ends |= found
    return [
        replace(r, low=ends[r.table, r.column][0], high=ends[r.table, r.column][1]) if r.kind == "text" else r
        for r in ranges
    ]


def _compared(column: str, data_type: T.DataType) -> str:
    """An expression that is equal for equal values only: long texts stand for themselves by SHA-256."""
    c = quoted(column)
    if isinstance(data_type, T.StringType):
        return f"if(octet_length({c}) > {_PREFIX}, concat('sha256:', sha2({c}, 256)), {c})"
    return c


def sketched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of estimated distinct counts, ``d0`` for the first column and so on; reads these columns only."""
    return df.selectExpr(*[f"approx_count_distinct({quoted(c)}, {_SKETCH_ERROR}) AS d{i}" for i, c in enumerate(columns)])


_KEY_TYPE = (
    "table_name string, columns string, n_rows bigint, n_nulls bigint, is_unique boolean, kind string"
)


def _key_row(table: str, columns: str, rows: int, filled: int, unique: bool) -> tuple:
    kind = ("PRIMARY KEY" if rows == filled else "UNIQUE") if unique else ""
    return (table, columns, rows, rows - filled, unique, kind)


def candidate_keys(
    tables: Mapping[str, DataFrame],
    composites: Mapping[str, Sequence[Sequence[str]]] | None = None,
    ranges: Sequence[ColumnRange] | None = None,
) -> DataFrame:
    """Which columns, and which given column groups, identify a row.

    ``kind`` is PRIMARY KEY (all values differ, none is null), UNIQUE (all that are not null differ) or
    empty. Whole-number columns with fewer possible values than rows are no keys. Of the others one pass takes a
    sketch of the distinct count; a column that the sketch puts six standard deviations below its values is no
    key. What is left is counted exactly, each column by an aggregate of its own, pre-aggregated before the
    shuffle, with long texts shuffled as digests.
    """
    ranges = column_ranges(tables) if ranges is None else ranges
    by_table: dict[str, list[ColumnRange]] = {}
    for r in ranges:
        if r.kind != "nested":
            by_table.setdefault(r.table, []).append(r)

    def exact(df: DataFrame, columns: Sequence[str]) -> tuple[int, int]:
        types = {f.name: f.dataType for f in df.schema.fields}
        filled = " AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns)
        values = [f"{_compared(c, types[c])} AS c{i}" for i, c in enumerate(columns)]
        distinct = ", ".join(f"c{i}" for i in range(len(columns)))
        r = df.filter(filled).selectExpr(*values).selectExpr("count(1) AS n", f"count(DISTINCT {distinct}) AS d").first()
        return r["n"], r["d"]

    def open_columns(name: str) -> set[str]:
        chosen = [r for r in by_table.get(name, []) if r.may_be_unique()]
        if not chosen:
            return set()
        seen = sketched(tables[name], [r.column for r in chosen]).first()
        far = 1 - _SKETCH_MARGIN * _SKETCH_ERROR
        return {r.column for i, r in enumerate(chosen) if seen[f"d{i}"] >= r.n_filled * far}

    names, spark = sorted(tables), _session(tables)
    left = dict(zip(names, per_table(spark, open_columns, names)))
    groups = [(t, (r.column,)) for t in names for r in by_table.get(t, []) if r.column in left[t]]
    groups += [(t, tuple(g)) for t in names for g in (composites or {}).get(t, ())]
    counted = dict(zip(groups, per_table(spark, lambda g: exact(tables[g[0]], g[1]), groups)))
    found = []
    for t in names:
        n_rows = by_table[t][0].n_rows if t in by_table else 0
        for r in by_table.get(t, []):
            filled, distinct = counted.get((t, (r.column,)), (r.n_filled, -1))
            found.append(_key_row(t, r.column, n_rows, filled, filled == distinct))
        for g in (composites or {}).get(t, ()):
            filled, distinct = counted[t, tuple(g)]
            found.append(_key_row(t, ",".join(g), n_rows, filled, filled == distinct))
    return spark.createDataFrame(found, _KEY_TYPE)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def check_violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that break each rule, all rules in one scan. As in SQL, an unknown outcome passes."""
    broken = [
        F.count_if(~F.coalesce(F.expr(rule), F.lit(True))).alias(f"r{i}")
        for i, rule in enumerate(rules.values())
    ]
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(rule).alias("condition"),
            F.col("n").alias("n_rows"),
            F.col(f"r{i}").alias("n_violations"),
        )
        for i, (name, rule) in enumerate(rules.items())
    ]
    return df.agg(F.count(F.lit(1)).alias("n"), *broken).select(F.inline(F.array(*rows)))


def rule_breakers(df: DataFrame, rule: str) -> DataFrame:
    """The rows that break one rule."""
    return df.filter(~F.coalesce(F.expr(rule), F.lit(True)))


def _bare(column: str) -> str:
    return column.split("_", 1)[-1].lower()


_EDGE_TYPE = (
    "child_table string, child_column string, parent_table string, parent_column string,"
    " n_values bigint, n_matched bigint, coverage double, name_match boolean"
)
_COLUMN_TYPE = (
    "id int, table string, column string, kind string, low string, high string, name string, is_key boolean,"
    " low_bin int, high_bin int"
)
_BIN_LEVELS = 6  # bins of range ends: two to this power at most
_BIN_COLUMNS = 32  # columns for each bin, below that power
_SKETCH_SIZE = 10  # a column's sketch holds its two to this power least hashes


def range_bins(ranges: Sequence[ColumnRange]) -> tuple[int, list[tuple[int, int]]]:
    """How often the ends of ranges are halved into bins, and the bins of both ends of each column, kind by kind."""
    levels = min(_BIN_LEVELS, (len(ranges) // _BIN_COLUMNS).bit_length())
    cuts = {}
    for kind in {r.kind for r in ranges}:
        ends = sorted(x for r in ranges if r.kind == kind for x in (r.low, r.high) if x is not None)
        cuts[kind] = [ends[i * len(ends) >> levels] for i in range(1, 1 << levels)] if ends else []

    def place(kind: str, end: int | str | None) -> int:
        return 0 if end is None else bisect_right(cuts[kind], end)

    return levels, [(place(r.kind, r.low), place(r.kind, r.high)) for r in ranges]


def candidate_pairs(columns: DataFrame, levels: int, within: bool = True) -> DataFrame:
    """Pairs (child, parent) of columns of one kind whose parent is a key; ``within``: and whose range holds the child's.

    A containment join without a loop over all pairs. A child's ends are a point in two rows of bins, and a parent's range
    is the corner of points that it holds. A corner is a few dyadic blocks in each of the two rows; a point lies in one
    block per size. Pairs meet in the one pair of blocks that holds the point and is part of the corner, so the join has as
    many keys as there are blocks, and reads few pairs beside those that it gives.
    """
    if not within:
        return columns.alias("c").join(columns.filter("is_key").alias("p"), F.expr("c.kind = p.kind AND c.id != p.id"))
    size = 1 << levels

    def holding(at: str) -> str:
        return f"transform(sequence(0, {levels}), b -> (1 << ({levels} - b)) + ({at} >> b))"

    def before(end: str) -> str:
        blocks = f"transform(sequence(0, {levels}), b -> if(({end} >> b) & 1 = 1, (1 << ({levels} - b)) + ({end} >> b) - 1, NULL))"
        return f"array_compact({blocks})"

    def spread(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.selectExpr("*", f"explode({x}) AS x_block").selectExpr("*", f"explode({y}) AS y_block")

    children = spread(columns, holding(f"({size - 1} - low_bin)"), holding("high_bin"))
    parents = spread(columns.filter("is_key"), before(f"({size} - low_bin)"), before("(high_bin + 1)"))
    same = "c.kind = p.kind AND c.x_block = p.x_block AND c.y_block = p.y_block"
    return children.alias("c").join(
        parents.alias("p"), F.expr(f"{same} AND c.id != p.id AND c.low >= p.low AND c.high <= p.high")
    )


def _union_values(tables: Mapping[str, DataFrame], parts: Mapping[str, Sequence[tuple[int, str]]]) -> DataFrame:
    """(id, value) of numbered expressions over tables: each table is read once."""
    return _union([tables[t].selectExpr(f"inline(array({', '.join(f'struct({i} AS id, {v} AS value)' for i, v in x)}))") for t, x in parts.items()])


def sketches(tables: Mapping[str, DataFrame], parts: Mapping[str, Sequence[tuple[int, str]]]) -> DataFrame:
    """(id, sketch): the least hashes of the values of numbered expressions, at most a fixed number of each.

    One aggregate per table, merged before the shuffle; one row per expression, written to the shared folder."""

    def one(name: str) -> DataFrame:
        asked = parts[name]
        aggs = [f"theta_sketch_agg({v}, {_SKETCH_SIZE}) AS s{i}" for i, v in asked]
        return tables[name].selectExpr(*aggs).selectExpr(f"inline(array({', '.join(f'struct({i} AS id, s{i} AS sketch)' for i, _ in asked)}))")

    spark = _session(tables)
    path = f"{shared_folder(spark, 'sketches')}/sketches"
    _union([one(name) for name in parts]).write.parquet(path)
    return spark.read.parquet(path)


def not_refuted(pairs: DataFrame, sketched_values: DataFrame) -> DataFrame:
    """The pairs (child, parent) that sketches do not rule out.

    Below the smaller threshold of two sketches both hold all hashes of their values. A child's hash there that the parent
    lacks is a value that the parent lacks: such a pair is out, and no true one is.
    """
    side = lambda x: sketched_values.select(F.col("id").alias(x), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.join(side("child"), "child").join(side("parent"), "parent")
    return both.filter("theta_sketch_estimate(theta_difference(child_sketch, parent_sketch)) = 0").drop("child_sketch", "parent_sketch")


def _shared_values(values: DataFrame) -> DataFrame:
    """(held, n): how many values are held by the same expressions. Values meet once, pre-aggregated to a row per value and id."""
    held = values.filter("value IS NOT NULL").distinct().groupBy("value").agg(F.sort_array(F.collect_list("id")).alias("held"))
    return held.groupBy("held").agg(F.count(F.lit(1)).alias("n"))


def _covered(counts: DataFrame, pairs: DataFrame, min_coverage: float) -> DataFrame:
    """Pairs with counts of the child's values and of those that the parent has."""
    met = counts.select("n", "held", F.explode("held").alias("child")).join(pairs, "child")
    matched = F.sum(F.when(F.array_contains("held", F.col("parent")), F.col("n")).otherwise(0))
    names = [c for c in pairs.columns if c not in ("child", "parent")]
    return (
        met.groupBy(*names)
        .agg(F.sum("n").alias("n_values"), matched.alias("n_matched"))
        .withColumn("coverage", F.col("n_matched") / F.col("n_values"))
        .filter(F.col("coverage") >= min_coverage)
    )


def fk_discovery(
    tables: Mapping[str, DataFrame],
    min_coverage: float = 1.0,
    ranges: Sequence[ColumnRange] | None = None,
    keys: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Child columns all of whose values occur in a key column, of another table or of their own.

    Parents are columns with PRIMARY KEY or UNIQUE values; whole numbers, texts, dates, timestamps, decimals and
    booleans are compared, each with their kind. Candidate pairs come from a join of the table of columns with
    itself on kind and (for full coverage of numbers and texts) on range. For full coverage, one aggregate per table sketches
    the columns of the pairs, and pairs that the sketches refute are left out. Then every column of a pair that is left is read
    once, and one shuffle a kind brings equal values together, pre-aggregated to one row per value and column: a
    value held by a third of all rows crosses the network once per task. Values that the same columns hold are
    counted together, and these counts meet the candidate pairs in a join. Small key spaces give chance matches, so
    the result has coverage and likeness of the names rather than a plain yes. ``composite_fks`` looks for keys of several
    columns.
    """
    spark = _session(tables)
    ranges = column_ranges(tables) if ranges is None else ranges
    if keys is None:
        unique = candidate_keys(tables, ranges=ranges).filter("is_unique").collect()
        keys = [(r.table_name, r.columns) for r in unique]
    ranges, pairs = _pairs(tables, ranges, set(keys), min_coverage)
    # one row per column comes to the driver: which of them are in a pair and are read
    used = _used(pairs)
    parts = []
    for kind in dict.fromkeys(r.kind for i, r in enumerate(ranges) if i in used):
        parts.append(_shared_values(_union_values(tables, _by_table(ranges, {i for i in used if ranges[i].kind == kind}))))
    if not parts:
        return spark.createDataFrame([], _EDGE_TYPE)
    names = ["child_table", "child_column", "parent_table", "parent_column"]
    return _covered(_union(parts), pairs, min_coverage).select(*names, "n_values", "n_matched", "coverage", "name_match")


def fk_candidates(
    tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, str]] | None = None, ranges: Sequence[ColumnRange] | None = None
) -> DataFrame:
    """The pairs of columns that ``fk_discovery`` would sketch: same kind, a key as parent, the child's range inside its own."""
    ranges = column_ranges(tables) if ranges is None else ranges
    if keys is None:
        unique = candidate_keys(tables, ranges=ranges).filter("is_unique").collect()
        keys = [(r.table_name, r.columns) for r in unique]
    pairs = _pairs(tables, ranges, set(keys), 1.0, sketch=False)[1]
    return pairs.select("child_table", "child_column", "parent_table", "parent_column")


def _used(pairs: DataFrame) -> set[int]:
    return {r["id"] for r in pairs.selectExpr("inline(array(struct(child AS id), struct(parent AS id)))").distinct().collect()}


def _by_table(ranges: Sequence[ColumnRange], used: set[int], value: Callable[[ColumnRange], str] | None = None) -> dict[str, list[tuple[int, str]]]:
    parts: dict[str, list[tuple[int, str]]] = {}
    for i in sorted(used):
        parts.setdefault(ranges[i].table, []).append((i, (value or _value)(ranges[i])))
    return parts


def _pairs(
    tables: Mapping[str, DataFrame], ranges: Sequence[ColumnRange], known: set[tuple[str, str]], min_coverage: float, sketch: bool = True
) -> tuple[list[ColumnRange], DataFrame]:
    """Comparable columns, and the pairs of them with a parent among ``known`` that ranges and sketches leave."""
    spark = _session(tables)
    ranges = [r for r in ranges if r.n_filled and r.kind not in ("nested", "other")]
    if any(r.kind == "text" and (r.table, r.column) in known for r in ranges):
        ranges = with_text_ranges(tables, ranges)
    levels, bins = range_bins(ranges)
    sized = [
        (i, r.table, r.column, r.kind, *(_sortable(x) if r.kind in ("int", "text") else "" for x in (r.low, r.high)),
         _bare(r.column), (r.table, r.column) in known, *bins[i])
        for i, r in enumerate(ranges)
    ]
    columns = spark.createDataFrame(sized, _COLUMN_TYPE)
    pairs = candidate_pairs(columns, levels, min_coverage >= 1.0).selectExpr(
        "c.id AS child", "p.id AS parent", "c.table AS child_table", "c.column AS child_column",
        "p.table AS parent_table", "p.column AS parent_column", "c.name = p.name AS name_match",
    )
    if sketch and min_coverage >= 1.0 and (used := _used(pairs)):
        left = not_refuted(pairs, sketches(tables, _by_table(ranges, used, _hashed)))
        path = f"{shared_folder(spark, 'pairs')}/pairs"
        left.write.parquet(path)
        pairs = spark.read.parquet(path)
    return ranges, pairs


def _sortable(end: int | str | None) -> str | None:
    """An end of a range as text in the same order."""
    return f"{end + (1 << 63):020d}" if isinstance(end, int) else end


def _value(r: ColumnRange) -> str:
    if r.kind == "int":
        return f"CAST({quoted(r.column)} AS bigint)"
    if r.kind == "decimal":
        return f"CAST({quoted(r.column)} AS decimal(38, 18))"
    if r.kind == "timestamp":
        return f"CAST({quoted(r.column)} AS timestamp_ntz)"
    return _compared(r.column, T.StringType()) if r.kind == "text" else quoted(r.column)


def _hashed(r: ColumnRange) -> str:
    """The value as a whole number or a text, the types that sketches take."""
    form = {"date": "unix_date({})", "timestamp": "unix_micros(CAST({} AS timestamp))", "boolean": "CAST({} AS int)", "decimal": "CAST({} AS string)"}
    return form.get(r.kind, "{}").format(_value(r))


def fk_violations(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """Child key values without a parent, and how many rows hold each.

    Rows are counted per key first, so the join sees each child key once, however often it occurs. The
    join is an outer one with a test for "not found": the optimizer would move an anti join below the
    count and so bring the rows of a hot key together uncounted.
    A key with a null part refers to nothing and is no violation.
    """
    counted = (
        child.dropna(subset=list(child_keys))
        .groupBy(*child_keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    parents = (
        parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    same = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(child_keys)]
    return counted.join(parents, same, "left").filter("_found IS NULL").select(*child_keys, "n_rows")


def related_tables(edges: DataFrame, table: str) -> DataFrame:
    """Tables the given one refers to, and tables that refer to it."""
    out = edges.filter(F.col("child_table") == table).select(
        F.lit("references").alias("relation"), F.col("parent_table").alias("table_name")
    )
    back = edges.filter(F.col("parent_table") == table).select(
        F.lit("referenced_by").alias("relation"), F.col("child_table").alias("table_name")
    )
    return out.unionByName(back).distinct()


def related_paths(edges: DataFrame, table: str, depth: int = 3) -> DataFrame:
    """Tables within ``depth`` references of the given one, up or down: relation, table_name, depth, path.

    ``path`` is a shortest way, the least one by names where there are several. Each step joins the tables reached last with the
    pairs of tables and leaves out what was reached before, so cycles end and a table is extended once; the number
    of ways does not matter. The pairs are written once, so that a costly plan behind ``edges`` runs once.
    """
    spark = edges.sparkSession
    place = f"{shared_folder(spark, 'links')}/links"
    edges.select("child_table", "parent_table").filter("child_table <> parent_table").distinct().write.parquet(place)
    links = spark.read.parquet(place)

    def walk(relation: str, near: str, far: str) -> DataFrame:
        # no way leads back to the start, so the first step is a filter
        steps = links.select(F.col(near).alias("near"), F.col(far).alias("far")).filter(F.col("far") != table)
        last = steps.filter(F.col("near") == table).select(F.col("far").alias("table_name"), F.array("near", "far").alias("path"))
        seen = last.withColumn("depth", F.lit(1))
        for step in range(2, depth + 1):
            reached = last.join(steps, F.col("table_name") == F.col("near")).select(
                F.col("far").alias("table_name"), F.concat("path", F.array("far")).alias("path")
            )
            reached = reached.groupBy("table_name").agg(F.min("path").alias("path"))
            last = reached.join(seen.select("table_name"), "table_name", "left_anti")
            seen = seen.unionByName(last.withColumn("depth", F.lit(step)))
        return seen.select(F.lit(relation).alias("relation"), "table_name", "depth", F.array_join("path", " > ").alias("path"))

    return walk("references", "child_table", "parent_table").unionByName(walk("referenced_by", "parent_table", "child_table"))
