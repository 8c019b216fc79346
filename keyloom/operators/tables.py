"""Document tables on typed DataFrames: key-range queries, scans, indexes, pages and writes.

Reads are plain filter, sort, limit and select, so key conditions reach the Parquet scan and a limit
becomes a top-k. A limit counts rows before the filter expression; Catalyst keeps that order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.expressions import ExpressionError, condition, key_condition, projection, update

#: Actions in a transaction.
MOST_ACTIONS = 100
SELECTS = {"", "ALL_ATTRIBUTES", "ALL_PROJECTED_ATTRIBUTES", "SPECIFIC_ATTRIBUTES", "COUNT"}


class ConditionFailed(ValueError):
    """A write condition that doesn't hold."""


@dataclass
class Index:
    """A secondary index: sparse (rows without its keys are absent), projecting all, the keys, or keys and some."""

    name: str
    hash_key: str
    range_key: str | None = None
    projection: str = "ALL"
    include: tuple[str, ...] = ()


@dataclass
class Table:
    """rows with a hash key and range keys that together are unique; tie-breaks follow the primary key."""

    name: str
    rows: DataFrame
    hash_key: str
    range_keys: tuple[str, ...] = ()
    indexes: dict[str, Index] = field(default_factory=dict)
    generation: int = 1

    @property
    def key(self) -> list[str]:
        return [self.hash_key, *self.range_keys]

    def index_rows(self, index: str) -> DataFrame:
        """The index as a projected view; a materialised copy would be bucketed by its hash key."""
        i = self.indexes[index]
        keys = [k for k in (i.hash_key, i.range_key) if k]
        rows = self.rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        if i.projection == "ALL":
            return rows
        wanted = dict.fromkeys([*keys, *self.key, *(i.include if i.projection == "INCLUDE" else ())])
        return rows.select(*wanted)


@dataclass
class Page:
    """items; scanned: rows that the limit counted (a frame, before the filter); next_key(): where to go on, or None."""

    items: DataFrame
    scanned: DataFrame
    _probe: DataFrame | None
    _limit: int | None
    _keys: list[str]

    def counts(self) -> DataFrame:
        """One row: count, scanned_count."""
        a, b = self.items.agg(F.count("*").alias("count")), self.scanned.agg(F.count("*").alias("scanned_count"))
        return a.join(F.broadcast(b))

    def next_key(self) -> dict[str, Any] | None:
        if self._probe is None:
            return None
        got = self._probe.select(*self._keys).collect()  # limit + 1 rows at most
        return got[self._limit - 1].asDict() if len(got) > self._limit else None


def after(keys: list[str], start: dict[str, Any], forward: bool = True) -> Column:
    """Rows beyond a key in the sort order; the key itself need not be there."""
    out = F.lit(False)
    for k in reversed(keys):
        value = F.lit(start[k])
        beyond = F.col(k) > value if forward else F.col(k) < value
        out = beyond | ((F.col(k) == value) & out)
    return out


def check_select(select: str, index: Index | None, projection_text: str | None) -> None:
    if select not in SELECTS:
        raise ExpressionError(f"no such select: {select}")
    if select == "ALL_ATTRIBUTES" and index is not None and index.projection != "ALL":
        raise ExpressionError("an index that projects less can't give all attributes")
    if select == "COUNT" and projection_text:
        raise ExpressionError("a count has no projection")


def _page(rows: DataFrame, order: list[str], keys: list[str], forward: bool, limit, start, filter_text, projection_text, names, values, select, missing) -> Page:
    if limit is not None and (not isinstance(limit, int) or limit < 1):
        raise ExpressionError("a limit is a positive number")
    if start is not None:
        rows = rows.where(after(order, start, forward))
    ordered = rows.orderBy(*[F.col(k).asc_nulls_first() if forward else F.col(k).desc_nulls_last() for k in order])
    scanned = ordered if limit is None else ordered.limit(limit)
    probe = None if limit is None else ordered.limit(limit + 1)
    items = scanned
    if filter_text:
        items = items.where(condition(filter_text, names, values, missing, dict(rows.dtypes)))
    wanted = projection(projection_text, names)
    if wanted is not None:
        items = items.select(*[c for c in wanted if c in rows.columns])
    if select == "COUNT":
        items = items.select(keys[0])
    return Page(items, scanned, probe, limit, list(dict.fromkeys([*keys, *order])))


def query(table: Table, key_text: str, *, index: str | None = None, filter: str | None = None, project: str | None = None, names=None, values=None, forward: bool = True, limit: int | None = None, start: dict | None = None, select: str = "", missing: str = "strict") -> Page:
    """Rows of one hash key, by range key. index: read a secondary index instead."""
    chosen = table.indexes[index] if index else None
    check_select(select, chosen, project)
    hash_key = chosen.hash_key if chosen else table.hash_key
    range_key = chosen.range_key if chosen else (table.range_keys[0] if table.range_keys else None)
    met = key_condition(key_text, hash_key, range_key, names, values).column(hash_key, range_key)
    rows = (table.index_rows(index) if index else table.rows).where(met)
    order = [k for k in dict.fromkeys([range_key, *table.key]) if k and k != hash_key] or [hash_key]
    return _page(rows, order, table.key, forward, limit, start, filter, project, names, values, select, missing)


def scan(table: Table, *, index: str | None = None, filter: str | None = None, project: str | None = None, names=None, values=None, limit: int | None = None, start: dict | None = None, select: str = "", missing: str = "strict") -> Page:
    """All rows of a table or index. Without a limit nothing is sorted."""
    chosen = table.indexes[index] if index else None
    check_select(select, chosen, project)
    rows = table.index_rows(index) if index else table.rows
    if limit is None and start is None:
        items = rows.where(condition(filter, names, values, missing, dict(rows.dtypes))) if filter else rows
        wanted = projection(project, names)
        return Page(items.select(*[c for c in wanted if c in rows.columns]) if wanted is not None else items, rows, None, None, table.key)
    order = list(dict.fromkeys([k for k in ((chosen.hash_key, chosen.range_key) if chosen else ()) if k] + table.key))
    return _page(rows, order, table.key, True, limit, start, filter, project, names, values, select, missing)


def get_item(table: Table, key: dict[str, Any], project: str | None = None, names=None) -> DataFrame:
    rows = table.rows
    for k in table.key:
        rows = rows.where(F.col(k) == F.lit(key[k]))
    wanted = projection(project, names)
    return rows if wanted is None else rows.select(*[c for c in wanted if c in rows.columns])


def transact_get(table: Table, requests: DataFrame) -> DataFrame:
    """requests (pos, key columns) with the item's columns, null where there is none; in order of pos."""
    return requests.join(table.rows, table.key, "left").orderBy("pos")


def index_lookup(index_keys: DataFrame, table: Table) -> DataFrame:
    """Base rows of an index's entries: each base row once."""
    return table.rows.join(index_keys.select(*table.key).distinct(), table.key, "left_semi")


def migration_merge(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the new generation, and those of the old whose key it lacks."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


# Writes return the whole new state; rows are replaced by key with anti joins.


def _new_rows(table: Table, requests: DataFrame, met: Column | None) -> DataFrame:
    """requests with the old row beside them (struct old, null where absent) and if the condition holds."""
    rest = [c for c in table.rows.columns if c not in table.key]
    old = table.rows.select(*table.key, F.struct(*[F.col(c) for c in table.rows.columns]).alias("old"), *[F.col(c).alias(c) for c in []])
    joined = requests.select(*table.key, F.struct(*[F.col(c) for c in requests.columns]).alias("new")).join(old, table.key, "left")
    flat = joined.select("new", "old", *table.key, *[F.col("old")[c].alias(c) for c in rest])
    return flat.withColumn("ok", met if met is not None else F.lit(True))


def put_items(table: Table, items: DataFrame, condition_text: str | None = None, names=None, values=None) -> tuple[DataFrame, DataFrame]:
    """(new rows of the table, results: key, ok, old). Conditions are on the old row, absent columns being null."""
    met = condition(condition_text, names, values, types=dict(table.rows.dtypes)) if condition_text else None
    judged = _new_rows(table, items, met)
    written = judged.where("ok").select("new.*")
    kept = table.rows.join(written.select(*table.key), table.key, "left_anti")
    return kept.unionByName(written, allowMissingColumns=True), judged.select(*table.key, "ok", "old")


def delete_items(table: Table, keys: DataFrame, condition_text: str | None = None, names=None, values=None) -> tuple[DataFrame, DataFrame]:
    """(new rows, results)."""
    met = condition(condition_text, names, values, types=dict(table.rows.dtypes)) if condition_text else None
    judged = _new_rows(table, keys, met)
    return table.rows.join(judged.where("ok").select(*table.key), table.key, "left_anti"), judged.select(*table.key, "ok", "old")


def update_items(table: Table, keys: DataFrame, update_text: str, condition_text: str | None = None, names=None, values=None, returns: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """(new rows, results: key, ok and what `returns` asks for: NONE, ALL_OLD, ALL_NEW, UPDATED_OLD, UPDATED_NEW)."""
    types = dict(table.rows.dtypes)
    changes = update(update_text, names, values, types)
    if set(changes) & set(table.key):
        raise ExpressionError("the key of an item doesn't change")
    met = condition(condition_text, names, values, types=types) if condition_text else None
    judged = _new_rows(table, keys.select(*table.key), met)
    columns = []
    for c in table.rows.columns:
        new = changes.get(c, F.col(c)) if c in changes else F.col(c)
        columns.append((F.lit(None) if new is None else new).cast(types[c]).alias(c))
    after_row = judged.select("*", F.struct(*columns).alias("after"))
    written = after_row.where("ok").select("after.*")
    kept = table.rows.join(written.select(*table.key), table.key, "left_anti")
    give = {"NONE": [], "ALL_OLD": ["old"], "ALL_NEW": ["after"], "UPDATED_OLD": [F.struct(*[F.col("old")[c].alias(c) for c in changes if c in types]).alias("old")], "UPDATED_NEW": [F.struct(*[F.col("after")[c].alias(c) for c in changes if c in types]).alias("after")]}[returns]
    return kept.unionByName(written), after_row.select(*table.key, "ok", *give)


def check_batch(requests: DataFrame, key: list[str], most: int = 25) -> None:
    """At most `most` requests, none of a key twice."""
    n, keys = requests.agg(F.count("*"), F.count_distinct(*key)).first()
    if n > most:
        raise ExpressionError(f"more than {most} requests")
    if n != keys:
        raise ExpressionError("a key occurs twice")


def batch_write(table: Table, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """New rows after a checked batch of puts and deletes."""
    parts = [d.select(*table.key) for d in (puts, deletes) if d is not None]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    check_batch(keys, table.key)
    kept = table.rows.join(keys, table.key, "left_anti")
    return kept if puts is None else kept.unionByName(puts, allowMissingColumns=True)


def batch_write_partial(table: Table, puts: DataFrame | None, deletes: DataFrame | None, contended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, unprocessed requests: op and key) of a checked batch: requests whose key is in `contended` (keys that
    other writers hold) are given back, the others are done."""
    parts = [d.select(F.lit(op).alias("op"), *table.key) for op, d in (("put", puts), ("delete", deletes)) if d is not None]
    requests = parts[0]
    for p in parts[1:]:
        requests = requests.unionByName(p)
    free = lambda d: None if d is None else d.join(contended.select(*table.key), table.key, "left_anti")
    check_batch(requests, table.key)
    return batch_write(table, free(puts), free(deletes)), requests.join(contended.select(*table.key).distinct(), table.key, "left_semi").select("op", *table.key)


def transact_write(
    table: Table,
    puts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    checks: list[tuple[dict, str]] = (),
    names=None,
    values=None,
    updates: list[tuple[DataFrame, str, str | None]] = (),
) -> DataFrame:
    """All or nothing: raises ConditionFailed unless each (key, condition) holds on the row of its key or on an absent one.

    updates: (keys, update expression, condition or None). All conditions are judged on the rows before the
    transaction, in one action; no key may be in two of the actions."""
    types = dict(table.rows.dtypes)
    spark = table.rows.sparkSession
    judged = [(spark.createDataFrame([tuple(key.values())], ", ".join(f"`{k}` {types[k]}" for k in key)), text) for key, text in checks]
    judged += [(keys, text) for keys, _, text in updates if text]
    failed = [_new_rows(table, keys, condition(text, names, values, types=types)).where(~F.coalesce("ok", F.lit(False))).select(F.lit(text).alias("text")) for keys, text in judged]
    if failed:
        every = failed[0]
        for f in failed[1:]:
            every = every.unionByName(f)
        if found := every.limit(1).collect():
            raise ConditionFailed(found[0]["text"])
    keys = [d.select(*table.key) for d in (puts, deletes, *[k for k, _, _ in updates]) if d is not None]
    if keys:
        every = keys[0]
        for k in keys[1:]:
            every = every.unionByName(k)
        check_batch(every, table.key, MOST_ACTIONS)
    rows = table.rows
    for wanted, text, _ in updates:
        rows = update_items(replace(table, rows=rows), wanted, text, names=names, values=values)[0]
    return batch_write(replace(table, rows=rows), puts, deletes) if puts is not None or deletes is not None else rows


def index_changes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to delete, entries to insert) of an index whose rows go from old to new."""
    return old.exceptAll(new), new.exceptAll(old)


@dataclass
class Catalog:
    """Tables by name with generations that grow when a name is used again."""

    tables: dict[str, Table] = field(default_factory=dict)
    generations: dict[str, int] = field(default_factory=dict)

    def create(self, table: Table) -> Table:
        if table.name in self.tables:
            raise ExpressionError(f"{table.name} exists")
        for i in table.indexes.values():
            for k in (i.hash_key, i.range_key):
                if k and k not in table.rows.columns:
                    raise ExpressionError(f"no attribute {k}")
        table.generation = self.generations[table.name] = self.generations.get(table.name, 0) + 1
        self.tables[table.name] = table
        return table

    def drop(self, name: str) -> None:
        if name not in self.tables:
            raise ExpressionError(f"no table {name}")
        del self.tables[name]

    def describe(self, spark: SparkSession, name: str) -> DataFrame:
        t = self.tables[name]
        rows = [(name, t.generation, "", t.hash_key, ",".join(t.range_keys), "ALL")] + [(name, t.generation, i.name, i.hash_key, i.range_key or "", i.projection) for i in t.indexes.values()]
        return spark.createDataFrame(rows, "table string, generation int, index string, hash_key string, range_keys string, projection string")

    def names(self, start: str | None = None, limit: int = 100) -> list[str]:
        return sorted(n for n in self.tables if start is None or n > start)[:limit]
