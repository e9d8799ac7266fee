"""From source rows to typed records. Order matters in the sources, so every function takes an explicit row_idx."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the one with the greatest order. One aggregation with partial combination, no window sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows of a key the one with the least order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def deduplicated_organizations(organizations: DataFrame) -> DataFrame:
    """One row for each corporate number: the latest updated_on (empty is oldest), of equal ones the later row."""
    return latest(organizations.withColumn("updated_on", F.coalesce("updated_on", F.lit(""))), ["corp_no"], ["updated_on", "row_idx"])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Rows numbered from 0 in order within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def aggregate_budget_rows(rows: DataFrame, keys: Sequence[str], optional: bool = True) -> DataFrame:
    """Rows with a non-empty initial amount: the aggregate row of a key and budget year. Two of them raise, and none where it is needed."""
    n = F.count(F.when(T.strip(F.col("initial")) != "", 1))
    picked = rows.groupBy(*keys, "budget_fiscal_year").agg(n.alias("_n"), F.first(F.when(T.strip(F.col("initial")) != "", F.struct(*[c for c in rows.columns if c not in (*keys, "budget_fiscal_year")])), ignorenulls=True).alias("_row"))
    wrong = F.col("_n") > 1 if optional else F.col("_n") != 1
    checked = picked.withColumn("_n", F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("aggregate rows:"), "_n", *keys, "budget_fiscal_year")).cast("bigint")).otherwise(F.col("_n")))
    return checked.where("_n = 1").select(*keys, "budget_fiscal_year", "_row.*")


def connection_kinds(rows: DataFrame) -> DataFrame:
    """rows(block_from, block_from_name, paid, block_to, block_to_name, note, indirect_flag, item, amount) with their kind: paid, edge, indirect or empty; other forms raise."""
    has = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    payload = [has(c) for c in ("block_from", "block_from_name", "paid", "block_to_name", "note", "indirect_flag", "item")]
    some = payload[0]
    for p in payload[1:]:
        some = some | p
    kind = F.when(has("block_to") & (F.upper(T.strip(F.col("paid"))) == "TRUE"), "paid").when(has("block_to"), "edge").when(has("amount"), "indirect")
    return rows.withColumn("kind", kind.when(~some, "empty").otherwise(F.raise_error(F.lit("a connection row of unknown form"))))


def payee_kinds(rows: DataFrame) -> DataFrame:
    """rows(payee, amount, contract_amount) with their kind: block (no payee), kept, contract_detail or missing_amount."""
    empty = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return rows.withColumn("kind", F.when(empty("payee"), "block").when(~empty("amount"), "kept").when(~empty("contract_amount"), "contract_detail").otherwise("missing_amount"))


def expenditures(rows: DataFrame) -> DataFrame:
    """Kept payee rows as expenditures: numbered by row, with the role of the last block row and without numbers for bundled rows.

    rows(project_id, row_idx, payee, corp_no, other_flag, amount, contract_amount, block_id, role).
    """
    kinds = payee_kinds(rows)
    roles = last_roles(rows)
    bundled = T.is_bundled(F.col("other_flag"), F.col("payee"))
    number = T.strip(F.coalesce(F.col("corp_no"), F.lit("")))
    kept = kinds.where("kind = 'kept'").select("project_id", "row_idx", T.strip(F.col("payee")).alias("payee"), bundled.alias("is_bundled"), F.when(~bundled & (number != ""), number).alias("corp_no"), T.amount(F.col("amount")).alias("amount"), T.strip(F.col("block_id")).alias("block_id"))
    return numbered(kept, ["project_id"], ["row_idx"]).join(roles, ["project_id", "block_id"], "left").withColumn("role", F.coalesce("role", F.lit("")))


def last_roles(rows: DataFrame) -> DataFrame:
    """(project_id, block_id, role): of the block rows of a block the last one decides."""
    own = rows.where(T.strip(F.coalesce(F.col("payee"), F.lit(""))) == "").select("project_id", T.strip(F.col("block_id")).alias("block_id"), T.strip(F.col("role")).alias("role"), "row_idx")
    return own.where("role <> '' and block_id <> ''").groupBy("project_id", "block_id").agg(F.max_by("role", "row_idx").alias("role"))


def block_attributes(rows: DataFrame) -> DataFrame:
    """(project_id, block_id, block_name, role, amount, payee_count) of the last row that has a block and its amount."""
    own = rows.select("project_id", "row_idx", T.strip(F.col("block_id")).alias("block_id"), T.strip(F.col("block_name")).alias("block_name"), T.strip(F.col("role")).alias("role"), T.amount(F.col("block_amount")).alias("amount"), T.amount(F.col("payee_count")).alias("payee_count"))
    return latest(own.where("block_id <> '' and amount is not null"), ["project_id", "block_id"], ["row_idx"]).drop("row_idx")


def _in_order(value: str, condition: Column) -> Column:
    """Distinct values in the order of their first rows; a block's connections are as few as its project's blocks."""
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct("row_idx", value))))
    return F.array_distinct(F.transform(rows, lambda r: r[value]))


def blocks(attributes: DataFrame, connections: DataFrame) -> DataFrame:
    """Every block that has attributes or is an end of a connection.

    connections(project_id, row_idx, block_from, block_from_name, paid, block_to, block_to_name, note). The name comes from the
    attributes, or else from the first connection that has one; sources and notes are distinct, in order of rows.
    """
    c = connections.select("project_id", "row_idx", *[T.strip(F.coalesce(F.col(x), F.lit(""))).alias(x) for x in ("block_from", "block_from_name", "block_to", "block_to_name", "note")], (F.upper(T.strip(F.col("paid"))) == "TRUE").alias("paid")).where("block_to <> ''")
    into = c.groupBy("project_id", F.col("block_to").alias("block_id")).agg(F.max("paid").alias("paid_by_government"), _in_order("block_from", F.col("block_from") != "").alias("funded_by"), _in_order("note", F.col("note") != "").alias("flow_notes"))
    ends = c.select("project_id", F.col("block_to").alias("block_id"), F.col("block_to_name").alias("n"), (F.col("row_idx") * 2).alias("at")).unionByName(c.where("block_from <> ''").select("project_id", F.col("block_from").alias("block_id"), F.col("block_from_name").alias("n"), (F.col("row_idx") * 2 + 1).alias("at")))
    names = ends.groupBy("project_id", "block_id").agg(F.min_by("n", F.when(F.col("n") != "", F.col("at"))).alias("n"))
    keys = ["project_id", "block_id"]
    joined = attributes.join(names, keys, "full_outer").join(into, keys, "left")
    empty = F.array().cast("array<string>")
    name = F.coalesce(F.when(F.col("block_name") != "", F.col("block_name")), "n", F.lit(""))
    return joined.select(*keys, name.alias("block_name"), F.coalesce("role", F.lit("")).alias("role"), "amount", "payee_count", F.coalesce("paid_by_government", F.lit(False)).alias("paid_by_government"), F.coalesce("funded_by", empty).alias("funded_by"), F.coalesce("flow_notes", empty).alias("flow_notes"))


def indirect_costs(connections: DataFrame) -> DataFrame:
    """(project_id, item, amount) of rows with an amount; of equal items of a project the first."""
    own = connections.select("project_id", "row_idx", T.strip(F.col("item")).alias("item"), T.amount(F.col("amount")).alias("amount")).where("amount is not null")
    return first(own, ["project_id", "item"], ["row_idx"]).drop("row_idx")


def around_spine(spine: DataFrame, key: str, **files: DataFrame) -> DataFrame:
    """The first row of each key of the spine, with the rows of each file as an array in row order; rows without a spine row go."""
    out = first(spine, [key], ["row_idx"])
    for name, rows in files.items():
        rest = [c for c in rows.columns if c != key]
        grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_idx", *[c for c in rest if c != "row_idx"]))).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])
