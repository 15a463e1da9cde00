"""Order-sensitive keys: first row wins, positional blocks, duplicates, lookups, key checks.

"First" always means the least value of an explicit order column; nothing depends on how
Spark deals out the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import cut


def first_wins(df: DataFrame, keys: list[str], order: str | list[str] = "_ord") -> DataFrame:
    """The first row of every key. Null keys are a key."""
    order = [order] if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def conflicting_duplicates(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, conflicts): keys whose rows differ in some value; null differs from a value.

    Keys that occur once are left out first, by a pass over the keys alone; the others need the least and the
    greatest value of each column, so that no row is multiplied by the number of columns.
    """
    several = df.groupBy(*[F.col(c).alias(f"__key_{c}") for c in keys]).agg(F.count("*").alias("__n")).filter("__n > 1")
    rows = df.join(several, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys], "left_semi")
    differs = lambda c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    conflicts = reduce(Column.__add__, [F.coalesce(differs(c), F.lit(False)).cast("int") for c in values])
    return rows.groupBy(*keys).agg(conflicts.alias("conflicts")).filter("conflicts > 0")


MOST_BROADCAST = 4_000_000  # row numbers, or names


def few(df: DataFrame) -> DataFrame:
    """`df`, written and marked for a broadcast if it has at most MOST_BROADCAST rows (an action)."""
    df = cut(df)
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def repeats(df: DataFrame, keys: list[str], order: str | list[str] = "_ord") -> tuple[DataFrame, DataFrame]:
    """(`df` with the number __at of each row, (__at, __place) of the rows whose key occurs more than once).

    `df` must be written already (sources.tables.cut), so that numbers stay. Only keys and order are
    shuffled; whole rows meet few() numbers where they are.
    """
    order = [order] if isinstance(order, str) else order
    numbered = df.withColumn("__at", F.monotonically_increasing_id())
    by = Window.partitionBy(*keys)
    places = {"__n": F.count("*").over(by), "__place": F.row_number().over(by.orderBy(*order, "__at"))}
    return numbered, few(numbered.select(*dict.fromkeys([*keys, *order]), "__at").withColumns(places).filter("__n > 1").select("__at", "__place"))


def is_unique(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key occurs twice (an action)."""
    return df.groupBy(*keys).count().filter("count > 1").isEmpty()


def assert_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    if not is_unique(df, keys):
        raise ValueError(f"{what} is not unique: {', '.join(keys)}")
    return df


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """`df`, whose job fails if a key occurs twice.

    The check is part of the plan: an aggregation by the key, whose partitioning a join on it
    uses again.
    """
    values = [c for c in df.columns if c not in keys]
    twice = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{what}: a key occurs twice: {', '.join(keys)}")))
    once = lambda c: F.coalesce(twice.cast(df.schema[c].dataType), F.any_value(c)).alias(c)
    return df.groupBy(*keys).agg(*map(once, values)).select(*df.columns)


def lookup(df: DataFrame, dimension: DataFrame, on: list[str], unique: bool = True) -> DataFrame:
    """Left join that keeps the rows of `df` one to one.

    unique says that `dimension` has every key once; it is asserted. No broadcast is forced:
    the dimension grows with the data, and the planner knows its size.
    """
    return df.join(assert_unique(dimension, on, "dimension") if unique else dimension, on, "left")


def missing_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `df` without a partner; null keys never have one."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def append_missing(dimension: DataFrame, needed: DataFrame, on: list[str]) -> DataFrame:
    """`dimension` with the rows of `needed` whose key it lacks; other columns are null."""
    return dimension.unionByName(missing_from(needed, dimension, on), allowMissingColumns=True)


def same_keys(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    """Whether both have the same set of keys (an action)."""
    return missing_from(a, b, on).isEmpty() and missing_from(b, a, on).isEmpty()


def name_map(people: DataFrame, aliases: dict[str, str] | None = None, id_col: str = "fighter_id", first: str = "first_name", last: str = "last_name", order: str = "_ord") -> DataFrame:
    """(name_key, id): normalized "first last" and "last first" of everyone.

    The first row in order has a name, even with a null id; within a row, "first last" comes
    first. aliases (name to the name of someone in the table) come over those that are there.
    """
    names = F.array(text.full_name(F.col(first), F.col(last)), text.full_name(F.col(last), F.col(first)))
    rows = people.select(F.col(id_col).alias("id"), F.col(order).alias("_ord"), F.posexplode(names).alias("_pos", "_name"))
    keyed = rows.withColumn("name_key", text.normalize_text(F.col("_name"))).filter("name_key <> ''")
    own = first_wins(keyed, ["name_key"], ["_ord", "_pos"]).select("name_key", "id")
    if not aliases:
        return own
    known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (_plain(v), _plain(k))])
    other = own.withColumn("name_key", F.try_element_at(known, F.col("name_key"))).filter("name_key is not null")
    return missing_from(own, other, ["name_key"]).unionByName(other)


def _plain(name: str) -> str:
    return " ".join(name.split()).lower()


def resolve(df: DataFrame, names: DataFrame, name_col: str, out: str) -> DataFrame:
    """`df` with the id that a name column stands for; null if nobody has the name."""
    ids = names.select(F.col("name_key").alias("__key"), F.col("id").alias(out))
    return df.withColumn("__key", text.normalize_text(F.col(name_col))).join(ids, "__key", "left").drop("__key")


def assign_blocks(rows: DataFrame, owners: DataFrame, on: list[str], owner: str, order: str = "_ord", owner_order: str = "_ord") -> DataFrame:
    """Rows of a key dealt to the owners of that key, in equal blocks, in order.

    With k owners and n rows, the first n / k rows go to the first owner, and so on. The job
    fails if k does not divide n. Rows without an owner are kept with null.
    """
    by = Window.partitionBy(*on)
    # one row a key, so that rows meet their owners where the window has put them
    listed = owners.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col(owner_order).alias("at"), F.col(owner).alias("owner")))).alias("__owners"))
    placed = rows.withColumn("__n", F.count("*").over(by)).withColumn("__row", F.row_number().over(by.orderBy(order))).join(listed, on, "left")
    uneven = F.raise_error(F.concat(F.lit("rows can't be dealt evenly: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    many = F.size("__owners")
    own = F.get("__owners", F.floor((F.col("__row") - 1) / (F.col("__n") / many)).cast("int"))["owner"]
    dealt = F.when(F.col("__owners").isNull(), F.lit(None)).when(F.col("__n") % many == 0, own).otherwise(uneven.cast(owners.schema[owner].dataType))
    return placed.withColumn(owner, dealt).drop("__n", "__row", "__owners")
