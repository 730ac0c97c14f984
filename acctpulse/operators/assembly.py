"""Wide rows put together from feature sets of one key, by one shuffle for all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctpulse.operators.lags import ACCOUNT, WEEK, lag_features, lag_name


def stack_join(
    base: DataFrame, keys: Sequence[str], *branches: DataFrame, distinct: bool = True
) -> DataFrame:
    """Rows of ``base``, each with the rows of every branch that have its keys (different ones, if ``distinct``).

    The same rows as one left join on ``keys`` per branch. Instead of joining one branch after the other, the rows
    of all are stacked, those of a branch as typed structs, and one window pass by key hands the rows of a key to
    its rows of ``base``; a branch that repeats the key is unfolded afterwards. One shuffle for any number of
    branches, none where all sides are partitioned by a part of the key already.

    A window partition holds what one key has, so the keys should be fine enough for that to be small. Rows of
    ``base`` whose key is partly NULL match nothing; they are spread by their content.
    """
    taken = list(base.columns)
    for branch in branches:
        clash = set(taken) & (set(branch.columns) - set(keys))
        if clash:
            raise ValueError(f"column names used twice: {sorted(clash)}")
        taken += [c for c in branch.columns if c not in keys]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    loose = F.when(no_key, F.xxhash64(*[F.col(f"`{c}`") for c in base.columns]))
    stacked = base.withColumns({"_loose": loose, "_is_base": F.lit(True)})
    names, fields = [f"_rows_{i}" for i in range(len(branches))], {}
    for branch, name in zip(branches, names):
        rest = [c for c in branch.columns if c not in keys]
        fields |= {c: F.col(f"{name}.`{c}`").alias(c) for c in rest}
        packed = F.struct(F.lit(True).alias("_is"), *[F.col(f"`{c}`") for c in rest]).alias(name)
        rows = branch.dropna(subset=list(keys)).select(*keys, packed)
        stacked = stacked.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_loose")
    gather = F.collect_set if distinct else F.collect_list
    held = [F.col(f"`{c}`") for c in base.columns]
    out = stacked.select(*held, "_is_base", *[gather(n).over(w).alias(n) for n in names]).filter("_is_base")
    for name in names:
        out = out.withColumn(name, F.explode_outer(name))
    return out.select(*held, *fields.values())


def _packed(rows: DataFrame, keys: Sequence[str], name: str, distinct: bool = False) -> DataFrame:
    """The keys and a struct of the rest; ``distinct``: different ones of every key, where no key is NULL.

    The sets keep values as they are; a distinct of the rows would make 0.0 of -0.0.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    packed = F.struct(*(rest or [F.lit(True)]))
    if not distinct:
        return rows.select(*keys, packed.alias(name))
    sets = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.collect_set(packed).alias(name))
    return sets.select(*keys, F.explode(name).alias(name))


def dealt_join(
    base: DataFrame, keys: Sequence[str], *branches: DataFrame, distinct: bool = True
) -> DataFrame:
    """The rows of ``stack_join`` by one left join per branch, for sides that are all dealt by a part of ``keys``.

    Sides with the same buckets or partitions meet without a shuffle, so that the wide rows of ``base`` stay where
    they are. Other sides are shuffled, each branch and ``base`` once. Rows pass the joins as typed structs.
    """
    taken, out = list(base.columns), _packed(base, keys, "_base")
    fields = [F.col(c) if c in keys else F.col(f"_base.`{c}`").alias(c) for c in base.columns]
    for i, branch in enumerate(branches):
        rest = [c for c in branch.columns if c not in keys]
        clash = set(taken) & set(rest)
        if clash:
            raise ValueError(f"column names used twice: {sorted(clash)}")
        taken += rest
        fields += [F.col(f"_rows_{i}.`{c}`").alias(c) for c in rest]
        out = out.join(_packed(branch, keys, f"_rows_{i}", distinct), list(keys), "left")
    return out.select(*fields)


def lag_lists(
    spine: DataFrame,
    singles: Sequence[tuple[DataFrame, Mapping[str, Sequence[int]]]],
    repeating: Sequence[tuple[DataFrame, Sequence[str], Sequence[int]]],
) -> DataFrame:
    """``lag_features`` of ``singles``, and of sources that may repeat a week, in one pass.

    A repeating source is (rows, value columns, lags). Its rows of a week travel through the pass as one list and
    are unfolded afterwards, so a spine row fans out as it would in one left join per lag. A week that is missing
    leaves the row with NULLs.
    """
    listed, wanted = [], []
    for i, (rows, values, lags) in enumerate(repeating):
        name = f"_list_{i}"
        weeks = rows.dropna(subset=[ACCOUNT, WEEK]).groupBy(ACCOUNT, WEEK)
        listed.append((weeks.agg(F.collect_list(F.struct(*values)).alias(name)), {name: lags}))
        wanted += [(lag_name(name, k), {v: lag_name(v, k) for v in values}) for k in lags]
    out = lag_features(spine, *singles, *listed)
    for name, fields in wanted:
        out = out.withColumn(name, F.explode_outer(name))
        out = out.withColumns({to: F.col(f"{name}.{v}") for v, to in fields.items()}).drop(name)
    return out
