"""Ordered-series building blocks that never need a whole entity in one task.

A plain ``Window.partitionBy(entity).orderBy(time)`` puts an entity into one task. Here an entity is
split into chunks by a monotone expression of its order columns. Windows run inside a chunk; one
summary row per chunk carries what crosses a chunk border (last row, counts), and a join brings it
back. Where summaries may be too many for one task they are chunked again, level by level, and what
they carry comes back down the same way. Two forms cover all ordered operators:

``walk``           previous row, island number and row number, exact across chunk borders
``with_lookback``  copies of the last rows of a chunk go to the next one, for bounded frames
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilohour.session import cut_lineage

Field = Callable[[str], Column]
Breaks = Callable[[Field, Field], Column]

# Most chunk summaries of a key that one task carries through, and most distinct values that one task ranks.
FAN, RANKED = 1_000_000, 4_000_000


def walk(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | Sequence[str],
    carry: Sequence[str] = (),
    breaks: Breaks | None = None,
    prev: str = "_prev",
    island: str = "_island",
    row: str | None = None,
    first: str | None = None,
    fan: int = FAN,
    levels: int | None = None,
) -> DataFrame:
    """Add the previous row of each key as a struct and, optionally, island and row numbers.

    ``chunk`` must grow with ``order``. ``breaks(prev, cur)`` says where a new island starts; the
    first row of a key always starts one. Island and row numbers count from 1 within a key.
    ``first`` names a struct column for the key's first row. Rows whose key or order columns are
    null belong to no series and are left out.

    The data is shuffled once: rows and summaries are built on the same exchange. Both keep all
    columns they were given up to that point, so pass only what is needed afterwards.

    A task sees one chunk, or at most ``fan`` neighbouring summaries of a key: the last chunk column, if it
    is a number, is divided by ``fan`` once a level, and summaries of summaries are carried first. Without
    ``levels`` there are as many as the size of what ``df`` reads asks for, were every row a chunk. Leading
    chunk columns are not divided, so the top level has at least one summary for each of their values.
    """
    keys, order = list(keys), list(order)
    if levels is None:
        levels = levels_for(most_rows(df), fan, fan)
    if isinstance(chunk, Column):
        parts, chunked = ["_chunk"], df.withColumn("_chunk", chunk)
    else:
        parts, chunked = list(chunk), df
    group = list(dict.fromkeys([*keys, *parts]))
    fields = list(dict.fromkeys([*order, *carry]))
    for name in dict.fromkeys([*group, *order]):
        chunked = chunked.where(F.col(name).isNotNull())
    given = chunked.columns
    cur = F.struct(*[F.col(name) for name in fields])
    inside = Window.partitionBy(*group).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    local = chunked.withColumn(prev, F.lag(cur).over(inside))
    summary = [F.min_by(cur, F.struct(*order)).alias("_w_head"), F.max_by(cur, F.struct(*order)).alias("_w_tail")]
    if breaks is not None:
        local = local.withColumn("_w_run", F.sum(_opens(F.col(prev), F.col, breaks, 0)).over(running))
        summary.append(F.max("_w_run").alias("_w_breaks"))
    if row is not None:
        local = local.withColumn("_w_local_row", F.row_number().over(inside).cast("long"))
        summary.append(F.count(F.lit(1)).alias("_w_rows"))

    local = _same_columns(local, given)
    chunks = local.groupBy(*group).agg(*summary)
    if dict(chunked.dtypes)[parts[-1]] not in ("tinyint", "smallint", "int", "bigint") or parts[-1] in keys:
        levels = 1
    carried = _carried(chunks, keys, parts, breaks, row is not None, first, fan, levels)

    joined = local.join(carried, group)
    result = joined.withColumn(prev, F.coalesce(F.col(prev), F.col("_w_before")))
    drop = ["_w_before", "_w_base", "_w_run", "_w_row_base", "_w_local_row"]
    if breaks is not None:
        result = result.withColumn(island, (F.col("_w_base") + F.col("_w_run")).cast("long"))
    if row is not None:
        result = result.withColumn(row, (F.col("_w_row_base") + F.col("_w_local_row")).cast("long"))
    if isinstance(chunk, Column):
        drop.append("_chunk")
    return result.drop(*drop)


def _opens(before: Column, cur: Field, breaks: Breaks, alone: int) -> Column:
    """1 where a new island starts after ``before``, ``alone`` where nothing comes before."""
    return F.when(before.isNull(), alone).otherwise(F.coalesce(breaks(_fields(before), cur).cast("int"), F.lit(1)))


def _carried(
    chunks: DataFrame, keys: list[str], parts: list[str], breaks: Breaks | None, rows: bool, first: str | None, fan: int, levels: int
) -> DataFrame:
    """What each chunk takes over from the chunks before it: last row, island and row numbers, the key's first row.

    ``chunks`` has a row per key and parts with first and last row (``_w_head``, ``_w_tail``), islands that start inside
    (``_w_breaks``) and rows (``_w_rows``). ``_w_base`` counts islands up to the chunk's first row, that row included.
    """
    group = list(dict.fromkeys([*keys, *parts]))
    if levels > 1:
        up = [*parts[:-1], "_w_up"]
        above = list(dict.fromkeys([*keys, *up]))
        given = [c for c in chunks.columns if c in group]
        lifted = chunks.withColumn("_w_up", F.floor(F.col(parts[-1]) / fan).cast("long"))
    else:
        above, lifted = keys, chunks
    across = Window.partitionBy(*above).orderBy(*parts)
    upto, before = across.rowsBetween(Window.unboundedPreceding, 0), across.rowsBetween(Window.unboundedPreceding, -1)
    inner = lifted.withColumn("_w_before", F.lag("_w_tail").over(across))
    out = ["_w_before"]
    if breaks is not None:
        # the first chunk of a group opens an island only where nothing at all comes before
        inner = inner.withColumn("_w_first", _opens(F.col("_w_before"), _fields(F.col("_w_head")), breaks, 1 if levels == 1 else 0))
        inner = inner.withColumn("_w_base", F.coalesce(F.sum("_w_breaks").over(before), F.lit(0)) + F.sum("_w_first").over(upto))
        out.append("_w_base")
    if rows:
        inner = inner.withColumn("_w_row_base", F.coalesce(F.sum("_w_rows").over(before), F.lit(0)))
        out.append("_w_row_base")
    if levels == 1:
        if first is not None:
            inner = inner.withColumn(first, F.first("_w_head").over(upto))
            out.append(first)
        return inner.select(*group, *out)
    inner = _same_columns(inner, given)
    place = F.struct(*parts)
    whole = [F.min_by("_w_head", place).alias("_w_head"), F.max_by("_w_tail", place).alias("_w_tail")]
    if breaks is not None:
        whole.append((F.sum("_w_first") + F.sum("_w_breaks")).alias("_w_breaks"))
    if rows:
        whole.append(F.sum("_w_rows").alias("_w_rows"))
    level = [c if c != "_w_up" else f"_w_up_{levels}" for c in up]
    coarser = inner.groupBy(*above).agg(*whole).withColumnRenamed("_w_up", level[-1])
    taken = _carried(coarser, keys, level, breaks, rows, first, fan, levels - 1).withColumnRenamed(level[-1], "_w_up")
    names = [c for c in taken.columns if c not in above]
    taken = taken.withColumnsRenamed({c: f"{c}_above" for c in names})
    joined = inner.join(taken, above).withColumn("_w_before", F.coalesce("_w_before", "_w_before_above"))
    for name in ("_w_base", "_w_row_base"):
        if name in out:
            joined = joined.withColumn(name, F.col(name) + F.col(f"{name}_above"))
    if first is not None:
        joined = joined.withColumn(first, F.col(f"{first}_above"))
        out.append(first)
    return joined.select(*group, *out)


def most_rows(df: DataFrame) -> int:
    """Rows that the tables below ``df`` hold at most, by their known size and eight bytes a row; nothing is read.

    Sources of unknown size count as empty, so pass stored tables where it matters.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 62) // 8


def levels_for(rows: int, fits: int, fan: int) -> int:
    """Levels after which what was ``rows`` and shrinks by ``fan`` a level fits."""
    levels = 1
    while rows > fits:
        rows, levels = rows // fan, levels + 1
    return levels


def _same_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep column pruning from giving two users of a frame different shuffles underneath.

    The condition always holds, but the optimizer cannot tell, so every reader needs all columns and
    Spark reuses the one exchange instead of reading and shuffling the source again.
    """
    hashable = [f.name for f in df.schema.fields if f.name in names and f.dataType.typeName() not in ("map", "variant")]
    return df.where(F.hash(*hashable) >= F.lit(-(2**31)))


def with_lookback(df: DataFrame, *, index: Column, chunk_rows: int, lookback: int) -> DataFrame:
    """Add ``_chunk`` and ``_own`` and copy the last ``lookback`` index positions to later chunks.

    Frames ending at the current row and reaching back at most ``lookback`` positions are exact
    within a chunk for rows with ``_own``; the copies are dropped afterwards by the caller.
    """
    size = max(chunk_rows, lookback)
    home = F.floor(F.col("_index") / F.lit(size)).cast("long")
    copied = F.pmod(F.col("_index"), F.lit(size)) >= F.lit(size - lookback)
    targets = F.when(copied, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_index", index.cast("long"))
        .withColumn("_home", home)
        .withColumn("_chunk", F.explode(targets))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home", "_index")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not recompute.

    A filter pushed below a projection copies the projected expressions into itself, once per use.
    Generated columns are not pushed through, so expensive ones are evaluated once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def keep_last(df: DataFrame, keys: Sequence[str], precedence: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest precedence.

    An aggregate, not ``row_number``: partial results are combined before the shuffle, so a key
    with very many copies does not end up whole in one task. Null keys group like any value.
    """
    columns = df.columns
    rest = [name for name in columns if name not in keys]
    ranked = [name for name in dict.fromkeys([*precedence, *rest]) if name not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in columns])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Several one-row frames as one row; a union and an aggregate, so nothing is cross-joined."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def exact_quantiles(
    df: DataFrame, *, keys: Sequence[str], value: str, probabilities: dict[str, float], splits: int = 16, fits: int = RANKED,
    rounds: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key by rank, one column per probability.

    A mergeable sketch chooses borders, rows are counted between them, and only what lies between two borders
    that hold a wanted rank is looked at again: split once more, or ranked when it fits. Counts are combined before
    they are shuffled and no value moves before the last round, where equal values are counted first. So one task ranks
    about a ``splits ** rounds``-th of a key's distinct values. Without ``rounds`` there are as many as bring what ``df``
    reads down to ``fits``; what is left after each but the last is stored. ``df`` is read three times, so store it if it
    is costly to make. Null and NaN do not count.
    """
    wanted, keys = list(keys), list(keys) or ["_all"]
    if rounds is None:
        rounds = levels_for(most_rows(df), fits, splits)
    data = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_all", F.lit(0))
    pool = data.select(*keys, F.lit(0).cast("long").alias("_slot"), F.col(value).cast("double").alias("_v"))
    slot, named = [*keys, "_slot"], list(probabilities.items())
    shares = [i / splits for i in range(1, splits)]
    kept = None
    for done in range(rounds):
        sketched = pool.groupBy(*slot).agg(F.percentile_approx("_v", shares, 2_000).alias("_borders"), F.count(F.lit(1)).alias("_total"))
        sketch = sketched.select(*slot, *[F.col("_borders")[i].alias(f"_b{i}") for i in range(splits - 1)])
        if kept is None:
            ranks = []
            for _, p in named:
                position = F.lit(float(p)) * (F.col("_total") - 1)
                ranks += [F.floor(position) + 1, F.ceil(position) + 1]
            kept = sketched.select(*slot, F.lit(0).cast("long").alias("_base"), F.array(*ranks).alias("_ranks"), "_total")
        if not wanted:
            sketch = F.broadcast(sketch)  # one row in the first round, two a probability later
        reached = sum(((F.col("_v") >= F.col(f"_b{i}")).cast("int") for i in range(splits - 1)), F.lit(0))
        tagged = pool.join(sketch, slot).select(*slot, "_v", (F.col("_slot") * splits + reached).alias("_next"))
        counts = tagged.groupBy(*slot, "_next").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*slot).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(kept, slot)
        start = F.col("_base") + F.col("_before")
        holds = F.exists("_ranks", lambda r: (r > start) & (r <= start + F.col("_n")))
        kept = placed.where(holds).select(*keys, F.col("_next").alias("_slot"), start.alias("_base"), "_ranks", "_total")
        narrowed = tagged.select(*keys, F.col("_next").alias("_slot"), "_v")
        few = kept.select(*slot)
        pool = narrowed.join(few if wanted else F.broadcast(few), slot, "left_semi")
        if done < rounds - 1:
            kept = cut_lineage(kept)
            pool = cut_lineage(pool)
    counted = pool.groupBy(*slot, "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*slot).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_n").over(inside)).join(kept, slot)
    last = F.col("_base") + F.col("_upto")  # ranks (last - n, last], counted from 1
    found = []
    for i in range(2 * len(named)):
        rank = F.col("_ranks")[i]
        found.append(F.max(F.when((rank <= last) & (rank > last - F.col("_n")), F.col("_v"))).alias(f"_r{i}"))
    wide = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *found)
    out = []
    for i, (name, p) in enumerate(named):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return wide.select(*wanted, *out)


def _fields(struct: Column) -> Field:
    return lambda name: struct[name]
