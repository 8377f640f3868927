"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, piecewise linear over training time 0 to 1. Its integral is the
source's share of all words taken; the normalised running integral says how much of the source's
demand is due by any time. A document takes the stretch of its source's words that starts where the
documents before it end, and inverting the running integral at that start gives its position in
training. The mix is the table sorted by position in ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from veridoc.llm.common import put_back, set_aside, staged

Knots = Sequence[tuple[float, float]]

#: Schedules by the source's place in code point order, repeating; they integrate to 5, 2 and 1.
CURRICULUM: tuple[Knots, ...] = (((0.0, 2.5), (1.0, 7.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 0.5)))
SHARE = 1.5
LIMIT = 2.0
CELL_DIGITS = 3  # hex digits of the order key that make a cell: 4096 cells a source


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def area(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def check_knots(knots: Knots) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times != sorted(set(times)) or times[0] != 0 or times[-1] != 1 or min(w for _, w in knots) < 0 or area(knots) <= 0:
        raise ValueError(f"a schedule needs increasing times from 0 to 1, no negative weight and a positive integral: {knots}")


def water_fill(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Targets in proportion to the weights, none above ``limit`` times its size; excess is shared again by weight."""
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    targets = [0.0] * len(sizes)
    rest = min(total, limit * sum(sizes))
    while open_:
        level = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level >= limit * sizes[i]]
        for i in full or open_:
            targets[i] = limit * sizes[i] if full else weights[i] * level
        if not full:
            break
        rest -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _plan(totals: list[tuple[str | None, int]], schedule: Callable[[int, str | None], Knots], share: float, limit: float) -> list[tuple]:
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    knots = [tuple(schedule(i, s)) for i, (s, _) in enumerate(order)]
    for k in knots:
        check_knots(k)
    sizes = [n for _, n in order]
    targets = water_fill(sizes, [area(k) for k in knots], share * sum(sizes), limit)
    rows = []
    for (source, size), target, k in zip(order, targets, knots):
        run = [0.0]
        for (t0, w0), (t1, w1) in zip(k, k[1:]):
            run.append(run[-1] + (t1 - t0) * (w0 + w1) / 2)
        rows.append((source, size, target, int(target + 0.5), [t for t, _ in k], [w for _, w in k], run))
    return rows


_PLAN = T.StructType([
    T.StructField("_source", T.StringType()), T.StructField("_size_all", T.LongType()), T.StructField("_target", T.DoubleType()),
    T.StructField("_demand", T.LongType()), T.StructField("_t", T.ArrayType(T.DoubleType())),
    T.StructField("_w", T.ArrayType(T.DoubleType())), T.StructField("_run", T.ArrayType(T.DoubleType())),
])


def due(share: Column, t: Column, w: Column, run: Column) -> Column:
    """The time by which a share of the schedule's integral has passed; inverts the running integral."""
    at = share * F.element_at(run, -1)
    k = F.greatest(F.lit(1), F.least(F.size(t) - 1, F.size(F.filter(run, lambda x: x <= at))))
    w0, w1 = F.element_at(w, k), F.element_at(w, k + 1)
    t0, t1 = F.element_at(t, k), F.element_at(t, k + 1)
    due_here = at - F.element_at(run, k)
    slope = (w1 - w0) / (t1 - t0)
    below = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2.0 * slope * due_here))
    return F.least(t1, F.when(below > 0, t0 + 2.0 * due_here / below).otherwise(t0))


ADDED = ("_size", "_size_all", "_target", "_taken", "_copies", "_position")
WORKING = ("_key", "_digest", "_cell", "_source", "_offset", "_start", "_plan_source", "_demand", "_t", "_w", "_run")


def mix(
    docs: DataFrame,
    schedule: Callable[[int, str | None], Knots] | None = None,
    share: float = SHARE,
    limit: float = LIMIT,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with the columns _size, _size_all, _target, _taken, _copies and _position.

    ``schedule`` gives the weight knots of the source at a place in code point order (null last). All
    sources together get ``share`` of all words, none more than ``limit`` times its own. A source's
    documents, in the order of the md5 of their id, form one stream of words that is read from its
    start as often as needed until the target is met: every document gives all its words in each
    full pass, and in the last pass the stream ends at the target's word. ``_taken`` counts the words
    with repeats, ``_copies`` the passes that take any, and ``_position`` (0 to 1) is when the first
    of them is due, null where nothing is taken.

    Null or empty texts have size 0 and take nothing. Repeated ids are ordered by size and text; equal
    rows are interchangeable. An empty table stays empty. Columns of ``docs`` with the name of an added column
    are replaced, all others are kept, whatever their names. The recipe has one row per source and is the
    only thing on the driver. No source is gathered in one task: its stream is summed by cells of the
    order key, and only a cell is sorted.
    """
    schedule = schedule or (lambda place, _: CURRICULUM[place % len(CURRICULUM)])
    docs, moved = set_aside(docs, WORKING + ADDED)
    id_column, text, source = (moved.get(c, c) for c in (id_column, text, source))
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    sized = docs.withColumns({
        "_size": word_count(F.col(text)), "_digest": F.xxhash64(text), "_key": key, "_source": F.col(source).cast("string"),
        "_cell": F.concat_ws(":", F.substring(key, 1, CELL_DIGITS), F.col(source).isNull().cast("string"), F.col(source).cast("string")),
    })
    cells = staged(sized.groupBy("_source", "_cell").agg(F.sum("_size").alias("_n")))
    totals = [(r[0], int(r[1])) for r in cells.groupBy("_source").agg(F.sum("_n")).collect()]
    plan = docs.sparkSession.createDataFrame(_plan(totals, schedule, share, limit), _PLAN)
    before = W.Window.partitionBy("_source").orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = cells.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = W.Window.partitionBy("_cell").orderBy("_key", F.col(id_column), "_size", "_digest").rowsBetween(W.Window.unboundedPreceding, -1)
    streamed = sized.join(offsets, "_cell").withColumn("_start", F.col("_offset") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    named = plan.withColumnRenamed("_source", "_plan_source")
    placed = streamed.join(named, F.col("_source").eqNullSafe(F.col("_plan_source")))
    passes = F.when(F.col("_size_all") > 0, F.floor(F.col("_demand") / F.col("_size_all"))).otherwise(0).cast("long")
    rest = F.col("_demand") - passes * F.col("_size_all")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_start")))
    taken = passes * F.col("_size") + part
    due_at = due(F.col("_start") / F.col("_demand"), F.col("_t"), F.col("_w"), F.col("_run"))
    mixed = placed.withColumns({"_taken": taken, "_copies": F.when(F.col("_size") > 0, passes).otherwise(0) + (part > 0).cast("long")}).withColumn(
        "_position", F.when(F.col("_taken") > 0, due_at)
    )
    replaced = {old: new for old, new in moved.items() if old.lower() in ADDED}
    return put_back(mixed.drop(*WORKING, *replaced.values()), {old: new for old, new in moved.items() if old not in replaced})


def in_training_order(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Sort by position in ranges; rows without a position come last."""
    return mixed.orderBy(F.col("_position").asc_nulls_last(), F.col(id_column))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and position of every row, in training order."""
    narrow = docs.select("doc_id", "text", "source")
    return in_training_order(mix(narrow)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_size_all").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"), F.col("_copies").alias("copies"), F.col("_position").alias("position"),
    )


#: The same mix for the comparison engine; ``{docs}`` stands for the input.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM {docs}
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS place FROM totals
), weighed AS (
  SELECT *, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CASE place WHEN 0 THEN 2.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS w0,
         CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS slope
  FROM ranked
), filled AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), cut AS (
  SELECT max(level) FILTER (WHERE level * w < 2.0 * source_size) AS level FROM filled
), targets AS (
  SELECT f.*, least(2.0::DOUBLE * source_size, coalesce(c.level * f.w, 2.0::DOUBLE * source_size)) AS target FROM filled f, cut c
), streamed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.start, t.w, t.w0, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS demand
  FROM streamed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM placed
), parts AS (
  SELECT *, greatest(0, least(size, demand - passes * source_size - start)) AS part FROM passed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + part AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN part > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CASE WHEN passes * size + part > 0 THEN
         least(1.0::DOUBLE, 2.0::DOUBLE * (start::DOUBLE / demand * w) / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2.0::DOUBLE * slope * (start::DOUBLE / demand * w)))))
       END AS position
FROM parts
"""
