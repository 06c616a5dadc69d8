"""Operator 12, an interval overlap join of sales with click sessions, on weighted pairs of slots.

Both sides are intervals of a client, in whole slots with both ends inclusive; an open end is infinite. What
is asked of a pair of intervals depends on their slots alone, so sessions are first counted by client, start
slot and end slot, with the sum of their checksums, and sales are reduced to their distinct slot pairs.
These meet in the chunk of time in which they begin to overlap, each once, and the weighted sums of a slot
pair and relation are handed to every sale that has it.

Sessions never need a client's clicks in one task: clicks of one cell as wide as the gap belong together, so
cells come first (two numbers each, summed where the clicks lie), then the runs of cells in a span of time,
then the runs of a client, of which there is at most one for each gap. A slot pair meets only session groups of its
own chunks, so a client with any number of sales and sessions is as many keys as its time has chunks, each
bounded by the slots of a chunk and by what is open or still lasts there.

Defined cases: rows without client or time take no part, nor do sales without a session that shares a slot;
a null status, kind or shipping time counts as not open, no error and no end; a sale that is shipped before it is
sold ends when it is sold; lines without a sale id belong to no sale; repeated clicks and lines change
nothing; each row of sales is a sale, so a repeated row gets its result again; empty tables give an empty
result; other columns are ignored, also those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MINUTE = 60_000_000
GAP = 30 * MINUTE
SLOT = 360 * MINUTE
#: Cells of a session gap in a span, and slots in a chunk: four days and four weeks.
SPAN = 192
CHUNK = 112
#: The end slot of an open interval.
OPEN = (1 << 63) - 1
#: How a sale lies to a session: by start (earlier, equal, later), then by end (earlier, equal, later).
RELATIONS = ["overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by"]


def micros(df: DataFrame, name: str) -> Column:
    """Whole microseconds since 1970 of a time, in no time zone where the column has none."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    since = F.col(name).cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def floor_div(value: Column, width: int) -> Column:
    """Whole units of width below value, also for values below 0; no doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def _sign(a: Column, b: Column) -> Column:
    return F.when(a < b, 0).when(a == b, 1).otherwise(2)


def _runs(rows: DataFrame, key: list[str], gap: int) -> DataFrame:
    """rows (key, first, last2) in runs without a gap of more than `gap`; last2: twice the last time, plus 1 if open."""
    by_time = Window.partitionBy(key).orderBy("first", "last2")
    begins = F.coalesce(F.col("first") - F.shiftright(F.lag("last2").over(by_time), 1) > gap, F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "run").agg(F.min("first").alias("first"), F.max("last2").alias("last2")).drop("run")


def sessions(clicks: DataFrame, client: str = "client_id", ts: str = "ts", open_if: Column | None = None, gap: int = GAP) -> DataFrame:
    """(client, first, last, open): runs of a client's clicks with no gap over `gap`; times in microseconds.

    open: whether a click at the run's last time meets open_if (kind = 'error' if None).
    """
    is_open = F.coalesce(F.col("kind") == "error" if open_if is None else open_if, F.lit(False))
    rows = clicks.select(F.col(client).alias("client"), micros(clicks, ts).alias("first"), is_open.cast("long").alias("open")).where("client IS NOT NULL AND first IS NOT NULL")
    rows = rows.select("client", floor_div(F.col("first"), gap).alias("cell"), "first", (F.col("first") * 2 + F.col("open")).alias("last2"))
    cells = rows.groupBy("client", "cell").agg(F.min("first").alias("first"), F.max("last2").alias("last2"))
    in_span = _runs(cells.withColumn("span", floor_div(F.col("cell"), SPAN)).drop("cell"), ["client", "span"], gap)
    runs = _runs(in_span.drop("span"), ["client"], gap)
    return runs.select("client", "first", F.shiftright("last2", 1).alias("last"), (F.col("last2").bitwiseAND(1) == 1).alias("open"))


def slots(first: Column, last: Column, is_open: Column, slot: int = SLOT) -> tuple[Column, Column]:
    """Start and end slot of an interval."""
    return floor_div(first, slot), F.when(is_open, F.lit(OPEN)).otherwise(floor_div(last, slot))


def relation(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RELATIONS)), code + 1)


def weighted_overlaps(pairs: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """pairs: distinct (client, start, end). groups: client, start, end, n, crc.

    (client, start, end, code, n_pairs, overlap_slots, crc) for each pair and relation to groups that share a slot with it.
    """
    last = pairs.select("start").unionByName(groups.select("start")).agg(F.max("start")).first()[0]
    if last is None:
        last = 0

    def dealt(rows: DataFrame) -> DataFrame:
        # an overlap begins with a start, so chunks after the last start have none
        until = floor_div(F.greatest(F.col("start"), F.least(F.col("end"), F.lit(last))), chunk)
        return rows.withColumn("chunk", F.explode(F.sequence(floor_div(F.col("start"), chunk), until)))

    other = dealt(groups).select(F.col("client").alias("c"), F.col("start").alias("a"), F.col("end").alias("b"), "n", "crc", F.col("chunk").alias("k"))
    s, e, a, b = map(F.col, ("start", "end", "a", "b"))
    meets = (F.col("client") == F.col("c")) & (F.col("chunk") == F.col("k")) & (s <= b) & (a <= e) & (floor_div(F.greatest(s, a), chunk) == F.col("chunk"))
    shared = F.when((e < OPEN) | (b < OPEN), F.least(e, b) - F.greatest(s, a) + 1)
    met = dealt(pairs).join(other, meets).select("client", "start", "end", (_sign(s, a) * 3 + _sign(e, b)).alias("code"), "n", (shared * F.col("n")).alias("shared"), "crc")
    return met.groupBy("client", "start", "end", "code").agg(F.sum("n").alias("n_pairs"), F.sum("shared").alias("overlap_slots"), F.sum("crc").alias("crc"))


def overlap_join(left: DataFrame, right: DataFrame, slot: int = SLOT, chunk: int = CHUNK) -> DataFrame:
    """left: id, client, first, last, open. right: client, first, last, open. Times in microseconds.

    (id, relation, n_pairs, overlap_slots, crc) for each row of left and relation to rows of right that share a slot with it.
    """
    start, end = slots(F.col("first"), F.col("last"), F.col("open"), slot)
    lefts = C.written(left.select("id", "client", start.alias("start"), end.alias("end")), "overlap-left")
    rights = right.select("client", start.alias("start"), end.alias("end"), F.crc32(F.col("first").cast("string")).alias("crc"))
    groups = C.written(rights.groupBy("client", "start", "end").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "overlap-right")
    summed = weighted_overlaps(lefts.select("client", "start", "end").distinct(), groups, chunk)
    return lefts.join(summed, ["client", "start", "end"]).select("id", relation(F.col("code")).alias("relation"), "n_pairs", "overlap_slots", "crc")


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, client, first, last, open) of sales; lines of a sale move its end to the latest shipping."""
    shipped = lines.where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max("shipped_at").alias("shipped_at"))
    shipped = shipped.select(F.col("sale_id").alias("of"), micros(shipped, "shipped_at").alias("shipped"))
    rows = sales.select("sale_id", F.col("client_id").alias("client"), micros(sales, "sold_at").alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open")).where("client IS NOT NULL AND first IS NOT NULL")
    return rows.join(shipped, F.col("sale_id") == F.col("of"), "left").select(F.col("sale_id").alias("id"), "client", "first", F.greatest("first", "shipped").alias("last"), "open")


def op12_overlap_join(spark, sf_dir: str) -> DataFrame:
    clicks, sales, lines = (C.table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines"))
    out = overlap_join(sale_intervals(sales, lines), sessions(clicks))
    return out.select(F.col("id").alias("sale_id"), "relation", "n_pairs", "overlap_slots", F.col("crc").alias("sessions_crc"))


ORACLE = rf"""
WITH c AS (SELECT client_id, epoch_us(ts) AS u, bool_or(coalesce(kind = 'error', false)) AS bad FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN u - p <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY u) AS no FROM (SELECT *, lag(u) OVER (PARTITION BY client_id ORDER BY u) AS p FROM c)),
r AS (SELECT client_id, min(u) AS u, max(u) AS v, arg_max(bad, u) AS unended FROM n GROUP BY client_id, no),
-- far is later than every slot; equal to itself, as open ends are
w AS (SELECT client_id, CAST(floor(u / 21600000000) AS BIGINT) AS a, CASE WHEN unended THEN 1000000000000 ELSE CAST(floor(v / 21600000000) AS BIGINT) END AS b, {C.CRC32.format("CAST(u AS VARCHAR)")} AS crc FROM r),
m AS (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id),
t AS (
  SELECT row_number() OVER () AS rn, sale_id, client_id, CAST(floor(epoch_us(sold_at) / 21600000000) AS BIGINT) AS s,
         CASE WHEN status = 'open' THEN 1000000000000 ELSE CAST(floor(epoch_us(greatest(sold_at, shipped)) / 21600000000) AS BIGINT) END AS e
  FROM sales LEFT JOIN m USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), p AS (
  SELECT rn, sale_id, crc, CASE WHEN e = b AND e = 1000000000000 THEN NULL ELSE least(e, b) - greatest(s, a) + 1 END AS shared,
         CASE WHEN s < a THEN CASE WHEN e < b THEN 'overlaps' WHEN e = b THEN 'finished_by' ELSE 'contains' END
              WHEN s = a THEN CASE WHEN e < b THEN 'starts' WHEN e = b THEN 'equals' ELSE 'started_by' END
              ELSE CASE WHEN e < b THEN 'during' WHEN e = b THEN 'finishes' ELSE 'overlapped_by' END END AS relation
  FROM t JOIN w USING (client_id) WHERE s <= b AND a <= e
)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM p GROUP BY rn, sale_id, relation
"""
