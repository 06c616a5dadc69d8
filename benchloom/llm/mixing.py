"""Operator 6, mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as
they are), normalised. Bisection finds the smallest exponent whose weights keep the entropy at or
below a target and let no source repeat more often than a limit. A budget of tokens is then dealt by
weight: whole passes over a source, and a last partial pass. Each pass reads a source as a permutation of
its own of blocks of bounded size, and a block as a permutation of its documents; both follow from keyed
MD5s, so a reader that sorts a source by (epoch, block_order, place) replays it from any position. Prefix
sums of blocks, in two levels, place the budget's end in one block, and only inside a block are documents
summed one by one, so no task holds a whole source.

Defined cases: a null or empty text has no tokens; a null source is a source of its own; a source
without tokens has weight 0 and is left out; documents without tokens come with every whole pass;
with an empty table or no tokens the result is empty; repeated rows are documents of their own and
ids may be null; rows that agree in id and text stand in one block; other columns are ignored. If even
exponent 1 repeats more than the limit (budget over limit * tokens), exponent 1 is used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

ENTROPY_RATIO = 0.97
REPEATS = 4.0
BLOCK_ROWS = 4096
#: Bisection steps made in a job, and in all.
STEPS_A_JOB = 5
STEPS = 40
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _facts(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, most repeats) at each exponent, as one aggregation over the sources."""
    a = F.col("tokens").cast("double")
    aggs = []
    for i, e in enumerate(exponents):
        p = F.pow(a / F.col("all_tokens"), F.lit(e))
        aggs += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"l{i}"), F.max(p / a).alias(f"r{i}")]
    row = sources.agg(*aggs).first()
    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"] * budget) for i in range(len(exponents))]


def find_exponent(sources: DataFrame, n_sources: int, budget: float, entropy_ratio: float = ENTROPY_RATIO, repeats: float = REPEATS) -> float:
    """sources: tokens > 0 and all_tokens. The smallest exponent in [0, 1] that meets both limits."""
    most = entropy_ratio * math.log(n_sources) if n_sources > 1 else 0.0
    fine = lambda f: f[0] <= most + 1e-12 and f[1] <= repeats + 1e-12
    at_0, at_1 = _facts(sources, [0.0, 1.0], budget)
    if fine(at_0) or not fine(at_1):
        # a target entropy below the natural one can't be met by flattening: keep the shares
        return 0.0 if fine(at_0) else 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS // STEPS_A_JOB):
        n = 2**STEPS_A_JOB
        grid = [low + (high - low) * i / n for i in range(1, n)]
        facts = _facts(sources, grid, budget)
        lo, hi = -1, n - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fine(facts[mid]) else (mid, hi)
        low, high = (grid[lo] if lo >= 0 else low), (grid[hi] if hi < n - 1 else high)
    return high


def _hex(c: Column, digits: int) -> Column:
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, entropy_ratio: float = ENTROPY_RATIO, repeats: float = REPEATS, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """(doc_id, source, epoch, block, block_order, place, n_tokens): a row for each time a document is to be read.

    epoch counts a source's passes from 0; block_order ranks the blocks of a pass and place, from 1, the
    documents of a block in it. budget: tokens in all, those of the input if None.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), tokens_of(text).alias("n_tokens"), draw.alias("draw"))
    rows = C.written(rows.withColumns({"no_source": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}), "mix-rows")
    key = ["no_source", "name"]
    stats = rows.groupBy(key).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")
    total, n_sources, most = stats.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*"), F.max("docs")).first()
    budget = int(total) if budget is None else budget
    stats = C.written(stats.withColumn("all_tokens", F.lit(total).cast("double")), "mix-sources")
    exponent = find_exponent(stats, n_sources, budget, entropy_ratio, repeats) if n_sources else 1.0
    share = F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(exponent))
    z = stats.agg(F.sum(share)).first()[0] or 1.0
    plan = stats.withColumn("target", F.floor(share / F.lit(z) * F.lit(float(budget)) + 1e-6).cast("long"))
    plan = plan.select(*key, F.ceil(F.col("docs") / block_rows).cast("long").alias("blocks"), F.floor(F.col("target") / F.col("tokens")).cast("long").alias("passes"), (F.col("target") % F.col("tokens")).alias("rest"))
    dealt = rows.join(plan, key).withColumn("block", F.pmod(_hex(F.col("draw"), 8), F.col("blocks")))
    order = lambda epoch: _hex(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("no_source").cast("string"), F.col("name"), F.col("block").cast("string"))), 15)
    # where each block ends in its source's partial pass: sums of runs of blocks first, then inside the runs
    digits = max(1, math.ceil(math.log(max(1, (most or 0) / block_rows), 16) / 2))
    sizes = dealt.groupBy(*key, "block", "passes", "rest").agg(F.sum("n_tokens").alias("size")).withColumn("block_order", order(F.col("passes")))
    sizes = sizes.withColumn("run", F.shiftright("block_order", 4 * (15 - digits)))
    runs = sizes.groupBy(*key, "run").agg(F.sum("size").alias("in_run"))
    runs = runs.withColumn("before", F.sum("in_run").over(Window.partitionBy(key).orderBy("run")) - F.col("in_run")).drop("in_run")
    ends = sizes.join(runs, [*key, "run"]).withColumn("start", F.col("before") + F.sum("size").over(Window.partitionBy(*key, "run").orderBy("block_order", "block")) - F.col("size"))
    # the partial pass reads a block as a whole, up to `left` tokens, or not at all
    last = ends.select(*key, "block", (F.col("rest") - F.col("start")).alias("left"), (F.col("start") + F.col("size") <= F.col("rest")).alias("fits"))
    placed = dealt.join(last, [*key, "block"])
    more = (F.col("fits") | (F.col("left") > 0)).cast("int")
    reads = placed.withColumn("times", F.col("passes") + more).where("times > 0")
    reads = reads.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    inside = Window.partitionBy(*key, "epoch", "block").orderBy(F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.col("draw"))), "n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reads = reads.withColumns({"place": F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)), "read": F.sum("n_tokens").over(inside)})
    reads = reads.where((F.col("epoch") < F.col("passes")) | F.col("fits") | (F.col("read") <= F.col("left")))
    return reads.select("doc_id", "source", "epoch", "block", order(F.col("epoch")).alias("block_order"), "place", "n_tokens")


def op6_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents
), s AS (SELECT no_source, name, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
l AS (SELECT list(CAST(tokens AS DOUBLE)) AS t, CAST(sum(tokens) AS DOUBLE) AS total, CASE WHEN count(*) > 1 THEN 0.97 * ln(count(*)) ELSE 0 END + 1e-12 AS most FROM s),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS e
  UNION ALL
  -- steps 0 and 1 try both ends, the others halve the interval
  SELECT i + 1, CASE WHEN i < 2 OR ok THEN lo ELSE e END, CASE WHEN i = 0 AND ok THEN 0 WHEN i < 2 THEN hi WHEN ok THEN e ELSE hi END,
         CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN CASE WHEN ok THEN 0.5 ELSE 2 END WHEN e = 2 THEN 2 WHEN ok THEN (lo + e) / 2 ELSE (e + hi) / 2 END
  FROM (SELECT bis.*, ln(list_sum(list_transform(t, lambda a: pow(a / total, e)))) - list_sum(list_transform(t, lambda a: pow(a / total, e) * ln(pow(a / total, e)))) / list_sum(list_transform(t, lambda a: pow(a / total, e))) <= most
                 AND list_max(list_transform(t, lambda a: pow(a / total, e) / a)) / list_sum(list_transform(t, lambda a: pow(a / total, e))) * total <= 4 + 1e-12 AS ok
        FROM bis, l WHERE i < 42)
), x AS (SELECT CASE WHEN (SELECT hi FROM bis WHERE i = 1) = 0 THEN 0 WHEN max(e) = 2 THEN 1 ELSE min(hi) END AS e FROM bis),
w AS (SELECT s.*, pow(tokens / total, e) AS p, total FROM s, l, x),
plan AS (
  SELECT no_source, name, CAST(ceil(docs / 4096) AS BIGINT) AS blocks, target // tokens AS passes, target % tokens AS rest
  FROM (SELECT *, CAST(floor(p / (sum(p) OVER ()) * total + 1e-6) AS HUGEINT) AS target FROM w)
), dealt AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % blocks AS block FROM d JOIN plan USING (no_source, name)),
b AS (SELECT no_source, name, block, passes, rest, sum(n_tokens) AS size FROM dealt GROUP BY ALL),
o AS (SELECT *, sum(size) OVER (PARTITION BY no_source, name ORDER BY CAST('0x' || substr(md5('42:' || CAST(passes AS VARCHAR) || ':' || CAST(no_source AS VARCHAR) || ':' || name || ':' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT), block) AS e FROM b),
r AS (
  SELECT doc_id, source, no_source, name, draw, n_tokens, block, dealt.passes, unnest(generate_series(0, CAST(dealt.passes AS BIGINT) - CASE WHEN e <= dealt.rest OR e - size < dealt.rest THEN 0 ELSE 1 END)) AS epoch, e <= dealt.rest AS fits, dealt.rest - (e - size) AS space
  FROM dealt JOIN o USING (no_source, name, block)
), n AS (
  SELECT *, row_number() OVER v AS place, sum(n_tokens) OVER v AS done
  FROM r WINDOW v AS (PARTITION BY no_source, name, epoch, block ORDER BY md5(CAST(epoch AS VARCHAR) || ':' || draw), n_tokens, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, block, CAST('0x' || substr(md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(no_source AS VARCHAR) || ':' || name || ':' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT) AS block_order,
       CAST(place AS INTEGER) AS place, n_tokens
FROM n WHERE epoch < passes OR fits OR done <= space
"""
