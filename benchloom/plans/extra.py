"""More registered queries: curation, code in thinking, schedules, packing with masks, sources, workers and commands."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchloom import commands
from benchloom.functions import arrays as A
from benchloom.functions import code_blocks
from benchloom.functions import prompts as P
from benchloom.functions import subwords
from benchloom.functions import text as T
from benchloom.operators import curate, evaluate, generate, harness, packing, pools, results
from benchloom.plans.catalog import _POOL, _TEST, _TRAIN, _VAL, query
from benchloom.plans.views import table, view
from benchloom.schemas import EXAMPLE
from benchloom.sources import metrics, sink, spec
from benchloom.streaming import keyed


def _folder(spark) -> str:
    return f"{curate.shared_dir(spark)}/query-{uuid.uuid4().hex}"


# --- problems


def _raw(spark, d):
    """Documents as raw problems: lines are examples, every fifth document's first one has no output."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("input"), F.when((i > 0) | (F.col("doc_id") % 5 != 0), F.length(x).cast("string")).alias("output")))
    null = lambda t: F.lit(None).cast(t)
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), null("string").alias("prompt"), F.col("lang").alias("generation"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("description"), lines.alias("examples"),
        F.lit(1.5).alias("time_limit"), F.lit(256.0).alias("memory_limit"), null("string").alias("input_format"), null("string").alias("output_format"), F.col("source").alias("note"),
        F.col("source").alias("title"), F.lit("round").alias("contest_name"), F.lit(2020).alias("contest_start_year"), "doc_id",
    )


_RAW = "r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx, len(string_split(text, chr(10))) - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n FROM documents)"


@query(f"WITH {_RAW} SELECT CAST(idx AS BIGINT) AS idx, CAST(doc_id AS VARCHAR) AS source_id, lang AS response, md5(text) AS statement, source AS problem_notes, CAST(n AS INTEGER) AS n_examples, CASE WHEN doc_id % 5 = 0 THEN string_split(text, chr(10))[2] ELSE string_split(text, chr(10))[1] END AS first_input, contest_start_year FROM r, (SELECT CAST(2020 AS INTEGER) AS contest_start_year) WHERE doc_id % 7 <> 0 AND n > 0")
def raw_to_solutions(spark, d):
    s = curate.solutions(_raw(spark, d), ["doc_id"])
    return s.select("idx", "source_id", "response", F.md5("problem_statement").alias("statement"), "problem_notes", F.size("examples").alias("n_examples"), F.get("examples", F.lit(0))["input"].alias("first_input"), "contest_start_year")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE len(string_split(text, chr(10))) > 1) WHERE k >= 10 AND k < 60")
def valid_rows_slice(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("examples"))
    return curate.valid_slice(docs, "doc_id", 10, 50).select("doc_id")


@query("SELECT NOT EXISTS (SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS is_subset, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))) AS n_missing")
def subset_check(spark, d):
    return curate.is_subset(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(f"WITH {_POOL}, {_TEST}, {_VAL}, {_TRAIN}, u AS (SELECT doc_id FROM t UNION ALL SELECT doc_id FROM v UNION ALL SELECT doc_id FROM n) SELECT CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) AS n_shared, count(*) AS n FROM u")
def split_disjointness(spark, d):
    """The invariant of the splits: no document stands in two of them."""
    from benchloom.plans import catalog as K

    parts = [K.QUERIES[f"split_{n}"](spark, d).select("doc_id", F.lit(n).alias("split")) for n in ("test", "validation", "train")]
    every = curate.shared_table(parts[0].unionByName(parts[1]).unionByName(parts[2]), "splits")
    return every.groupBy("doc_id").count().agg(F.sum(F.col("count") - 1).alias("n_shared"), F.sum("count").alias("n"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS BIGINT) AS position FROM orders")
def seeded_shuffle(spark, d):
    return curate.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, (count(*) OVER () + 31) // 32 AS each FROM orders), e AS (SELECT o_orderkey, CAST(epoch AS BIGINT) AS epoch, CAST(idx // 32 + epoch * each AS BIGINT) AS batch FROM o, (SELECT unnest([0, 1, 2]) AS epoch)) SELECT *, CASE WHEN batch > 0 THEN batch - 1 END AS previous FROM e")
def epoch_batches(spark, d):
    """Batches of every epoch, and the batch whose outputs each one trains on (one behind)."""
    return curate.epoch_batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 32, 3)


@query("SELECT o_orderkey, CAST(s AS INTEGER) AS start FROM orders, (SELECT unnest(generate_series(0, 15, 4)) AS s)")
def micro_batch_cross(spark, d):
    """Every item of a buffer with every start of a micro-batch in its group of 16."""
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(15), F.lit(4))).alias("start"))


@query("SELECT o_orderkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'no right row' WHEN o_orderkey IS NULL THEN 'no left row' END AS problem FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) USING (k)")
def positional_join(spark, d):
    """Whole tables of different length: every row, and what is wrong with it."""
    a, b = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "customer").select("c_custkey")
    return curate.joined_by_position(a, b, ["o_orderkey"], ["c_custkey"], problem="problem")


@query("SELECT event_id, md5(CAST(user_id AS VARCHAR) || event_type) AS status FROM events")
def run_and_fan_out(spark, d):
    """One run for each distinct (user, type), its result on every event that has them."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("item_id"), "user_id", "event_type")
    run = lambda x: x.select("item_id", F.md5(F.concat(F.col("user_id").cast("string"), "event_type")).alias("status"))
    return results.run_and_fan_out(e, ["user_id", "event_type"], run).select(F.col("item_id").cast("long").alias("event_id"), "status")


@query("SELECT item_id, status FROM (SELECT CAST(event_id AS VARCHAR) AS item_id, CASE WHEN event_type = 'error' THEN 'fail:no-answer' ELSE 'success' END AS status FROM events)")
def results_with_rejected(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("item_id"), F.when(F.col("event_type") != "error", "x").alias("answer"))
    return results.with_rejected(e.where("answer IS NOT NULL").select("item_id", F.lit("success").alias("status")), e)


@query("SELECT CAST(doc_id AS VARCHAR) AS idx, CASE WHEN q IS NULL OR q = 0 THEN 'fail:no-tests' END AS status FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))")
def no_tests_status(spark, d):
    answers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("idx"))
    tests = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("idx"), F.when(F.col("quality") == 1, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("test_cases"))
    return results.without_tests(answers, tests).select("idx", "status")


@query("SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS name, CASE WHEN lang IN ('en', 'de', 'fr') THEN NULL ELSE 'unknown key ' || coalesce(lang, 'null') END AS problem FROM documents GROUP BY lang")
def registry_lookup(spark, d):
    """Every document; keys that the registry lacks are reported."""
    known = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French")], "lang string, name string")
    found = results.lookup(table(spark, d, "documents").select("lang"), known, "lang", problem="problem")
    return found.groupBy("lang", "name", "problem").agg(F.count("*").alias("n"))


# --- texts


@query("""SELECT conv_id, turn, [CASE WHEN length(p2) < 100 THEN p1 || chr(10) || chr(10) || p2 ELSE p1 END, p4] AS blocks, CAST(length(p1) + length(p2) + 28 AS INTEGER) AS second_at, 'x = ' || CAST(conv_id AS VARCHAR) || chr(10) AS answer
FROM (SELECT conv_id, turn, 'a = ' || CAST(turn AS VARCHAR) AS p1, 'b = "' || t || '"' AS p2, 'c = "' || t || '"' || chr(10) || 'd = 2' AS p4 FROM (SELECT *, regexp_replace(coalesce(text, ''), '["\\\\\\n\\r\\x00]', ' ', 'g') AS t FROM conversations))""")
def find_code(spark, d):
    """Code paragraphs of the thinking: a line with the text is one only if it is short; neighbours merged, prose left out; then the final block."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\\n\r\x00]', " ")
    say = F.concat(
        F.lit("<think>\na = "), F.col("turn").cast("string"), F.lit('\n\nb = "'), t, F.lit('"\n\nwe now say a few words\n\nc = "'), t, F.lit('"\nd = 2\n\nd = (\n\nmore words here\n</think>\n\nso:\n```py\nx = '),
        F.col("conv_id").cast("string"), F.lit("\n```\n"),
    )
    c = table(spark, d, "conversations").select("conv_id", "turn", say.alias("response"))
    blocks, answer = code_blocks.find_code(F.col("response"))
    places = code_blocks.find_code_blocks(T.strip_open_think(F.col("response")))
    return c.select("conv_id", "turn", blocks.alias("blocks"), F.get(places["blocks"], F.lit(1))["at"].alias("second_at"), answer.alias("answer"))


@query("SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[\\n\\r\\x00]') AS fine FROM documents")
def parseable_python(spark, d):
    """A document's text as a string in one line: no program if the text has a line break."""
    code = F.concat(F.lit("def f():\n    return '"), F.translate(F.coalesce("text", F.lit("")), "'\\", ""), F.lit("'"))
    return table(spark, d, "documents").select("doc_id", code_blocks.parses_as_python(code).alias("fine"))


@query("SELECT conv_id, turn, contains(text, 'input()') AND contains(text, 'print(') OR turn % 2 = 0 AS fine FROM conversations")
def looks_like_answer(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit("x = input()\nprint(x)"))).otherwise(F.concat(F.col("text"), F.lit('x = input ("a")\nprint (x)')))
    return table(spark, d, "conversations").select("conv_id", "turn", T.looks_like_io_answer(said).alias("fine"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'x' || text ELSE text END AS rest FROM conversations")
def thinking_or_all(spark, d):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>\nabc\n</think>\n\nx"), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.after_thinking_or_all(said).alias("rest"))


@query("SELECT item_id, 'Solve this task.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Input: a number' || chr(10) || 'Output: a word' || chr(10) || chr(10) || 'For the input' || chr(10) || CAST(item_id AS VARCHAR) || chr(10) || 'the output is' || chr(10) || 'w' || CAST(item_id AS VARCHAR) || chr(10) || chr(10) || 'Think first, then give a whole program in Lua 5.1, in one block that starts with ```lua.' || chr(10) AS prompt FROM benchmark")
def translated_prompt(spark, d):
    n = F.col("item_id").cast("string")
    tests = F.array(F.struct(n.alias("input"), F.concat(F.lit("w"), n).alias("output")), F.struct(F.lit("9").alias("input"), F.lit("9").alias("output")))
    said = P.translated_prompt(F.col("text"), F.lit("a number"), F.lit("a word"), tests, F.lit(commands.LONG_NAMES["lua"]), F.lit("lua"))
    return table(spark, d, "benchmark").select("item_id", said.alias("prompt"))


@query("SELECT conv_id, turn, to_json([{'role': 'system', 'content': '/no_think'}, {'role': 'user', 'content': 'before'}, {'role': 'assistant', 'content': 'then'}, {'role': 'user', 'content': text}]) AS messages, 'p' || chr(10) || chr(10) || text AS joined FROM conversations WHERE text IS NOT NULL")
def model_messages(spark, d):
    pairs = F.array(F.struct(F.lit("before").alias("user"), F.lit("then").alias("assistant")))
    said = P.model_messages(F.col("text"), F.lit(None).cast("string"), "smollm3", pairs)
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.to_json(said).alias("messages"), T.joined(F.lit("p"), F.col("text")).alias("joined"))


@query("SELECT conv_id, CAST(count(*) - 1 AS INTEGER) AS n_prompt, arg_max(text, turn) AS completion, CAST(octet_length(encode(arg_max(text, turn))) AS INTEGER) AS n_tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def chat_split(spark, d):
    """The last message is the completion, the others the prompt; tokens are bytes."""
    msgs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    c = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(msgs.alias("m"))
    before, last = A.chat_parts(F.col("m"))
    return c.select("conv_id", F.size(before).alias("n_prompt"), last.alias("completion"), F.size(A.byte_tokens(last)).alias("n_tokens"))


@query("SELECT doc_id, quality, toxic, 'x' AS kind FROM labels")
def open_json_splat(spark, d):
    """A JSON object's known keys as columns, the rest as a variant; bad JSON is null."""
    said = F.to_json(F.struct("doc_id", "quality", F.struct("toxic", F.lit("x").alias("kind")).alias("more")))
    v = T.parsed(said)
    got = table(spark, d, "labels").select(v.alias("v"), T.parsed(F.lit("{bad")).alias("bad")).where("bad IS NULL")
    pick = lambda path, t: F.variant_get("v", path, t)
    return got.select(pick("$.doc_id", "long").alias("doc_id"), pick("$.quality", "int").alias("quality"), pick("$.more.toxic", "int").alias("toxic"), pick("$.more.kind", "string").alias("kind"))


@query("SELECT item_id, status, CASE WHEN status = 'fail:timeout' THEN 15.0 END AS timeout_s, CASE WHEN status = 'fail:error' THEN 3 END AS exit_code FROM v_results")
def extras_splat(spark, d):
    """A result's extras become columns of their own, null where a status has none."""
    extra = F.struct(F.when(F.col("status") == "fail:timeout", 15.0).alias("timeout_s"), F.when(F.col("status") == "fail:error", 3).alias("exit_code"))
    return view(spark, d, "v_results").select("item_id", "status", extra.alias("extra")).select("item_id", "status", "extra.*")


@query("SELECT user_id, event_id, CASE WHEN user_id % 5 = 0 THEN 30 ELSE user_id % 5 END AS timeout, len(list_filter(string_split(event_type || ',,b', ','), lambda x: x <> '')) AS n FROM events")
def falsy_defaults(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", T.or_default(F.col("user_id") % 5, 30).cast("long").alias("timeout"), F.size(T.comma_list(F.concat("event_type", F.lit(",,b")))).cast("long").alias("n"))


# --- training arithmetic


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label)), 6) + 0.0 AS total, round(CAST(embedding[1] AS DOUBLE) * label, 6) + 0.0 AS first FROM embeddings WHERE label IS NOT NULL")
def advantage_product(spark, d):
    s = A.scaled(F.col("embedding").cast("array<double>"), F.col("label").cast("double"))
    e = table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", s.alias("s"))
    return e.select("vec_id", (F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"), (F.round(F.get("s", F.lit(0)), 6) + 0.0).alias("first"))


@query("SELECT label, round(-avg(m) / 8, 6) AS loss FROM (SELECT label, list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END)) / (len(embedding) // 2) AS m FROM embeddings) GROUP BY label")
def loss_reduction(spark, d):
    """Masked means over every second position, then the micro-batch's loss."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    mean = A.masked_mean(F.col("x"), F.transform("x", lambda v, i: (i % 2).cast("double")))
    return e.select("label", mean.alias("m")).groupBy("label").agg(F.round(A.loss(F.col("m"), 8), 6).alias("loss"))


@query("SELECT vec_id, round(list_sum(list_transform(generate_series(1, 4), lambda i: CAST(embedding[i + (vec_id + i) % 3] AS DOUBLE))), 6) AS total FROM embeddings")
def gather_by_token(spark, d):
    """Each position's row of three numbers, and of it the one that the token id names."""
    x = F.col("embedding").cast("array<double>")
    at = F.sequence(F.lit(1), F.lit(4))
    e = table(spark, d, "embeddings").select("vec_id", F.transform(at, lambda i: F.slice(x, i, 3)).alias("matrix"), F.transform(at, lambda i: ((F.col("vec_id") + i) % 3).cast("int")).alias("ids"))
    return e.select("vec_id", F.round(F.aggregate(A.gathered(F.col("matrix"), F.col("ids")), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("""WITH s AS (SELECT o_orderkey AS k, 1 + o_orderkey % 4 AS epochs, 1 + o_orderkey % 3 AS evals, 40 + o_orderkey % 50 AS max_steps FROM orders),
t AS (SELECT *, max_steps // epochs // evals AS between, max_steps // epochs AS each FROM s)
SELECT k, list_reverse(list_filter(list_transform(generate_series(1, evals * epochs), lambda i: i * between), lambda x: x < evals * epochs * between OR max_steps - 1 - evals * epochs * between >= between)) AS steps,
       each <> 0 AND 20 % each = 0 OR max_steps = 20 AS is_end, CAST(epochs * (max_steps // 4) AS BIGINT) AS n_steps, CAST(floor(max_steps * 0.1) AS BIGINT) AS warmup FROM t""")
def training_schedule(spark, d):
    """Evaluation steps, end of an epoch at step 20, all steps, warm-up."""
    o = F.col("o_orderkey")
    s = table(spark, d, "orders").select(o.alias("k"), (1 + o % 4).alias("epochs"), (1 + o % 3).alias("evals"), (40 + o % 50).alias("m"))
    return s.select("k", A.evaluation_steps(F.col("m"), F.col("epochs"), F.col("evals")).alias("steps"), A.is_epoch_end(F.lit(20), F.col("m"), F.col("epochs")).alias("is_end"), A.steps_of(F.col("m"), F.lit(4), F.col("epochs")).alias("n_steps"), A.warmup_steps(F.col("m"), F.lit(0.1)).alias("warmup"))


@query("SELECT o_orderkey, o_orderkey / 25 AS epoch, o_orderkey > 1 AND (o_orderkey - 1) % 25 = 0 AS saves, CASE WHEN o_orderkey > 1 AND (o_orderkey - 1) % 25 = 0 THEN (o_orderkey - 1) // 25 END AS number, CAST(o_totalprice AS DOUBLE) / 1073741824 AS gib FROM orders")
def epoch_progress(spark, d):
    s = F.col("o_orderkey")
    saves = (s > 1) & ((s - 1) % 25 == 0)
    return table(spark, d, "orders").select(s, (s / 25).alias("epoch"), saves.alias("saves"), F.when(saves, F.floor((s - 1) / 25)).alias("number"), A.gib(F.col("o_totalprice").cast("double")).alias("gib"))


@query("SELECT round(avg(m), 9) AS mean_of_groups, CAST(max(n) AS INTEGER) AS longest, round(avg(coalesce(z, 0)), 9) AS with_zeros FROM (SELECT avg(CAST(l_quantity AS DOUBLE)) AS m, count(*) AS n, CASE WHEN count(*) > 2 THEN avg(CAST(l_discount AS DOUBLE)) END AS z FROM lineitem GROUP BY l_orderkey)")
def batch_means(spark, d):
    """The mean of group means, the longest item, and a mean in which skipped groups count as zero."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity").cast("double")).alias("m"), F.collect_list("l_linenumber").alias("tokens"), F.avg(F.col("l_discount").cast("double")).alias("x"))
    z = F.when(F.size("tokens") > 2, F.col("x"))
    return g.agg(F.round(F.avg("m"), 9).alias("mean_of_groups"), F.max(F.size("tokens")).alias("longest"), F.round(F.avg(F.coalesce(z, F.lit(0.0))), 9).alias("with_zeros"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS n, CAST(sum(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END) AS BIGINT) AS trainable, printf('%.2f%%', 100.0 * sum(CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END) / sum(p_size)) AS share FROM part")
def parameter_counts(spark, d):
    p = table(spark, d, "part").select("p_size", (F.col("p_partkey") % 3 != 0).alias("trains"))
    n, t = F.sum("p_size").cast("long"), F.sum(F.when(F.col("trains"), F.col("p_size")).otherwise(0)).cast("long")
    return p.agg(n.alias("n"), t.alias("trainable"), T.percent(t / n).alias("share"))


@query("SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS total_us, count(*) - 1 AS laps FROM events GROUP BY user_id")
def lap_totals(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    lap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", lap.alias("lap")).groupBy("user_id").agg(F.coalesce(F.sum("lap"), F.lit(0)).cast("long").alias("total_us"), F.count("lap").alias("laps"))


def _shards(n):
    return f"""WITH RECURSIVE c AS (SELECT conv_id, flatten(list(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: CAST(length(x) AS BIGINT)) ORDER BY turn)) AS t FROM conversations GROUP BY conv_id),
i AS (SELECT row_number() OVER (ORDER BY conv_id) AS k, t, len(t) AS n FROM c),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS total UNION ALL
      SELECT f.k + 1, f.total + CASE WHEN f.k > 0 AND f.total % {n} <> 0 THEN 1 ELSE 0 END, f.total + CASE WHEN f.k > 0 AND f.total % {n} <> 0 THEN 1 ELSE 0 END + i.n FROM f JOIN i ON i.k = f.k + 1),
p AS (SELECT start + j - 1 AS pos, t[j] AS tok, CASE WHEN j <= 2 THEN 0 ELSE 1 END AS mask FROM (SELECT f.start, i.t, unnest(generate_series(1, i.n)) AS j FROM f JOIN i USING (k))),
a AS (SELECT pos, coalesce(tok, 0) AS tok, coalesce(mask, 1) AS mask FROM (SELECT unnest(generate_series(0, (SELECT max(total) FROM f) - 1)) AS pos) LEFT JOIN p USING (pos))
SELECT pos // {n} AS row, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS ids, string_agg(CAST(mask AS VARCHAR), '' ORDER BY pos) AS prompt_mask, repeat('1', count(*)) AS attention FROM a GROUP BY 1"""


@query(_shards(128))
def pack_with_masks(spark, d):
    """Packed tokens with their prompt and attention masks, separators included, as texts."""
    words = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda x: F.length(x).cast("long"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", words.alias("t")))), lambda x: x["t"])).alias("tokens"))
    c = c.withColumns({"prompt_mask": F.transform("tokens", lambda x, i: F.when(i < 2, 0).otherwise(1)), "attention_mask": F.transform("tokens", lambda x: F.lit(1))})
    packed = packing.pack(c, 128, 0, "conv_id", masks={"prompt_mask": 1, "attention_mask": 1})
    said = lambda col, sep: F.array_join(F.col(col).cast("array<string>"), sep)
    return packed.select("row", said("input_ids", " ").alias("ids"), said("prompt_mask", "").alias("prompt_mask"), said("attention_mask", "").alias("attention"))


#: A small vocabulary for queries: all bytes, then these in the order of their ranks.
_MERGES = ["er", "on", "en", "an", "re", "le", "ou", "th", "ti", "ent", "tion", " d", " l", " le", " de", "eau", "men", "ment", "the", "que", " the", "and", "ing", "qu", "au", "ea", "in", "us", "as", "se"]
_PATTERN = " ?[^ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+"
_CHAT = f"""WITH RECURSIVE vocab AS (
  SELECT map_from_entries(list((hex(encode(t)), r))) AS m FROM (SELECT unnest({_MERGES!r}) AS t, unnest(range(256, {256 + len(_MERGES)})) AS r)
), voc AS (SELECT map_concat((SELECT map_from_entries(list((printf('%02X', i), i))) FROM range(256) b(i)), m) AS m FROM vocab),
msgs AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), parts AS (
  -- each message's texts and control tokens in order: 300 begins a message, 301 ends it
  SELECT conv_id, k * 10 + 0 AS spot, 300 AS control, NULL AS text, 0 AS mask FROM msgs WHERE k < n
  UNION ALL SELECT conv_id, k * 10 + 1, NULL, role || chr(10) || text, 0 FROM msgs WHERE k < n
  UNION ALL SELECT conv_id, k * 10 + 2, 301, NULL, 0 FROM msgs WHERE k < n
  UNION ALL SELECT conv_id, k * 10 + 3, NULL, chr(10), 0 FROM msgs WHERE k < n
  UNION ALL SELECT conv_id, k * 10 + 0, 300, NULL, 0 FROM msgs WHERE k = n
  UNION ALL SELECT conv_id, k * 10 + 1, NULL, 'assistant' || chr(10), 0 FROM msgs WHERE k = n
  UNION ALL SELECT conv_id, k * 10 + 2, NULL, text, 1 FROM msgs WHERE k = n
  UNION ALL SELECT conv_id, k * 10 + 3, 301, NULL, 1 FROM msgs WHERE k = n
), words AS (SELECT conv_id, spot, mask, unnest(regexp_extract_all(text, '{_PATTERN}')) AS w, generate_subscripts(regexp_extract_all(text, '{_PATTERN}'), 1) AS j FROM parts WHERE text IS NOT NULL),
steps AS (
  SELECT w, CASE WHEN map_contains(m, hex(encode(w))) THEN [hex(encode(w))] ELSE regexp_extract_all(hex(encode(w)), '..') END AS p, 0 AS s FROM (SELECT DISTINCT w FROM words), voc
  UNION ALL
  SELECT w, p[1:i - 1] || [p[i] || p[i + 1]] || p[i + 2:], s + 1
  FROM (SELECT w, p, s, list_min(list_transform(range(1, len(p)), lambda i: {{'r': coalesce(map_extract_value(m, p[i] || p[i + 1]), 1000000), 'i': i}})) AS best FROM steps, voc WHERE len(p) > 1), LATERAL (SELECT best.i AS i) WHERE best.r < 1000000
), coded AS (SELECT w, list_transform(arg_max(p, s), lambda x: map_extract_value(any_value(m), x)) AS ids FROM steps, voc GROUP BY w),
every AS (
  SELECT conv_id, spot, 0 AS j, [control] AS ids, mask FROM parts WHERE control IS NOT NULL
  UNION ALL SELECT conv_id, spot, j, ids, mask FROM words JOIN coded USING (w)
), c AS (SELECT conv_id, flatten(list(ids ORDER BY spot, j)) AS t, flatten(list(list_transform(ids, lambda x: mask) ORDER BY spot, j)) AS g FROM every GROUP BY conv_id),
i AS (SELECT row_number() OVER (ORDER BY conv_id) AS k, t, g, len(t) AS n FROM c),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS total UNION ALL
      SELECT f.k + 1, f.total + CASE WHEN f.k > 0 AND f.total % 256 <> 0 THEN 1 ELSE 0 END, f.total + CASE WHEN f.k > 0 AND f.total % 256 <> 0 THEN 1 ELSE 0 END + i.n FROM f JOIN i ON i.k = f.k + 1),
p AS (SELECT start + j - 1 AS pos, t[j] AS tok, g[j] AS mask FROM (SELECT f.start, i.t, i.g, unnest(generate_series(1, i.n)) AS j FROM f JOIN i USING (k))),
a AS (SELECT pos, coalesce(tok, 302) AS tok, coalesce(mask, 1) AS mask FROM (SELECT unnest(generate_series(0, (SELECT max(total) FROM f) - 1)) AS pos) LEFT JOIN p USING (pos))
SELECT pos // 256 AS row, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY pos) AS ids, string_agg(CAST(mask AS VARCHAR), '' ORDER BY pos) AS prompt_mask FROM a GROUP BY 1"""


@query(_CHAT)
def chat_masks(spark, d):
    """Conversations as subword tokens with masks and end tokens, packed in one order; every merge checked by a recursion."""
    texts = [bytes([i]) for i in range(256)] + [m.encode() for m in _MERGES]
    vocabulary = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(texts)], "token binary, rank int")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    rows = subwords.chat_rows(c, subwords.tokenizer(vocabulary), 300, 301, keep=["conv_id"])
    packed = packing.pack(rows, 256, 302, "conv_id", tokens="input_ids", masks={"prompt_mask": 1, "attention_mask": 1})
    said = lambda col, sep: F.array_join(F.col(col).cast("array<string>"), sep)
    return packed.select("row", said("input_ids", " ").alias("ids"), said("prompt_mask", "").alias("prompt_mask"))


@query("SELECT CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS n_tokens, 0 AS n_long FROM conversations")
def pack_in_shards(spark, d):
    """Many shards: every token is in some row, and only a shard's last row is short."""
    words = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda x: F.length(x).cast("long"))
    c = table(spark, d, "conversations").select(F.xxhash64("conv_id", "turn").alias("k"), words.alias("tokens"))
    packed = packing.pack(c, 64, -1, "k", shards=32)
    last = F.max("row").over(Window.partitionBy("shard"))
    n = packed.select(F.size(F.filter("input_ids", lambda x: x != -1)).alias("n"), ((F.size("input_ids") != 64) & (F.col("row") < last)).alias("bad"))
    return n.agg(F.sum("n").cast("long").alias("n_tokens"), F.count_if("bad").cast("int").alias("n_long"))


# --- generation, rewards, execution


@query("SELECT CAST(item_id AS VARCHAR) AS idx, CAST(s AS INTEGER) AS sample_idx, CASE WHEN item_id % 4 <> 0 THEN 'print(' || CAST(s AS VARCHAR) || ' + ' || CAST(length(text) AS VARCHAR) || ')' || chr(10) END AS answer, CASE WHEN item_id % 4 = 0 THEN 'request failed' END AS error FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'refuse' ELSE text END AS text FROM benchmark), (SELECT unnest([0, 1, 2]) AS s) WHERE contains(text, 'refuse') = (item_id % 4 = 0)")
def generate_samples(spark, d):
    """Three samples for each prompt; failed requests keep their numbers and say why."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.when(F.col("item_id") % 4 == 0, "refuse").otherwise(F.col("text")).alias("prompt"))
    return generate.generate(b, n=3, batch=7).select("idx", "sample_idx", T.final_block(F.col("response")).alias("answer"), "error")


@query("SELECT CAST(item_id AS VARCHAR) AS idx, CAST(s AS INTEGER) AS sample_idx, CASE WHEN item_id % 8 <> 0 THEN 'print(0 + ' || CAST(length(text) AS VARCHAR) || ')' || chr(10) END AS answer, CASE WHEN item_id % 8 = 0 THEN 'request failed' END AS error, CASE WHEN item_id % 8 = 0 THEN 2 ELSE 1 END AS attempt FROM benchmark, (SELECT unnest([0, 1]) AS s) WHERE NOT contains(text, 'refuse')")
def generate_paced(spark, d):
    """Two samples for each prompt under a quota for the whole cluster; what fails is asked once more."""
    b = table(spark, d, "benchmark").where(~F.col("text").contains("refuse")).select(F.col("item_id").alias("idx"), F.when(F.col("item_id") % 8 == 0, "refuse").otherwise(F.col("text")).alias("prompt"))
    found = generate.generate_paced(b, generate.echo_client, n=2, quota=800, period=10.0, attempts=2, backoff=0.1)
    return found.select("idx", "sample_idx", T.final_block(F.col("response")).alias("answer"), "error", "attempt")


@query("""WITH m AS (SELECT event_type AS dataset, avg(value) AS mean, count(*) AS n FROM events GROUP BY event_type),
a AS (SELECT dataset, mean, n, NULL AS error FROM m UNION ALL SELECT 'broken', NULL, 0, 'ValueError: no such dataset')
SELECT dataset, round(mean, 6) AS mean, n, error FROM a UNION ALL SELECT NULL, round(avg(mean), 6), CAST(sum(n) AS BIGINT), NULL FROM a""")
def overlapped_evaluation(spark, d):
    """A dataset for each kind of event, evaluated side by side, one of them broken; then the macro average."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of names

    def broken():
        raise ValueError("no such dataset")

    jobs = {k: lambda k=k: e.where(F.col("event_type") == k).select(F.col("event_id").alias("key"), F.col("value").alias("reward")) for k in kinds} | {"broken": broken}
    found = evaluate.summary(spark, evaluate.evaluate(spark, jobs))
    return found.withColumn("mean", F.round("mean", 6))


@query("SELECT conv_id, turn, CAST(length(text) % 2 AS DOUBLE) AS odd, CAST(turn AS DOUBLE) / 2 AS half FROM conversations WHERE text IS NOT NULL")
def reward_functions(spark, d):
    """Two batch rewards behind one adapter, named by their functions."""

    def odd(items):
        return [len(c) % 2 for c, _ in items]

    def half(items):
        return [row["turn"] / 2 for _, row in items]

    c = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    r = generate.rewarded(c, [odd, half], "text")
    return r.select("conv_id", "turn", F.col("rewards")["odd"].alias("odd"), F.col("rewards")["half"].alias("half"))


#: What a benchmark item does to its worker, by its number modulo 20; all others succeed.
_ACTS = {1: "wrong", 2: "error", 3: "slow", 4: "none", 5: "whole", 6: "flood", 7: "exit", 8: "garbage", 9: "input"}
_SAYS = {"wrong": "fail:wrong-output", "error": "fail:error", "slow": "fail:timeout", "none": "fail:run-failed", "whole": "fail:timeout", "exit": "fail:nonzero-exit", "garbage": "fail:run-failed", "input": "fail:input-timeout"}


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, CASE item_id % 20 " + " ".join(f"WHEN {k} THEN '{_SAYS[v]}'" for k, v in _ACTS.items() if v in _SAYS) + " ELSE 'success' END AS status FROM benchmark")
def worker_statuses(spark, d):
    """Long-lived and one-shot workers with every status; `whole` has fast tests but too many for its item's time."""
    import sys

    act = F.col("item_id") % 20
    pick = lambda by, other: functools.reduce(lambda c, k: c.when(act == k, by[_ACTS[k]]), [k for k in _ACTS if _ACTS[k] in by], F).otherwise(other)
    length = F.length("text").cast("string")
    text = lambda x: F.lit(x)
    code = pick({"wrong": text("print('no')"), "error": text("raise SystemExit(3)"), "slow": text("while True: pass"), "whole": text("import time\ntime.sleep(1.5)\nprint(input())"), "flood": text("print('y' * (2 << 20))"), "input": F.repeat(text("x"), 1 << 20)}, text("print(input())"))
    one = F.array(F.struct(length.alias("input"), length.alias("output")))
    tests = pick({"none": F.slice(one, 1, 0), "whole": F.array_repeat(F.get(one, text(0)), 9), "flood": F.array(F.struct(text("").alias("input"), F.repeat(text("y"), 2 << 20).alias("output")))}, one)
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), code.alias("code"), tests.alias("test_cases"), F.lit("python").alias("lang"), pick({v: text(v) for v in _ACTS.values()}, text("")).alias("act"))
    found = harness.supervise(items.where(~F.col("act").isin("exit", "garbage", "input")), timeout=8.0, partitions=4)
    found = found.unionByName(harness.supervise(items.where("act = 'exit'"), [sys.executable, "-c", "raise SystemExit(4)"], one_shot=True))
    found = found.unionByName(harness.supervise(items.where("act = 'garbage'"), [sys.executable, "-c", "print('no json', flush=True)"]))
    found = found.unionByName(harness.supervise(items.where("act = 'input'"), [sys.executable, "-c", "import time; time.sleep(9)"], write_timeout=0.3))
    return found.select("item_id", "status")


@query("""WITH b AS (SELECT item_id, CASE item_id % 10 WHEN 0 THEN 'checked' WHEN 5 THEN 'nobody' ELSE 'plain' END AS lang FROM benchmark),
n AS (SELECT lang, CAST(ceil(count(*) * 12 / (SELECT count(*) FROM b)) AS INTEGER) AS tasks FROM b GROUP BY lang)
SELECT CAST(item_id AS VARCHAR) AS item_id, lang, CASE WHEN lang = 'nobody' THEN 'fail:exception' WHEN item_id % 7 = 0 THEN 'fail:wrong-output' ELSE 'success' END AS status, tasks FROM b JOIN n USING (lang)""")
def route_by_language(spark, d):
    """Two configured languages, which programs can tell apart, and one that nobody knows; tasks by the share of each."""
    import sys

    configs = {
        "plain": json.dumps({"prompt": "Use this.", "filename": "snippet.py", "execute": f"{sys.executable} -I snippet.py"}),
        "checked": json.dumps({"prompt": "Use that.", "filename": "main.py", "compile": f"{sys.executable} -m py_compile main.py", "execute": f"{sys.executable} -O main.py"}),
    }
    i = F.col("item_id")
    lang = F.when(i % 10 == 0, "checked").when(i % 10 == 5, "nobody").otherwise("plain")
    want = F.concat_ws(" ", F.when(lang == "checked", "False 0").otherwise("True 1"), F.when(i % 7 == 0, "no").otherwise(F.length("text").cast("string")))
    code = F.concat(F.lit("import sys\nprint(__debug__, sys.flags.isolated, "), F.length("text").cast("string"), F.lit(")"))
    items = table(spark, d, "benchmark").select(i.cast("string").alias("item_id"), code.alias("code"), F.array(F.struct(F.lit("").alias("input"), want.alias("output"))).alias("test_cases"), lang.alias("lang"))
    return pools.run_pools(items, configs, slots=12).select("item_id", "lang", "status", "tasks")


# --- files and commands


@query("SELECT kind, doc_id, quality, toxic FROM labels, (SELECT unnest(['jsonl', 'disk', 'hub', 'csv']) AS kind)")
def spec_round_trip(spark, d):
    """Labels through every kind of dataset spec, with nulls kept."""
    rows, root, found = table(spark, d, "labels").select("doc_id", "quality", "toxic"), _folder(spark), None
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for kind in ("jsonl", "disk", "hub", "csv"):
        name = f"{kind}:{root}/{kind}" + (":split=train" if kind == "hub" else "")
        spec.write_spec(rows, name)
        one = spec.read_spec(spark, name, schema + (", split string" if kind == "hub" else "")).select(F.lit(kind).alias("kind"), "doc_id", "quality", "toxic")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM labels) WHERE k >= 5 AND k < 40")
def line_range_scan(spark, d):
    """Lines 5 to 39 of JSONL files, typed, required fields there."""
    path = f"{_folder(spark)}/labels"
    table(spark, d, "labels").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.json(path)
    return spec.require_columns(spec.read_lines(spark, path, "doc_id long, quality int", 5, 40), ["doc_id"]).select("doc_id")


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS line, doc_id FROM labels")
def numbered_lines(spark, d):
    """Every line of a table's files with its number, from byte ranges."""
    path = f"{_folder(spark)}/labels"
    table(spark, d, "labels").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.json(path)
    return spec.numbered_lines(spark, path).select("line", F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))


@query("SELECT event_id, user_id AS key, max(value) OVER w AS running_max, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS BIGINT) AS lap_us, row_number() OVER w AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def keyed_stream(spark, d):
    """Running maxima, laps and ranks over events that arrive in four batches, the second run resumed from the first's state."""
    root = _folder(spark)
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    cut = e.agg(*[F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]).first()
    part = sum(((F.unix_micros(F.col("ts").cast("timestamp")) > q).cast("int") for q in cut), F.lit(0))
    e = curate.shared_table(e.withColumn("part", part), "events")
    for i in range(4):
        e.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/in")
        if i % 2:  # two runs of two batches each
            stream = keyed.keyed_progress(spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
            sink.stream_into(stream, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark, f"{root}/out", keyed.OUTPUT).drop("batch")


@query("SELECT item_id, text AS prompt, i AS step FROM benchmark, (SELECT unnest([1, 2]) AS i)")
def step_log(spark, d):
    """Prompts and outputs of two steps, one of them written twice and one killed while it was staged."""
    root, b = f"{_folder(spark)}/log", table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    b.write.parquet(f"{root}/{sink.STAGING}/killed")
    done = [sink.append_log(b, root, f"step-{i}", step=i) for i in (1, 2, 1)]
    assert done == [True, True, False]
    return sink.read(spark, root, "item_id long, prompt string, step int").drop("batch")


@query("SELECT CAST(event_id AS VARCHAR) AS item_id FROM events WHERE event_type <> 'click'")
def resume_from_file(spark, d):
    """Items that an earlier run's file does not have."""
    path = f"{_folder(spark)}/results"
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("item_id"), "event_type")
    e.where("event_type = 'click'").select("item_id", F.lit("success").alias("status")).write.json(path)
    return results.not_yet_done(e.select("item_id"), spec.finished_ids(spark, path))


@query("SELECT status, printf('%.2f%%', 100.0 * avg(CASE WHEN t = 'purchase' THEN 1 ELSE 0 END)) AS rate FROM (SELECT event_type AS t, 'file' || CAST(user_id % 3 AS VARCHAR) AS status FROM events) GROUP BY status")
def pass1_by_file(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("file"), (F.col("user_id") % 3).cast("string")).alias("file"), F.when(F.col("event_type") == "purchase", "success").otherwise("fail:error").alias("status"))
    return spec.success_report(e).select(F.col("file").alias("status"), F.col("success-rate").alias("rate"))


@query("""WITH h AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT 'scalar' AS kind, l_linenumber AS step, 'quantity' AS name, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS value FROM lineitem GROUP BY l_linenumber
UNION ALL SELECT 'histogram', 1, 'bin ' || CAST(least(9, CAST(floor((l_quantity - lo) / ((hi - lo) / 10)) AS INTEGER)) AS VARCHAR), count(*) FROM lineitem, h GROUP BY ALL
UNION ALL SELECT 'text', 2, 'item ' || CAST(item_id AS VARCHAR), length(text) FROM benchmark
UNION ALL SELECT 'graph', 2, n_regionkey || '>' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'table', 3, 'samples/0/b', 3
UNION ALL SELECT 'image', 3, 'dot.png', 4""")
def metrics_sink(spark, d):
    """Every kind of metric, from whole tables; a step that is logged again changes nothing."""
    log, lines = metrics.Metrics(spark, f"{_folder(spark)}/metrics"), table(spark, d, "lineitem")
    for r in lines.groupBy("l_linenumber").agg(F.avg(F.col("l_quantity").cast("double")).alias("mean")).collect():  # seven rows
        log.scalars(r.l_linenumber, {"quantity": r["mean"]})
    assert not log.scalars(1, {"quantity": -1.0})
    log.histogram(1, "quantity", lines, "l_quantity", 10)
    log.texts(2, "items", table(spark, d, "benchmark").select(F.format_string("item %d", "item_id").alias("name"), "text"))
    log.graph(2, "nations", table(spark, d, "nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target")))
    log.table(3, "samples", [["a", "b"], ["x", 3]])
    log.image(3, "dot.png", b"\x89PNG")
    row = lambda kind, df, name, value: df.select(F.lit(kind).alias("kind"), "step", name.alias("name"), F.round(value.cast("double"), 6).alias("value"))
    col = F.col
    parts = [
        row("scalar", log.read("scalars"), col("name"), col("value")), row("histogram", log.read("histograms").where("n > 0"), F.concat(F.lit("bin "), col("bin").cast("string")), col("n")),
        row("text", log.read("texts"), col("name"), F.length("text")), row("graph", log.read("graphs"), F.concat_ws(">", "source", "target"), col("n")),
        row("table", log.read("tables").where("header = 'b'"), F.concat_ws("/", "name", "row", "header"), col("value")), row("image", log.read("images"), col("name"), F.octet_length("image")),
    ]
    return functools.reduce(lambda x, y: x.unionByName(y), parts)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark, d):
    """A bounded table as one document, read back."""
    path, rows = f"{_folder(spark)}/nations.json", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    spec.write_document(spark, path, [r.asDict() for r in rows.collect()])
    return spec.read_json_document(spark, path, rows.schema).select(rows.columns)


@query("SELECT split, doc_id, toxic FROM (SELECT doc_id, toxic, CASE WHEN quality = 1 THEN 'good' ELSE 'other' END AS split FROM labels)")
def named_splits(spark, d):
    """Each split of a published dataset on its own, projected."""
    path = f"{_folder(spark)}/splits"
    spec.write_split(table(spark, d, "labels").withColumn("split", F.when(F.col("quality") == 1, "good").otherwise("other")), path)
    parts = [spec.read_split(spark, path, s, ["doc_id", "toxic"]).withColumn("split", F.lit(s)) for s in ("good", "other")]
    return parts[0].unionByName(parts[1])


@query("SELECT item_id, md5(text || chr(10)) AS code FROM benchmark")
def directory_of_scripts(spark, d):
    """Every item as a script in a folder of its own; ids are paths."""
    path = f"{_folder(spark)}/scripts"
    table(spark, d, "benchmark").select("text", "item_id").repartition(F.col("item_id")).write.partitionBy("item_id").text(path)
    return spec.read_scripts(spark, path).select(F.regexp_extract("item_id", r"^item_id=(\d+)/part-", 1).cast("long").alias("item_id"), F.md5("code").alias("code"))


@query("SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS line, idx FROM (SELECT doc_id AS idx FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100)")
def sample_order(spark, d):
    """A sample of 100 rows, sorted by id: the lines of its file in their order."""
    path = f"{_folder(spark)}/sample"
    drawn = curate.sample_k(table(spark, d, "documents").select(F.col("doc_id").alias("idx")), "idx", 100)
    commands._out(drawn.orderBy("idx"), path, False)
    return spec.numbered_lines(spark, f"{path}/result").select("line", F.get_json_object("value", "$.idx").cast("long").alias("idx"))


def _problems(spark, d):
    """Benchmark items whose right answer, by the client of the tests, is the length of their prompt."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("idx"), F.col("text").alias("problem_statement"))


@query("SELECT 'verify' AS step, CAST(item_id AS VARCHAR) || '/' || CAST(s AS VARCHAR) AS item_id, CASE WHEN item_id % 5 = 0 THEN 'fail:no-tests' WHEN s = 0 THEN 'success' ELSE 'fail:wrong-output' END AS status FROM benchmark, (SELECT unnest([0, 1]) AS s) UNION ALL SELECT 'describe', 'rate', printf('%.2f%%', 50.0 * avg(CASE WHEN item_id % 5 = 0 THEN 0 ELSE 1 END)) FROM benchmark")
def commands_verify_from_generate(spark, d):
    """Prompts, generation, extraction, execution and the report, each step reading the files of the one before."""
    root, p = _folder(spark), _problems(spark, d)
    commands._out(p.select("idx", F.col("problem_statement").alias("prompt")), f"{root}/prompts", False)
    commands.generate_responses(spark, f"{root}/prompts", f"{root}/responses", n=2)
    right = F.array(F.struct(F.lit("").alias("input"), F.length("problem_statement").cast("string").alias("output")))
    tests = p.select("idx", F.when(F.col("idx").cast("long") % 5 != 0, right).alias("test_cases"))
    found = commands.verify_from_generate(spark, f"{root}/responses", tests, f"{root}/out", "python")
    rate = commands.describe_verify_results(spark, [f"{root}/out/verify"]).select(F.lit("describe").alias("step"), F.lit("rate").alias("item_id"), F.col("success-rate").alias("status"))
    return found.select(F.lit("verify").alias("step"), "item_id", "status").unionByName(rate)


@query(f"""WITH {_RAW}, s AS (SELECT idx, doc_id, text, n FROM r WHERE doc_id % 7 <> 0 AND n > 0), w AS (SELECT idx FROM s JOIN labels USING (doc_id) WHERE quality = 1 AND n >= 2),
t AS (SELECT idx FROM w ORDER BY md5('42:' || CAST(idx AS VARCHAR)), idx LIMIT 10), v AS (SELECT idx FROM w WHERE idx NOT IN (SELECT idx FROM t) ORDER BY md5('42:' || CAST(idx AS VARCHAR)), idx LIMIT 10),
x AS (SELECT idx FROM s JOIN labels USING (doc_id) WHERE quality = 1 AND idx NOT IN (SELECT idx FROM t) AND idx NOT IN (SELECT idx FROM v))
SELECT 'validation' AS split, CAST(idx AS BIGINT) AS idx FROM t UNION ALL SELECT 'train', CAST(idx AS BIGINT) FROM v UNION ALL SELECT 'xl', CAST(idx AS BIGINT) FROM x""")
def commands_splits(spark, d):
    """Raw problems and checker texts to published splits, by the commands and their files."""
    root, raw = _folder(spark), _raw(spark, d)
    raw.withColumn("id", F.format_string("%012d", "doc_id")).drop("doc_id").write.option("compression", "gzip").json(f"{root}/raw")
    said = F.concat(F.lit(f"so</think>\n\n{T.FENCE}json\n"), F.to_json(F.struct(F.when(F.col("quality") == 1, "diff").otherwise("checker").alias("type"))), F.lit(f"\n{T.FENCE}\n"))
    quality = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    quality.select(F.format_string("%012d", "doc_id").alias("id"), said.alias("generation")).write.json(f"{root}/texts")
    commands.preprocess_solutions(spark, f"jsonl:{root}/raw", f"{root}/solutions")
    commands.preprocess_checkers(spark, f"{root}/solutions", f"jsonl:{root}/texts", f"{root}/checkers")
    both = (f"{root}/solutions", f"{root}/checkers")
    commands.make_split(spark, "validation", *both, f"{root}/validation", size=10)
    commands.make_split(spark, "train", *both, f"{root}/train", [f"{root}/validation"], size=10)
    commands.make_split(spark, "xl", *both, f"{root}/xl", [f"{root}/validation", f"{root}/train"])
    return commands.publish_splits(spark, {n: f"{root}/{n}" for n in ("validation", "train", "xl")}, f"{root}/all").select("split", "idx")


@query(f"WITH {_RAW} SELECT CAST(idx AS VARCHAR) AS idx, 'Solve this programming problem.' || chr(10) || chr(10) || text || chr(10) || chr(10) || CASE WHEN n > 1 THEN 'Example 1' || chr(10) || 'Input:' || chr(10) || string_split(text, chr(10))[CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END] ELSE '' END AS head FROM r WHERE doc_id % 7 <> 0 AND n > 1 ORDER BY r.idx LIMIT 30 OFFSET 5")
def commands_make_prompts(spark, d):
    root = _folder(spark)
    commands._out(curate.solutions(_raw(spark, d), ["doc_id"]), f"{root}/solutions", False)
    made = commands.make_prompts(spark, f"{root}/solutions", f"{root}/prompts", "lua", 5, 30, skip_invalid=True)
    return made.select("idx", F.substring_index("prompt", "\nOutput:\n", 1).alias("head"))


@query("SELECT CAST(row_number() OVER (ORDER BY p, item_id) - 1 AS BIGINT) AS position, CAST(item_id AS VARCHAR) AS idx, lang FROM benchmark, (VALUES (0, 'lua'), (1, 'r')) l(p, lang)")
def commands_prepare_dataset(spark, d):
    """Languages one after the other, each in the order of keyed hashes of the problems."""
    p = _problems(spark, d).withColumns({"test_cases": F.array(F.struct(F.lit("1").alias("input"), F.lit("2").alias("output"))), "lang": F.lit("x")})
    p = p.withColumn("idx", F.col("idx").cast("long"))
    return commands.prepare_dataset(spark, "seq-lua-r", p, f"{_folder(spark)}/seq").select("position", F.col("idx").cast("string").alias("idx"), "lang")


@query("SELECT CAST(item_id AS VARCHAR) || '/0' AS item_id, CASE WHEN item_id % 6 = 0 THEN 'fail:no-answer' WHEN item_id % 6 = 1 THEN 'fail:no-tests' WHEN item_id % 6 = 2 THEN 'fail:wrong-output' WHEN item_id % 6 = 3 THEN 'fail:error' ELSE 'success' END AS status FROM benchmark")
def commands_verify_configured(spark, d):
    """Answers in a language that only a configuration file knows: it compiles, then runs without assertions."""
    import sys

    root, i, n = _folder(spark), F.col("item_id"), F.length("text").cast("string")
    spec.write_document(spark, f"{root}/languages/terse.yaml", f"prompt: Use it.\nfilename: main.py\ncompile: {sys.executable} -m py_compile main.py\nexecute: {sys.executable} -O main.py\n")
    # an assertion that fails is only passed over by the configured way to run
    code = F.when(i % 6 == 3, "def f(:").when(i % 6 != 0, F.concat(F.lit("assert False\nprint("), n, F.when(i % 6 == 2, " + 1").otherwise(""), F.lit(")")))
    b = table(spark, d, "benchmark")
    commands._out(b.select(i.cast("string").alias("idx"), F.lit(0).alias("sample_idx"), F.lit(None).cast("string").alias("issues"), code.alias("answer")), f"{root}/answers", False)
    tests = b.select(i.cast("string").alias("idx"), F.when(i % 6 != 1, F.array(F.struct(F.lit("").alias("input"), n.alias("output")))).alias("test_cases"))
    return commands.verify_answers(spark, f"{root}/answers", tests, f"{root}/out", "terse", configs=f"{root}/languages").select("item_id", "status")


_HELD = "'Solve this programming problem.' || chr(10) || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'Write the whole program in ' || lang || ', in one fenced block.'"


@query(f"SELECT CAST(row_number() OVER (ORDER BY draw, item_id) - 1 AS BIGINT) AS position, CAST(item_id AS VARCHAR) AS idx, lang, md5({_HELD}) AS prompt FROM (SELECT *, list_extract(['lua', 'julia'], CAST(CAST('0x' || substr(draw, 1, 8) AS BIGINT) % 2 AS BIGINT) + 1) AS lang FROM (SELECT *, md5('42:' || CAST(item_id AS VARCHAR)) AS draw FROM benchmark))")
def commands_prepare_mix(spark, d):
    """One language drawn for each problem, in the order of keyed hashes, by the command and its files."""
    return _prepared(spark, d, "mix-lua-julia")


@query(f"SELECT CAST(row_number() OVER (ORDER BY draw, item_id, p) - 1 AS BIGINT) AS position, CAST(item_id AS VARCHAR) AS idx, lang, md5({_HELD}) AS prompt FROM (SELECT *, md5('42:' || CAST(item_id AS VARCHAR)) AS draw FROM benchmark), (VALUES (0, 'lua'), (1, 'julia'), (2, 'r')) l(p, lang)")
def commands_prepare_fullmix(spark, d):
    """Every problem in every language."""
    return _prepared(spark, d, "fullmix-lua-julia-r")


def _prepared(spark, d, name):
    p = _problems(spark, d).withColumns({"test_cases": F.array(F.struct(F.lit("1").alias("input"), F.lit("2").alias("output"))), "idx": F.col("idx").cast("long")})
    return commands.prepare_dataset(spark, name, p, f"{_folder(spark)}/{name}").select("position", F.col("idx").cast("string").alias("idx"), "lang", F.md5("prompt").alias("prompt"))


@query("SELECT CAST(item_id AS VARCHAR) AS idx, 'Question:' || chr(10) || text || chr(10) || 'Answer in C++ 17.' AS prompt FROM benchmark")
def commands_benchmark_prompts(spark, d):
    """A benchmark's table to prompts, by its spec."""
    root = _folder(spark)
    spec.write_spec(table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question_content")), f"disk:{root}/bench")
    return commands.write_benchmark_prompts(spark, f"disk:{root}/bench", f"{root}/prompts", "cpp").select("idx", "prompt")


@query("WITH c AS (SELECT event_type AS model, sum(CAST(event_id AS DECIMAL(20,0)) * 15 + CAST(user_id AS DECIMAL(20,0)) * 60) AS e8 FROM events GROUP BY event_type) SELECT model, CAST(e8 AS BIGINT) AS e8, round(CAST(e8 AS DOUBLE) / 100000000, 4) AS cost FROM c")
def commands_llm_cost(spark, d):
    """A model for each kind of event; exact dollars."""
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    prices = calls.select("model").distinct().withColumns({"price_in": F.lit("0.15"), "price_out": F.lit("0.60")})
    found = commands.llm_cost(spark, calls, prices)
    return found.select("model", (F.col("dollars") * 100000000).cast("long").alias("e8"), F.round(F.substring("cost", 2, 40).cast("double"), 4).alias("cost"))


@query("SELECT CAST(conv_id AS VARCHAR) AS idx, CAST(turn AS INTEGER) AS sample_idx, 'y = ' || CAST(length(coalesce(text, '')) AS VARCHAR) || chr(10) AS answer, ['import os' || chr(10) || 'n = ' || CAST(turn AS VARCHAR)] AS blocks FROM conversations")
def commands_find_code(spark, d):
    """Responses as files to code in the thinking and final blocks as files."""
    root = _folder(spark)
    n, k = F.col("turn").cast("string"), F.length(F.coalesce("text", F.lit(""))).cast("string")
    said = F.concat(F.lit("<think>\nsome words that are no code at all\n\nimport os\nn = "), n, F.lit("\n\nmore words of prose here\n</think>\n```py\ny = "), k, F.lit("\n```\n"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("idx"), F.col("turn").cast("int").alias("sample_idx"), F.lit("p").alias("prompt"), said.alias("response"), F.lit(None).cast("string").alias("error"))
    commands._out(rows, f"{root}/responses", False)
    return commands.find_code(spark, f"{root}/responses", f"{root}/code").select("idx", "sample_idx", "answer", "blocks")


@query("SELECT CASE item_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'fail-wrong-output' ELSE 'fail-error' END AS \"case\", 'python' AS lang, CASE item_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'fail:wrong-output' ELSE 'fail:error' END AS status, CAST(3 * count(*) AS INTEGER) AS n, true AS ok FROM benchmark GROUP BY ALL")
def commands_test_executors(spark, d):
    """Conformance: a program for every benchmark item, three times to the same worker."""
    kind = F.col("item_id") % 3
    case = F.when(kind == 0, "success").when(kind == 1, "fail-wrong-output").otherwise("fail-error")
    code = F.when(kind == 2, F.concat(F.lit("raise ValueError("), F.col("item_id").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("print(len(input()) + "), F.col("item_id").cast("string"), F.lit(")")))
    word = F.substring("text", 1, 9)
    word = F.regexp_replace(word, r"[\r\n]", "_")
    right = F.length(word) + F.col("item_id") + F.when(kind == 1, 1).otherwise(0)
    cases = table(spark, d, "benchmark").select(case.alias("case"), code.alias("code"), F.array(F.struct(word.alias("input"), right.cast("string").alias("output"))).alias("test_cases"), F.lit("python").alias("lang"), F.lit(20).alias("timeout_s"))
    return commands.test_executors(spark, cases).groupBy("case", "lang", "status", "ok").agg(F.count("*").cast("int").alias("n"))
