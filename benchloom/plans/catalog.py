"""Every registered query of the library itself, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchloom.functions import arrays as A
from benchloom.functions import prompts as P
from benchloom.functions import settings as S
from benchloom.functions import text as T
from benchloom.operators import curate, packing, results, runner
from benchloom.plans.views import table, view, with_views
from benchloom.schemas import RESULT
from benchloom.sources import sink, spec

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LANGS = ["lua", "julia", "r", "ocaml", "fortran"]
BT = "repeat('`', 3)"


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = with_views(oracle)
        return f

    return add


def _diff(spark, d):
    c = view(spark, d, "v_checkers")
    said = T.final_block(T.after_thinking(F.col("generation")))
    return c.select("id", "doc_id", F.get_json_object(said, "$.type").alias("type"))


# --- curation


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, source_id, title, n_examples FROM v_problems QUALIFY n_examples >= 2")
def preprocess_solutions(spark, d):
    """Ordinals before the filter, then at least two examples."""
    p = curate.with_ordinal(view(spark, d, "v_problems").drop("idx").select("doc_id", "source_id", "title", "n_examples"), ["doc_id"])
    return p.where("n_examples >= 2").select("idx", "source_id", "title", "n_examples")


@query("SELECT 'src-' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'diff' ELSE 'checker' END AS type FROM labels")
def parse_checkers(spark, d):
    return _diff(spark, d).select("id", "type")


@query("SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def checker_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def lookup_last_wins(spark, d):
    return curate.last_wins(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


_POOL = "p AS (SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1))"
_TEST = "t AS (SELECT doc_id FROM p WHERE doc_id IN (0, 1, 2, 4, 6) UNION ALL (SELECT doc_id FROM p WHERE doc_id NOT IN (0, 1, 2, 4, 6) ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 20))"
_VAL = "v AS (SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM t) ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 30)"
_TRAIN = "n AS (SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM v) ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50)"


def _pool(spark, d):
    return table(spark, d, "documents").select("doc_id"), _diff(spark, d).where("type = 'diff'")


@query(f"WITH {_POOL}, {_TEST} SELECT doc_id FROM t")
def split_test(spark, d):
    docs, wanted = _pool(spark, d)
    return curate.split(docs, "doc_id", 20, wanted, forced=[0, 1, 2, 4, 6])


def _test(spark, d):
    """The test split as a table, so that the later ones don't plan it again."""
    return curate.shared_table(split_test(spark, d), "split-test")


@query(f"WITH {_POOL}, {_TEST}, {_VAL} SELECT doc_id FROM v")
def split_validation(spark, d):
    docs, wanted = _pool(spark, d)
    return curate.split(docs, "doc_id", 30, wanted, [_test(spark, d)])


@query(f"WITH {_POOL}, {_TEST}, {_VAL}, {_TRAIN} SELECT doc_id FROM n")
def split_train(spark, d):
    docs, wanted = _pool(spark, d)
    test = _test(spark, d)
    return curate.split(docs, "doc_id", 50, wanted, [test, curate.split(docs, "doc_id", 30, wanted, [test])])


@query(f"WITH {_POOL}, {_TEST}, {_VAL} SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM v)")
def split_xl(spark, d):
    docs, wanted = _pool(spark, d)
    rows = docs.join(wanted, "doc_id", "left_semi")
    test = _test(spark, d)
    for taken in (test, curate.split(docs, "doc_id", 30, wanted, [test])):
        rows = rows.join(taken, "doc_id", "left_anti")
    return rows


@query("SELECT doc_id, CASE WHEN doc_id BETWEEN 601 AND 974 OR doc_id BETWEEN 1 AND 10 THEN 'train' ELSE 'test' END AS split FROM documents WHERE doc_id BETWEEN 601 AND 974 OR doc_id BETWEEN 1 AND 510")
def id_range_split(spark, d):
    train = F.col("doc_id").between(601, 974) | F.col("doc_id").between(1, 10)
    return table(spark, d, "documents").where(train | F.col("doc_id").between(11, 510)).select("doc_id", F.when(train, "train").otherwise("test").alias("split"))


@query("SELECT idx, CAST(part_ord AS INTEGER) AS part_ord, l.lang AS lang FROM v_problems, (VALUES (0, 'lua'), (1, 'julia'), (2, 'r'), (3, 'ocaml'), (4, 'fortran')) l(part_ord, lang)")
def fullmix_datasets(spark, d):
    return curate.language_fan_out(view(spark, d, "v_problems").select("idx", "lang"), LANGS)


@query("SELECT doc_id, list_extract(['lua', 'julia', 'r', 'ocaml', 'fortran'], CAST(CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS BIGINT) + 1) AS lang FROM documents")
def mix_language_assign(spark, d):
    return curate.assign_language(table(spark, d, "documents").select("doc_id"), "doc_id", LANGS)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def range_slice(spark, d):
    return curate.range_slice(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def spec_limit(spark, d):
    """The first rows of all orders as files, by a spec's limit: only the first byte ranges are planned and read."""
    import uuid

    name = f"jsonl:{curate.shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    spec.write_spec(table(spark, d, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"), name)
    return spec.load(spark, f"{name}:limit=25", "o_orderkey long", bytes="65536")


@query("SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) AS n FROM documents")
def uniqueness_check(spark, d):
    return table(spark, d, "documents").agg((F.count("*") == F.countDistinct("doc_id")).alias("unique_ids"), F.count("*").alias("n"))


@query("SELECT lang FROM (SELECT DISTINCT lang FROM documents) EXCEPT SELECT 'en'")
def language_set_difference(spark, d):
    return table(spark, d, "documents").select("lang").exceptAll(spark.createDataFrame([("en",)], "lang string")).distinct().where("lang <> 'en'")


# --- prompts


def _examples():
    return F.transform(F.split("problem_statement", "\n"), lambda x: F.struct(x.alias("input"), F.length(x).cast("string").alias("output")))


_EX = "list_transform(string_split(problem_statement, chr(10)), lambda x: {'input': x, 'output': CAST(length(x) AS VARCHAR)})"
_T = {k: v.replace("'", "''").replace("\n", "' || chr(10) || '") for k, v in P.TEMPLATES.items()}


def _sql_prompt(alt=""):
    e = _T[f"{alt}example"]
    for part in ("CAST(i AS VARCHAR)", "ex[i].input", "ex[i].output"):
        e = e.replace("%d" if part.startswith("CAST") else "%s", f"' || {part} || '", 1)
    shown = f"array_to_string(list_transform(generate_series(1, len(ex) - 1), lambda i: '{e}'), chr(10))"
    suffix = _T["suffix"].replace("%s", "' || lang || '")
    return f"'{_T[f'{alt}head']}' || problem_statement || '{_T[f'{alt}input']}' || title || '{_T['examples']}' || {shown} || '{suffix}'"


_SHOWN = _sql_prompt().split(f"'{_T['examples']}' || ")[1].split(" || '" + _T["suffix"].split("%s")[0])[0]
_RAW_FORM = f"""md5(problem_statement || chr(10) || title || chr(10) || CASE WHEN u3 < 0.5 THEN chr(10) || {_SHOWN} ELSE '' END || '{_T["suffix"].replace("%s", "' || lang || '")}')"""


@query(f"SELECT idx, {_sql_prompt()} AS prompt FROM (SELECT *, {_EX} AS ex FROM v_problems)")
def build_prompt(spark, d):
    p = view(spark, d, "v_problems").withColumn("ex", _examples())
    none = F.lit("")
    return p.select("idx", P.build_prompt(F.col("problem_statement"), F.col("title"), none, F.col("ex"), none, F.col("lang")).alias("prompt"))


@query(f"""WITH u AS (SELECT *, {_EX} AS ex, CAST(CAST('0x' || substr(md5('42:' || CAST(idx AS VARCHAR) || ':1'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u1, CAST(CAST('0x' || substr(md5('42:' || CAST(idx AS VARCHAR) || ':2'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u2, CAST(CAST('0x' || substr(md5('42:' || CAST(idx AS VARCHAR) || ':3'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u3 FROM v_problems)
SELECT idx, CASE WHEN len(ex) <= 1 THEN {_RAW_FORM} WHEN u1 < 0.3 THEN md5({_sql_prompt()}) WHEN u2 < 0.5 THEN md5({_sql_prompt('alt_')}) ELSE {_RAW_FORM} END AS variant FROM u""")
def build_variant_prompt(spark, d):
    """Every form is compared as a whole by its MD5."""
    p = view(spark, d, "v_problems").withColumn("ex", _examples())
    none = F.lit("")
    said = P.build_variant_prompt(F.col("problem_statement"), F.col("title"), none, F.col("ex"), none, F.col("lang"), F.col("idx"))
    return p.select("idx", F.md5(said).alias("variant"))


@query("SELECT item_id, 'Question:' || chr(10) || text || chr(10) || 'Answer in ' || 'lua' || '.' AS prompt FROM benchmark")
def benchmark_prompt(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.format_string("Question:\n%s\nAnswer in %s.", "text", F.lit("lua")).alias("prompt"))


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN to_json([{'role': 'user', 'content': text}]) ELSE to_json([{'role': 'system', 'content': 'Be brief.'}, {'role': 'user', 'content': text}, {'role': 'assistant', 'content': text}]) END AS messages FROM conversations WHERE text <> ''")
def chat_messages(spark, d):
    c = table(spark, d, "conversations").where("text <> ''")
    later = F.col("turn") > 0
    said = P.chat_messages(F.when(later, "Be brief.").otherwise(""), F.col("text"), F.when(later, F.col("text")))
    return c.select("conv_id", "turn", F.to_json(said).alias("messages"))


@query("SELECT CAST(idx AS VARCHAR) || '/' || CAST(sample_idx AS VARCHAR) AS item_id, length(response) AS n FROM v_responses")
def explode_samples(spark, d):
    grouped = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn"))).alias("outputs"))
    ids = grouped.select("conv_id", F.posexplode("outputs").alias("sample_idx", "o")).select(T.item_id(F.col("conv_id"), F.col("sample_idx")).alias("item_id"))
    sized = view(spark, d, "v_responses").select(T.item_id(F.col("idx"), F.col("sample_idx")).alias("item_id"), F.length("response").cast("long").alias("n"))
    return ids.join(sized, "item_id")


# --- responses and answers

_FINAL = f"""
b AS (SELECT *, regexp_extract_all(response, '(?m)^```[^\\n]*\\n+((?s:.*?))^```(?:$|\\n+)', 1)[-1] AS lastb,
             regexp_replace(response, '(?m)^```[^\\n]*\\n+((?s:.*?))^```(?:$|\\n+)', chr(1), 'g') AS rest FROM v_responses),
c AS (SELECT *, regexp_matches(rest, '(?m)^```[^\\n]*\\n') AS nopen, regexp_replace(string_split(rest, chr(1))[-1], '\\A\\n+', '') AS tail FROM b),
a AS (SELECT idx, sample_idx, text, nullif(CASE
   WHEN regexp_replace(lastb, '\\A\\s+', '') = '' AND NOT nopen THEN regexp_replace(tail, '(?s)(?m)^```(?:$|\\n).*', '')
   WHEN lastb IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(lastb, '\\A\\s+', ''), '\\A```[^\\n]*\\n+', ''), '(?s)(?m)^```(?:$|\\n).*', '')
   WHEN nopen THEN NULL
   WHEN regexp_matches(response, '\\A(?:```|import |from )') OR length(response) < 100 OR contains(response, chr(10))
     THEN regexp_replace(regexp_replace(regexp_replace(response, '\\A\\s+', ''), '\\A```[^\\n]*\\n+', ''), '(?s)(?m)^```(?:$|\\n).*', '') END, '') AS answer FROM c)"""


@query(f"WITH {_FINAL} SELECT idx, sample_idx, answer FROM a")
def extract_final_block(spark, d):
    return view(spark, d, "v_responses").select("idx", "sample_idx", T.final_block(F.col("response")).alias("answer"))


@query(f"WITH {_FINAL} SELECT CAST(idx AS VARCHAR) || '/' || CAST(sample_idx AS VARCHAR) AS item_id, CASE WHEN answer IS NULL THEN 'no-answer' ELSE '' END AS issues, length(answer) AS n FROM a")
def extract_answers(spark, d):
    a = view(spark, d, "v_responses").select(T.item_id(F.col("idx"), F.col("sample_idx")).alias("item_id"), T.final_block(F.col("response")).alias("answer"))
    return a.select("item_id", T.issues_of(F.col("answer")).alias("issues"), F.length("answer").cast("long").alias("n"))


@query("SELECT idx, sample_idx, regexp_extract(response, '(?s)```lua\\n(.*?)```', 1) AS code FROM v_responses")
def extract_first_block(spark, d):
    return view(spark, d, "v_responses").select("idx", "sample_idx", T.first_block(F.col("response"), "lua").alias("code"))


@query(f"SELECT id, {BT} || 'json' || chr(10) || '{{\"type\":\"' || CASE WHEN quality = 1 THEN 'diff' ELSE 'checker' END || '\"}}' || chr(10) || {BT} || chr(10) AS rest FROM (SELECT 'src-' || CAST(doc_id AS VARCHAR) AS id, quality FROM labels)")
def think_offset(spark, d):
    return view(spark, d, "v_checkers").select("id", T.after_thinking(F.col("generation")).alias("rest"))


@query("SELECT doc_id, regexp_replace(text || ' ' || chr(10), '\\s+\\z', '') = regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END, '\\s+\\z', '') AS same FROM documents")
def output_compare(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.same_output(F.concat(t, F.lit(" \n")), F.when(F.col("doc_id") % 2 == 0, t).otherwise(F.concat(t, F.lit("x")))).alias("same"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS same FROM documents WHERE length(text) > 0")
def output_compare_lines(spark, d):
    t = F.col("text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("\nmore"))).otherwise(F.concat(F.lit("\n \n"), F.replace(t, F.lit("\n"), F.lit(" \n\n"))))
    return table(spark, d, "documents").where(F.length(t) > 0).select("doc_id", T.same_lines(t, other).alias("same"))


@query("SELECT conv_id, turn, md5(coalesce(CASE WHEN turn % 3 = 2 THEN regexp_replace(replace(text, chr(96), ''), '^\\s+', '') ELSE replace(text, chr(96), '') END, '')) AS cleaned FROM conversations")
def clean_fences(spark, d):
    """Texts in fences, in fences that are left open, and in none."""
    plain = F.coalesce(F.replace("text", F.lit("`"), F.lit("")), F.lit(""))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  ```py\n"), plain, F.lit("\n```\nbye"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), plain)).otherwise(plain)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.regexp_replace(T.clean_fences(said), "\n$", "")).alias("cleaned"))


@query("SELECT conv_id, turn, CAST(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS reward FROM conversations")
def last_line_number_reward(spark, d):
    """Two numbers on the last line, or the wrong one, earn nothing."""
    c = table(spark, d, "conversations")
    tail = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("it is "), F.col("turn").cast("string"))).when(F.col("conv_id") % 3 == 1, "1 or 2").otherwise("-0.5")
    said = F.concat(F.translate("text", "0123456789", ""), F.lit("\n"), tail, F.lit("\n"))
    return c.select("conv_id", "turn", T.number_reward(said, F.col("turn").cast("double")).alias("reward"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang ELSE 'lua,' || lang || CASE WHEN doc_id % 4 = 3 THEN ',r' ELSE '' END END AS langs, CASE WHEN doc_id % 5 < 2 THEN CAST(doc_id % 7 + 1 AS INTEGER) END AS epochs FROM documents WHERE lang IS NOT NULL")
def dataset_name_parse(spark, d):
    """A dataset's name for every document: one language or several, with and without a number of epochs."""
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, "mix-lua-").when(i % 4 == 2, "fullmix-lua-").otherwise("seq-lua-")
    name = F.concat(kind, "lang", F.when(i % 4 == 3, "-r").otherwise(""), F.when(i % 3 == 0, "_xl").otherwise("_x"), F.when(i % 5 < 2, F.concat(F.lit("__epochs"), (i % 7 + 1).cast("string"))).otherwise(""))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.array_join(T.dataset_langs(name), ",").alias("langs"), T.dataset_epochs(name).alias("epochs"))


@query("SELECT user_id, event_id, 'lua__n' || CAST(user_id AS VARCHAR) || '_maxtoks1024_tmpr0p2' AS slug FROM events")
def path_slugs(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", T.slug(F.lit("lua"), F.col("user_id"), F.lit(1024), F.lit("0.2")).alias("slug"))


# --- joins with tests


@query("SELECT r.item_id AS item_id, l.doc_id IS NULL AS missing, l.quality AS quality FROM v_results r LEFT JOIN labels l ON r.idx = l.doc_id")
def attach_tests(spark, d):
    problems = table(spark, d, "labels").withColumnRenamed("doc_id", "idx")
    return results.attach_tests(view(spark, d, "v_results"), problems, tests="quality").select("item_id", "missing", F.col("test_cases").alias("quality"))


@query("SELECT count(*) AS n_missing FROM v_results r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.idx)")
def missing_problems(spark, d):
    problems = table(spark, d, "labels").withColumnRenamed("doc_id", "idx")
    return results.attach_tests(view(spark, d, "v_results"), problems, tests="quality").where("missing").agg(F.count("*").alias("n_missing"))


@query(f"WITH {_FINAL} SELECT CAST(idx AS VARCHAR) || '/' || CAST(sample_idx AS VARCHAR) AS item_id, 'fail:no-answer' AS status FROM a WHERE coalesce(answer, '') = ''")
def no_answer_rows(spark, d):
    a = view(spark, d, "v_responses").select(T.item_id(F.col("idx"), F.col("sample_idx")).alias("item_id"), T.final_block(F.col("response")).alias("answer"))
    return results.no_answer_rows(a)


@query("SELECT item_id FROM v_results r WHERE NOT EXISTS (SELECT 1 FROM v_results x WHERE x.item_id = r.item_id AND x.status = 'success')")
def resume_anti_join(spark, d):
    r = view(spark, d, "v_results")
    return results.not_yet_done(r.select("item_id"), r.where("status = 'success'"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def dedup_before_run(spark, d):
    return results.run_distinct(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"]).agg(F.count("*").alias("n"))


# --- scores


@query("SELECT round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 9) AS success_rate, count(*) AS n FROM v_results")
def pass1(spark, d):
    return results.success_rate(view(spark, d, "v_results"), []).select(F.round("success_rate", 9).alias("success_rate"), "n")


@query("SELECT lang, round(avg(CASE WHEN quality = 1 AND length(text) > 0 THEN 1.0 ELSE 0.0 END), 9) AS success_rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def pass1_by_lang(spark, d):
    """Fenced responses from documents; where the label is 0 the response misses the expected text."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    text = F.regexp_replace(F.col("text"), r"(?U)\A\s+", "")
    body = F.when(F.col("quality") == 1, text).otherwise(F.concat(text, F.lit(" .")))
    said = docs.select("lang", text.alias("expected"), F.concat(F.lit("so:\n```py\n"), body, F.lit("\n```\n")).alias("response"))
    return results.pass1_of_responses(said, "expected", ["lang"]).select("lang", F.round("success_rate", 9).alias("success_rate"), "n")


@query("SELECT status, count(*) AS n FROM v_results GROUP BY status")
def status_counts(spark, d):
    return view(spark, d, "v_results").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(n) AS BIGINT) AS n, printf('%.2f%%', 100.0 * sum(s) / sum(n)) AS rate FROM (SELECT count(*) AS n, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS s FROM v_results)")
def pass1_report(spark, d):
    r = view(spark, d, "v_results").agg(F.count("*").alias("n"), F.sum((F.col("status") == "success").cast("long")).alias("s"))
    return r.select("n", T.percent(F.col("s") / F.col("n")).alias("rate"))


@query("SELECT item_id, CAST(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS proper, CAST(CASE WHEN status = 'fail:wrong-output' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS partial FROM v_results")
def rewards(spark, d):
    r = view(spark, d, "v_results").select("item_id", A.rewards(F.col("status")).alias("r"))
    return r.select("item_id", F.col("r")["proper"].alias("proper"), F.col("r")["partial"].alias("partial"))


@query("SELECT reward_name, round(avg(v), 9) AS mean_reward FROM (SELECT 'proper' AS reward_name, CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END AS v FROM v_results UNION ALL SELECT 'partial', CASE WHEN status = 'fail:wrong-output' THEN 0.2 ELSE 0.0 END FROM v_results) GROUP BY reward_name")
def mean_reward_by_type(spark, d):
    r = view(spark, d, "v_results").select(F.explode(A.rewards(F.col("status"))).alias("reward_name", "v"))
    return r.groupBy("reward_name").agg(F.round(F.avg("v"), 9).alias("mean_reward"))


def _scored(spark, d):
    return view(spark, d, "v_results").withColumn("reward", F.when(F.col("status") == "success", 1.0).when(F.col("status") == "fail:wrong-output", 0.2).otherwise(0.0))


_S = "s AS (SELECT *, CASE WHEN status = 'success' THEN 1.0::DOUBLE WHEN status = 'fail:wrong-output' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM v_results)"


@query(f"WITH {_S} SELECT idx, round(sum(reward), 6) AS total FROM s GROUP BY idx")
def total_reward(spark, d):
    return _scored(spark, d).groupBy("idx").agg(F.round(F.sum("reward"), 6).alias("total"))


@query(f"WITH {_S} SELECT item_id, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4), 6) + 0.0 AS advantage FROM s WINDOW w AS (PARTITION BY idx)")
def group_advantages(spark, d):
    s = _scored(spark, d)
    return s.select("item_id", (F.round(results.advantages(s, "idx", F.col("reward")), 6) + 0.0).alias("advantage"))


@query(f"WITH {_S} SELECT item_id, CASE WHEN stddev_samp(reward) OVER w < 1e-10 THEN 0.0 ELSE round((reward - avg(reward) OVER w) / stddev_samp(reward) OVER w, 6) END + 0.0 AS advantage FROM s WINDOW w AS (PARTITION BY idx)")
def vanilla_advantages(spark, d):
    s = _scored(spark, d)
    return s.select("item_id", (F.round(results.vanilla_advantages("idx", F.col("reward")), 6) + 0.0).alias("advantage"))


@query(f"WITH {_S} SELECT sample_idx // 3 AS grp, count(*) AS n FROM s GROUP BY sample_idx // 3 HAVING max(reward) = min(reward)")
def skipped_groups(spark, d):
    """Groups of three whose advantages are all near zero, because their rewards are the same."""
    s = _scored(spark, d).withColumn("grp", F.floor(F.col("sample_idx") / 3))
    advantage = F.coalesce(results.advantages(s, "grp", F.col("reward")), F.lit(0.0))
    g = s.select("grp", advantage.alias("a")).groupBy("grp").agg(F.collect_list("a").alias("a"), F.count("*").alias("n"))
    return g.where(A.no_signal(F.col("a"))).select("grp", "n")


@query(f"WITH {_S} SELECT round(avg(m), 9) AS macro_average FROM (SELECT avg(reward) AS m FROM s GROUP BY idx)")
def macro_average(spark, d):
    return results.macro_average(_scored(spark, d), "idx", "reward").select(F.round("macro_average", 9).alias("macro_average"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM events")
def running_max_step(spark, d):
    return table(spark, d, "events").select("event_id", results.running_max("value", ["ts", "event_id"], ["user_id"]).alias("step"))


@query("SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS lap_us FROM events")
def lap_times(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", (F.col("us") - F.lag("us").over(w)).alias("lap_us"))


@query("SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 3")
def first_k_per_key(spark, d):
    return results.first_k(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "rank")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS BIGINT) AS batch FROM orders")
def micro_batches(spark, d):
    o = curate.with_ordinal(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return o.select("o_orderkey", F.floor(F.col("idx") / 32).alias("batch"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders")
def lagged_batches(spark, d):
    """The row before each one of a customer; batches that lag behind are in epoch_batches."""
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("previous"))


@query("SELECT o_orderkey, o_orderkey > 1 AND o_orderkey <> 999 AND o_orderkey % 500 = 0 AS checkpoint, o_orderkey % 10 = 0 OR o_orderkey = 1 AS evaluation FROM orders")
def schedule_steps(spark, d):
    s = F.col("o_orderkey")
    return table(spark, d, "orders").select(s, A.is_checkpoint(s, 1000, 500).alias("checkpoint"), A.is_evaluation(s, 10, True).alias("evaluation"))


# --- token arrays


def _tokens(spark, d):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(words, lambda x: F.length(x).cast("long")).alias("t"))


_TOK = "k AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: CAST(length(x) AS BIGINT)) AS t FROM conversations)"


@query(f"WITH {_TOK} SELECT conv_id, turn, least(len(t), 40) AS n_prompt, least(len(t), greatest(0, 40 - len(t))) AS n_output FROM k")
def clip_lengths(spark, d):
    p, o = A.clip_outputs(F.col("t"), F.col("t"), 40)
    return _tokens(spark, d).select("conv_id", "turn", F.size(p).cast("long").alias("n_prompt"), F.size(o).cast("long").alias("n_output"))


@query(f"WITH {_TOK} SELECT conv_id, turn, repeat('0', least(2, len(t))) || repeat('1', greatest(0, len(t) - 2)) AS mask FROM k")
def prompt_mask(spark, d):
    t = F.col("t")
    rest = F.slice(t, 3, F.greatest(F.size(t) - 2, F.lit(0)))
    return _tokens(spark, d).select("conv_id", "turn", F.array_join(A.prompt_mask(F.slice(t, 1, 2), rest).cast("array<string>"), "").alias("mask"))


@query(f"WITH {_TOK} SELECT conv_id, turn, greatest(64, len(t)) AS n, CAST(coalesce(list_sum(list_transform(t, lambda x: CASE WHEN x <> 2 THEN 1 ELSE 0 END)), 0) AS BIGINT) AS attended FROM k")
def pad_mask(spark, d):
    p = _tokens(spark, d).withColumn("p", A.padded(F.col("t"), 64, 2))
    total = F.aggregate(A.attention_mask(F.col("p"), 2), F.lit(0).cast("long"), lambda s, x: s + x)
    return p.select("conv_id", "turn", F.size("p").cast("long").alias("n"), total.alias("attended"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: exp(-CAST(x AS DOUBLE)) + CAST(x AS DOUBLE) - 1)), 6) AS kl FROM embeddings")
def kl_and_clip(spark, d):
    e = table(spark, d, "embeddings").withColumn("new", F.col("embedding").cast("array<double>"))
    zero = F.transform("new", lambda x: x * 0)
    return e.select("vec_id", F.round(A.masked_mean(A.kl_estimate(zero, F.col("new")), F.transform("new", lambda x: F.lit(1))), 6).alias("kl"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(exp(CAST(x AS DOUBLE)) * 0.5, least(greatest(exp(CAST(x AS DOUBLE)), 0.9), 1.1) * 0.5))), 6) AS objective FROM embeddings")
def clipped_objective(spark, d):
    e = table(spark, d, "embeddings").withColumn("new", F.col("embedding").cast("array<double>"))
    zero = F.transform("new", lambda x: x * 0)
    return e.select("vec_id", F.round(F.aggregate(A.clipped_objective(F.col("new"), zero, F.lit(0.5), 0.1), F.lit(0.0), lambda s, x: s + x), 6).alias("objective"))


@query("""WITH RECURSIVE i AS (SELECT row_number() OVER (ORDER BY conv_id) AS k, n FROM (SELECT conv_id, CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS n FROM conversations GROUP BY conv_id)),
f AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total UNION ALL SELECT f.k + 1, f.total + CASE WHEN f.k > 0 AND f.total % 256 <> 0 THEN 1 ELSE 0 END + i.n FROM f JOIN i ON i.k = f.k + 1),
t AS (SELECT max(total) AS total FROM f)
SELECT r AS row, least(256, total - r * 256) AS n FROM (SELECT unnest(generate_series(0, (total + 255) // 256 - 1)) AS r, total FROM t)""")
def pack_sequences(spark, d):
    conv = _tokens(spark, d).groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"])).alias("tokens"))
    return packing.pack(conv, 256, 0, "conv_id").select("row", F.size("input_ids").cast("long").alias("n"))


# --- money, parameter groups


@query("SELECT user_id, CAST(sum(CAST(event_id AS DECIMAL(20,0)) * 15 + CAST(user_id AS DECIMAL(20,0)) * 60) AS BIGINT) AS cost_e8 FROM events GROUP BY user_id")
def llm_cost(spark, d):
    calls = table(spark, d, "events").select("user_id", F.lit("small").alias("model"), F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    prices = spark.createDataFrame([("small", "0.15", "0.60")], "model string, price_in string, price_out string")
    # in hundred-millionths of a dollar, so that exact sums can be compared
    return results.token_cost(calls, prices).groupBy("user_id").agg((F.sum("cost") * 100000000).cast("long").alias("cost_e8"))


@query("SELECT l_orderkey, l_linenumber, '$' || rtrim(rtrim(printf('%.6f', round(CAST(l_extendedprice AS DOUBLE) / 16, 6)), '0'), '.') AS m FROM lineitem")
def money_format(spark, d):
    """A 16th of every line's price: at most six digits, none that say nothing."""
    part = F.round(F.col("l_extendedprice").cast("double") / 16, 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.money(part.cast("decimal(20,7)")).alias("m"))


_ARCHITECTURES = [*S.UNDECAYED, "OtherForCausalLM"]
_PARAMETERS = ["layers.0.mlp.bias", "layers.0.input_layernorm.weight", "norm.weight", "h.3.ln_1.weight", "layers.1.mlp.weight", "q_norm.scale", "ln_f.bias"]


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {S.UNDECAYED.get(n) and repr(S.UNDECAYED[n]) or 'NULL'})" for i, n in enumerate(_ARCHITECTURES)) + ") t(i, architecture, part)), n AS (SELECT p_partkey, " + repr(_PARAMETERS) + "[1 + CAST(p_partkey % 7 AS INTEGER)] || '.' || split_part(p_name, ' ', 1) AS name FROM part) SELECT p_partkey, architecture, CASE WHEN part IS NULL THEN NULL WHEN contains(name, 'bias') OR contains(name, part) AND contains(name, 'weight') THEN 'no_decay' ELSE 'decay' END AS grp FROM n JOIN r ON i = p_partkey % 9")
def parameter_groups(spark, d):
    """Parameters of every known architecture and of one that is not."""
    k = F.col("p_partkey")
    names, kinds = F.array(*map(F.lit, _PARAMETERS)), F.array(*map(F.lit, _ARCHITECTURES))
    name = F.concat_ws(".", F.get(names, (k % 7).cast("int")), F.split("p_name", " ")[0])
    p = table(spark, d, "part").select(k, F.get(kinds, (k % 9).cast("int")).alias("architecture"), name.alias("name"))
    return p.select("p_partkey", "architecture", S.decay_group(F.col("architecture"), F.col("name")).alias("grp"))


# --- running programs


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, CASE item_id % 40 WHEN 1 THEN 'fail:wrong-output' WHEN 2 THEN 'fail:error' WHEN 3 THEN 'fail:timeout' WHEN 4 THEN 'fail:no-answer' WHEN 5 THEN 'fail:no-tests' ELSE 'success' END AS status FROM benchmark")
def verify_python_sandbox(spark, d):
    """Every benchmark item as a program of its own; one in forty for each way to fail."""
    act, n = F.col("item_id") % 40, F.length("text").cast("string")
    code = F.when(act == 2, "raise SystemExit(3)").when(act == 3, "while True: pass").when(act == 4, "").otherwise("print(input())")
    right = F.struct(n.alias("input"), F.when(act == 1, "no").otherwise(n).alias("output"))
    tests = F.array(right, F.struct(F.lit("101\n").alias("input"), F.lit("101").alias("output")))
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), code.alias("code"), F.when(act == 5, F.slice(tests, 1, 0)).otherwise(tests).alias("test_cases"), F.lit("python").alias("lang"))
    return runner.run_items(items, timeout=4.0).select("item_id", "status")


@query("SELECT CAST(item_id AS VARCHAR) || '/0' AS item_id, CASE WHEN item_id % 2 = 0 THEN 'success' ELSE 'fail:wrong-output' END AS status FROM benchmark")
def stream_verify(spark, d):
    """The same rows by the streaming way: responses as files, picked up once."""
    import uuid

    from benchloom.streaming import verify

    root = f"{curate.shared_dir(spark)}/verify-{uuid.uuid4().hex}"
    b = table(spark, d, "benchmark")
    said = F.concat(F.lit("```py\nprint("), F.col("item_id").cast("string"), F.lit(")\n```"))
    tests = F.array(F.struct(F.lit("").alias("input"), F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).otherwise("no").alias("output")))
    b.select(F.col("item_id").cast("string").alias("idx"), F.lit(0).alias("sample_idx"), said.alias("response"), F.lit("python").alias("lang"), tests.alias("test_cases")).write.json(f"{root}/in")
    for _ in range(2):  # the second call finds nothing new
        verify.verify_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    return sink.read(spark, f"{root}/out", RESULT).select("item_id", "status")


from benchloom.plans import extra  # noqa: E402, F401  registers its queries, and reads this module
