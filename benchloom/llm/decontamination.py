"""Operator 10, benchmark decontamination by winnowing; DataFrame functions only.

Texts become word grams of GRAM words; of every WINDOW - GRAM + 1 consecutive grams, those of one
window of WINDOW words, the smallest hash is the window's fingerprint. A text keeps its distinct
fingerprints, about two for seven words. Equal windows have equal fingerprints, so every shared span
of WINDOW words is found: fingerprints of both sides are joined, the windows behind a hit are compared
word by word, and touching windows extend each other to the whole shared span. Benchmark items that
are shorter than a window are one window of all their words; their lengths, if there are any, are
looked up at every word in the same pass.

A first pass joins the distinct fingerprints, without words, with the benchmark's; the documents that have
some are cut into words again, each once, and give only the windows behind their hits. The benchmark's
windows and the suspects are broadcast only if their bytes are counted and few; else they are shuffled.

Defined cases: null texts and texts without words have no hits; empty items take no part; equal items
are all listed; items with a null id count as null items and are left out of the list; repeated rows
and ids are judged row by row; with an empty benchmark all documents are clean; columns of the input that
are named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
GRAM = 5
#: Bytes of benchmark windows, words and items' ids, that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Wanted fingerprints of a text that are searched at each of its places.
SEARCHED = 64
#: Numbers in the lists of suspects that may be broadcast.
SUSPECT_NUMBERS = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; only words with other characters take the slower way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, upper, lower)))


def _windows(df: DataFrame, words: str, window: int, gram: int) -> DataFrame:
    """Adds `mins`: the fingerprint of each window of df's word arrays, empty for shorter texts."""
    n = F.size(words)
    hashes = df.withColumn("__grams", F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (gram - 1)), lambda i: F.xxhash64(F.slice(words, i, gram)))).otherwise(F.array().cast("array<bigint>")))
    g = F.col("__grams")
    k = window - gram + 1
    least = F.transform(F.sequence(F.lit(0), F.size(g) - k), lambda i: F.least(*[F.get(g, i + j) for j in range(k)]))
    return hashes.withColumn("mins", F.when(F.size(g) >= k, least).otherwise(F.array().cast("array<bigint>"))).drop("__grams")


KEYS = ["h1", "h2"]


def text_keys(text: str) -> list[Column]:
    return [F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2")]


def judged(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h1, h2, n_words, n_hit, items) for each different text of docs."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = C.written(items, "benchmark-words")  # else each window would split its item's text anew
    n = F.size("words")
    # written before they are exploded: Spark would filter by the size of `mins`, and make all grams anew for each window
    placed = F.transform("mins", lambda m, i: F.struct(m.alias("fp"), F.slice("words", i + 1, window).alias("window")))
    placed = C.written(_windows(items.where(n >= window), "words", window, gram).select("item", placed.alias("placed")), "benchmark-places")
    long_ = placed.select("item", F.explode("placed").alias("x")).select("x.*", "item")
    short = items.where(n < window).select(F.xxhash64("words").alias("fp"), F.col("words").alias("window"), "item")
    parts = C.written(long_.unionByName(short).groupBy("fp", "window").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    bytes_ = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * F.size("window")
    hint = F.broadcast if (parts.agg(F.sum(bytes_)).first()[0] or 0) <= BROADCAST_BYTES else (lambda x: x)
    sizes = [r[0] for r in items.where(n < window).select(n).distinct().collect()]  # fewer than `window` numbers
    place = lambda fp, i, size: F.struct(fp.alias("fp"), i.alias("start"), F.lit(size).alias("size"))
    none = F.array().cast("array<struct<fp:bigint,start:int,size:int>>")
    of_size = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: place(F.xxhash64(F.slice("words", i + 1, k)), i, k))).otherwise(none)
    places = F.concat(F.transform("mins", lambda m, i: place(m, i, window)), *map(of_size, sizes))
    fps = F.array_distinct(F.concat("mins", *[F.transform(of_size(k), lambda x: x["fp"]) for k in sizes]))
    read = lambda rows: _windows(rows.withColumn("words", words_of(F.col("text"))).drop("text"), "words", window, gram)
    texts = docs.select(*text_keys(text), F.col(text).alias("text"))
    # a row for each text, dealt by its own hash, and one for each fingerprint
    asks = F.concat(F.array(F.struct(F.col("h1").alias("fp"), F.lit(True).alias("own"))), F.transform(fps, lambda x: F.struct(x.alias("fp"), F.lit(False).alias("own"))))
    light = read(texts).select(*KEYS, n.alias("n_words"), F.explode(asks).alias("x")).select(*KEYS, "n_words", "x.*")
    light = light.join(hint(parts.select("fp").distinct().withColumn("there", F.lit(True))), "fp", "left").where("own OR there")
    light = light.groupBy(KEYS).agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.when(~F.col("own"), F.col("fp"))).alias("wanted"))
    light = C.written(light, "texts")
    suspects = light.where(F.size("wanted") > 0).drop("n_words")
    few = (suspects.agg(F.sum(F.size("wanted") + 2)).first()[0] or 0) <= SUSPECT_NUMBERS
    # only suspects' words are cut again; many wanted ones aren't searched at each place, all places go to the join
    asked = F.when(F.size("wanted") <= SEARCHED, F.filter(places, lambda x: F.array_contains("wanted", x["fp"]))).otherwise(places)
    marked = read(texts.join(F.broadcast(suspects) if few else suspects, KEYS)).withColumn("places", asked)
    cut = F.transform("places", lambda x: F.struct(x["fp"].alias("fp"), x["start"].alias("start"), x["size"].alias("size"), F.slice("words", x["start"] + 1, x["size"]).alias("window")))
    near = marked.select(*KEYS, F.explode(cut).alias("x")).select(*KEYS, "x.*")
    found = near.join(hint(parts), ["fp", "window"])
    # copies of a text give equal rows: they are merged before and after the exchange
    spans = found.groupBy(KEYS).agg(F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("start") + F.col("size")))).alias("spans"), F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct(F.greatest(s["end"], x["col2"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["col2"] - F.greatest(s["end"], x["start"]))).alias("n")), lambda s: s["n"])
    spans = spans.select(*KEYS, covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    return light.drop("wanted").join(spans, KEYS, "left")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings) and contaminated."""
    per_text = judged(docs, benchmark, text, **options).select(*[F.col(c).alias(f"__{c}") for c in (*KEYS, "n_words", "n_hit", "items")])
    keyed = docs.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(text_keys(text))])  # a query without the text shuffles only these
    out = keyed.join(per_text, (F.col("__k0") == F.col("__h1")) & (F.col("__k1") == F.col("__h2")), "left").drop("__k0", "__k1")
    named = {"n_words": F.col("__n_words"), "n_hit": F.coalesce("__n_hit", F.lit(0).cast("long")), "items": F.coalesce("__items", F.array().cast("array<string>")), "contaminated": F.coalesce(F.col("__n_hit") > 0, F.lit(False))}
    return out.withColumns(named).drop(*per_text.columns)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without a hit; texts only travel if many have one."""
    hit = C.written(judged(docs, benchmark, text, **options).where("n_hit > 0").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")), "contaminated")
    k1, k2 = text_keys(text)
    return docs.join(C.small(hit), (k1 == F.col("__h1")) & (k2 == F.col("__h2")), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rn, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS win
  FROM (SELECT rn, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, sizes WHERE len(ws) >= size)
), m AS (SELECT DISTINCT rn, i, dw.size AS size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
h AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY rn),
n AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (rn) LEFT JOIN n USING (rn)
"""
