"""Operator 7, license scans by ordered signature rules; DataFrame functions only.

A rule (license_rules) is a regex with a keyword, a label and a priority, 1 being the strongest. A text is
read as its words, lower-cased, each between two blanks of its own, so line breaks, comment marks and
punctuation inside a license text do no harm and matches that follow each other share nothing. A rule
is tried where the text has its keyword, a word that every match of the rule has, so the prefilter loses
nothing. Detections are intervals of the words; one that lies inside an interval of a rule at least as
strong is suppressed.

Besides, base phrases count where their words stand consecutively; their labels always stay. The score
is that of the strongest label: 1 for priority 1, 0.8 for 2 and base phrases, 0.5 for 3.

Defined cases: a null text is empty; words are runs of letters, digits and characters above ASCII;
texts without a detection have no labels (empty strings) and score 0; the text is read whole, however
long; rows are judged one by one, so repeated rows and null or repeated ids do no harm; columns of the
input that are named like a result are replaced, all others stay.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .license_rules import RULES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
STRENGTH = {1: 1.0, 2: 0.8, 3: 0.5}
DETECTION = "array<struct<start:int,less_end:int,priority:int,label:string>>"
#: Detections that are added up at a time, so that the work stays linear in them.
STEP = 256
OPEN, CLOSE = "\x01", "\x02"  # words never have them


def spaced(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def places(stream: Column, rule: Column) -> Column:
    """The intervals of a rule's matches, from one pass that marks them."""
    marked = F.regexp_replace(stream, rule["regex"], F.lit(f"{OPEN}$1{CLOSE}"))

    def found(parts: Column) -> Column:
        none = F.array().cast(DETECTION)

        def one(s, part):
            end = s["at"] + F.instr(part, CLOSE) - 1
            hit = F.struct(s["at"].alias("start"), (-end).alias("less_end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
            return F.struct((s["at"] + F.length(part) - 1).alias("at"), F.concat(s["out"], F.array(hit)).alias("out"))

        def some(s, i):
            inner = F.aggregate(F.slice(parts, 2 + i * STEP, STEP), F.struct(s["at"].alias("at"), none.alias("out")), one)
            return F.element_at(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out"))), 1)

        steps = F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / STEP).cast("int"))
        zero = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(f"array<{DETECTION}>").alias("out"))
        return F.when(F.size(parts) > 1, F.flatten(F.aggregate(steps, zero, some, lambda s: s["out"]))).otherwise(none)

    return F.element_at(F.transform(F.array(F.split(marked, OPEN)), found), 1)


def detections(stream: Column, present: Column, rules=RULES) -> Column:
    """All detections, sorted by start, longest first, strongest first. present: the keywords that the text has."""
    said = json.dumps([{"label": a, "keyword": b, "priority": c, "regex": f"({d})"} for a, b, c, d in rules])
    known = F.from_json(F.lit(said), "array<struct<label:string,keyword:string,priority:int,regex:string>>")
    tried = F.filter(known, lambda r: F.array_contains(present, r["keyword"]))
    return F.array_sort(F.flatten(F.transform(tried, lambda r: places(stream, r))))


def unsuppressed(found: Column) -> Column:
    """(label, priority) of the detections that lie inside no other of a rule at least as strong."""
    none = F.array().cast("array<struct<label:string,priority:int>>")
    zero = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), none.alias("kept"))

    def step(s, d):
        end, p = -d["less_end"], d["priority"]
        inside = (s["e1"] >= end) | ((p >= 2) & (s["e2"] >= end)) | ((p >= 3) & (s["e3"] >= end))
        ends = [F.when(p == k, F.greatest(s[f"e{k}"], end)).otherwise(s[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3)]
        one = F.array(F.struct(d["label"].alias("label"), p.alias("priority")))
        return F.struct(*ends, F.when(inside, s["kept"]).otherwise(F.array_union(s["kept"], one)).alias("kept"))

    return F.aggregate(found, zero, step, lambda s: s["kept"])


def scan_licenses(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    t = F.coalesce(F.col(text), F.lit(""))
    # the quick lower() is right for ASCII only
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(C.ascii_lower(t))
    found = docs.withColumn("__words", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))
    keywords = sorted({k for _, k, _, _ in rules} | {"license"})
    found = found.withColumns({"n_words": F.size("__words").cast("long"), "__present": F.array_intersect("__words", F.array(*map(F.lit, keywords)))})
    # texts without any keyword, most of them, are not joined again
    found = found.withColumn("__stream", F.when(F.size("__present") > 0, F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" ")))).drop("__words")
    licensed = F.array_contains("__present", "license")
    base = "|".join(spaced(p) for _, p in BASE)
    found = found.withColumns(
        {
            "__kept": F.when(F.size("__present") > 0, unsuppressed(detections(F.col("__stream"), F.col("__present"), rules))).otherwise(F.array().cast("array<struct<label:string,priority:int>>")),
            "__base": F.when(licensed, F.regexp_extract_all("__stream", F.lit(f"({base})"), F.lit(1))).otherwise(F.array().cast("array<string>")),
        }
    )
    any_ = F.size("__base") > 0
    words = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    label = lambda m: reduce(lambda c, b: c.when(m == spaced(b[1]), b[0]), BASE[1:], F.when(m == spaced(BASE[0][1]), BASE[0][0]))
    own = F.sort_array(F.array_distinct(F.transform("__base", label)))
    strong = F.array_min(F.concat(F.transform("__kept", lambda d: d["priority"]), F.when(any_, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))))
    last = F.try_element_at("__base", F.lit(-1))
    out = found.withColumns(
        {
            "n_base": F.size("__base").cast("long"),
            "first_word": F.when(any_, words(F.get(F.split("__stream", base, 2), F.lit(0)))),
            "last_word": F.when(any_, F.col("n_words") - words(F.element_at(F.split("__stream", base, -1), -1)) - words(last)),
            "base_labels": F.array_join(own, ","),
            "labels": F.array_join(F.sort_array(F.array_union(own, F.transform("__kept", lambda d: d["label"]))), ","),
            "score": reduce(lambda c, p: c.when(strong == p, STRENGTH[p]), (2, 3), F.when(strong == 1, STRENGTH[1])).otherwise(0.0),
        }
    )
    return out.drop("__present", "__stream", "__kept", "__base")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


_RULES = ", ".join(f"('{label}', '{keyword}', {priority}, '({regex})')" for label, keyword, priority, regex in RULES)
ORACLE = rf"""
WITH rules(label, keyword, priority, rx) AS (VALUES {_RULES}),
w AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), t AS (SELECT *, ' ' || array_to_string(ws, '  ') || ' ' AS stream FROM w),
m AS (
  SELECT rn, label, priority, string_split(regexp_replace(stream, rx, chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts
  FROM (SELECT rn, stream, unnest(list_distinct(ws)) AS keyword FROM t) JOIN rules USING (keyword)
), p AS (SELECT rn, label, priority, i, parts[i] AS part FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM m WHERE len(parts) > 1)),
d AS (
  SELECT rn, label, priority, s AS start, s + instr(part, chr(2)) - 1 AS stop
  FROM (SELECT *, coalesce(sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rn, label, priority, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT *, sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rn, label, priority ORDER BY k) AS n FROM (SELECT *, row_number() OVER () AS k FROM p))) WHERE i > 1
), u AS (
  SELECT DISTINCT rn, label, priority FROM d
  WHERE NOT EXISTS (SELECT 1 FROM d g WHERE g.rn = d.rn AND g.start <= d.start AND g.stop >= d.stop AND g.priority <= d.priority
                    AND (g.start < d.start OR g.stop > d.stop OR g.priority < d.priority OR g.label < d.label))
), b AS (
  SELECT rn, i, label, size
  FROM (SELECT rn, ws, unnest(generate_series(1, len(ws))) AS i FROM t), (VALUES ('mit', ['mit', 'license'], 2), ('apache', ['apache', 'license'], 2), ('gpl', ['general', 'public', 'license'], 3)) x(label, phrase, size)
  WHERE ws[i] = phrase[1] AND list_slice(ws, i, i + size - 1) = phrase
), bs AS (SELECT rn, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rn),
ls AS (SELECT rn, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(priority) AS best FROM (SELECT rn, label, priority FROM u UNION ALL SELECT rn, label, 2 FROM b) GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word, coalesce(bs.labels, '') AS base_labels,
       coalesce(ls.labels, '') AS labels, CAST(CASE best WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM t LEFT JOIN bs USING (rn) LEFT JOIN ls USING (rn)
"""
