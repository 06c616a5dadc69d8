"""Column functions over text; built-ins only, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "`" * 3
MARK = "\u0001"
#: (?d): only \n ends a line; possessive \n++ keeps blank lines after a fence out of the body.
BLOCK = rf"(?m)(?d)^{FENCE}[^\n]*\n++((?s:.*?))^{FENCE}(?:$|\n++)"
OPENER = rf"(?d)(?m)^{FENCE}[^\n]*\n"
CUT = rf"(?s)(?d)(?m)^{FENCE}(?:$|\n).*"


def present(c: Column) -> Column:
    """The value, null where it is the empty string: both mean missing."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default) -> Column:
    """The default where a number is null or zero."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


#: What Python counts as white space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def rstrip(c: Column) -> Column:
    """From the end, so runs of blanks inside cost nothing."""
    return F.rtrim(c, F.lit(BLANKS))


def cut_at_fence(c: Column) -> Column:
    return F.regexp_replace(c, CUT, "")


def clean_fences(c: Column) -> Column:
    """Leading space off, one opening fence line off, and nothing from the first closing fence on."""
    bare = F.regexp_replace(c, r"(?U)\A\s+", "")
    return cut_at_fence(F.regexp_replace(bare, rf"(?d)\A{FENCE}[^\n]*\n+", ""))


def final_block(r: Column) -> Column:
    """The answer in a response: its last closed fenced block.

    A response without fences is an answer as a whole unless it is one long line of prose; after an
    empty last block the text behind it counts; an opener that never closes hides what follows.
    Null in, null out; an empty answer is null.
    """
    last = F.try_element_at(F.regexp_extract_all(r, F.lit(BLOCK), F.lit(1)), F.lit(-1))

    def without(r: Column) -> Column:
        looks_like_code = r.rlike(rf"\A(?:{FENCE}|import |from )") | (F.length(r) < 100) | r.contains("\n")
        return F.when(~r.rlike(OPENER) & looks_like_code, clean_fences(r))

    def behind(s: Column) -> Column:
        # an empty last block: what follows the last closed block, unless an opener in what is left hides it
        rest = F.regexp_replace(s["r"], BLOCK, MARK)
        tail = lambda x: cut_at_fence(F.regexp_replace(F.substring_index(x, MARK, -1), r"\A\n+", ""))
        return bound(rest, lambda x: F.when(x.rlike(OPENER), s["clean"]).otherwise(tail(x)))

    def chosen(s: Column) -> Column:
        blank = F.regexp_replace(s["last"], r"(?U)\A\s+", "") == ""
        with_clean = F.struct(s["r"].alias("r"), clean_fences(s["last"]).alias("clean"), blank.alias("blank"))
        return F.when(s["last"].isNull(), without(s["r"])).otherwise(bound(with_clean, lambda x: F.when(x["blank"], behind(x)).otherwise(x["clean"])))

    return present(bound(F.struct(r.alias("r"), last.alias("last")), chosen))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after_thinking_or_all(r: Column) -> Column:
    """after_thinking(), or the whole text where the thinking never ends."""
    return F.coalesce(after_thinking(r), r)


def joined(prompt: Column, completion: Column) -> Column:
    """A prompt's lines, and after an empty line its completion if there is one."""
    return F.concat_ws("\n\n", prompt, completion)


def parsed(c: Column, strict: bool = False) -> Column:
    """A JSON text as a variant. Bad text is null, or an error if strict."""
    return F.parse_json(c) if strict else F.try_parse_json(c)


def first_block(text: Column, lang: str) -> Column:
    return F.regexp_extract(text, rf"(?s){FENCE}\Q{lang}\E\n(.*?){FENCE}", 1)


def after_thinking(r: Column) -> Column:
    """What follows the end of the thinking section; null if there is none."""
    return F.try_element_at(F.split(r, r"\n*</think>\n*", 2), F.lit(2))


def strip_open_think(r: Column) -> Column:
    """An opening tag at the very start goes, and one line end after it."""
    return F.regexp_replace(r, r"\A<think>\n?", "")


def issues_of(answer: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(F.coalesce(answer, F.lit("")) == "", F.lit("no-answer")))), ",")


def same_output(got: Column, expected: Column) -> Column:
    return rstrip(got) == rstrip(expected)


def same_lines(got: Column, expected: Column) -> Column:
    """Equal but for blank lines and space at the ends of lines."""
    lines = lambda c: F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), rstrip), lambda x: x != "")
    return lines(got) == lines(expected)


def numbers_on_last_line(c: Column) -> Column:
    last = F.element_at(F.split(F.trim(c, F.lit(" \n\t\r")), "\n"), -1)
    return F.regexp_extract_all(last, F.lit(r"(-?\d*\.?\d+)"), F.lit(1))


def number_reward(response: Column, answer: Column) -> Column:
    found = numbers_on_last_line(response)
    return F.when((F.size(found) == 1) & (F.try_element_at(found, F.lit(1)).cast("double") == answer), 1.0).otherwise(0.0)


def looks_like_io_answer(c: Column) -> Column:
    """Reads input and writes output."""
    return c.rlike(r"input\(\)|stdin") & c.rlike(r"print\(|stdout")


def item_id(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def slug(lang: Column, n: Column, max_tokens: Column, temperature: Column) -> Column:
    return F.replace(F.concat(lang, F.lit("__n"), n.cast("string"), F.lit("_maxtoks"), max_tokens.cast("string"), F.lit("_tmpr"), temperature.cast("string")), F.lit("."), F.lit("p"))


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", 100 * x)


def money(x: Column) -> Column:
    """Dollars with up to six digits, half to even, without trailing zeros."""
    digits = F.bround(x, 6).cast("decimal(38,6)").cast("string")
    bare = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")
    return F.concat(F.lit("$"), bare)


def dataset_langs(name: Column) -> Column:
    """Languages in a dataset name such as fullmix-lua-julia_xl."""
    return F.split(F.substring_index(F.regexp_replace(name, "^(?:fullmix|mix|seq)-(?:xl-)?", ""), "_", 1), "-")


def dataset_epochs(name: Column) -> Column:
    return F.regexp_extract(name, r"__(?:[^_]*_)*epochs(\d+)", 1).try_cast("int")


def comma_list(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda x: x != "")
