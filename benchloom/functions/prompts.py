"""Prompts from problems. The wording is data: TEMPLATES may be replaced by the caller's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

TEMPLATES = {
    "head": "Solve this programming problem.\n\n", "alt_head": "Task description\n----------------\n", "input": "\n\nInput format:\n", "output": "\n\nOutput format:\n",
    "alt_input": "\n\nWhat is read:\n", "alt_output": "\n\nWhat is written:\n", "example": "Example %d\nInput:\n%s\nOutput:\n%s\n", "alt_example": "Case %d: given\n%s\nprint\n%s\n",
    "examples": "\n\n", "notes": "\nNotes:\n", "suffix": "\n\nWrite the whole program in %s, in one fenced block.",
}


def _section(title: str, body: Column) -> Column:
    return F.coalesce(F.concat(F.lit(title), present(body)), F.lit(""))


def _examples(examples: Column, template: str, upto: Column) -> Column:
    return F.array_join(F.transform(F.slice(examples, 1, upto), lambda e, i: F.format_string(template, i + 1, e["input"], e["output"])), "\n")


def build_prompt(statement, input_format, output_format, examples, notes, lang, t: dict = TEMPLATES, alt: str = "") -> Column:
    """All examples but the last, which is held out; sections only where their text is there."""
    shown = F.greatest(F.size(examples) - 1, F.lit(0))
    return F.concat(
        F.lit(t[f"{alt}head"]), statement, _section(t[f"{alt}input"], input_format), _section(t[f"{alt}output"], output_format), F.lit(t["examples"]),
        _examples(examples, t[f"{alt}example"], shown), _section(t["notes"], notes), F.format_string(t["suffix"], lang),
    )


def raw_prompt(statement, input_format, output_format, examples, notes, lang, with_examples: Column, t: dict = TEMPLATES) -> Column:
    body = F.concat_ws("\n", statement, F.coalesce(input_format, F.lit("None")), F.coalesce(output_format, F.lit("None")))
    shown = F.when(with_examples, F.concat(F.lit("\n"), _examples(examples, t["example"], F.greatest(F.size(examples) - 1, F.lit(0))))).otherwise("")
    return F.concat(body, shown, _section(t["notes"], notes), F.format_string(t["suffix"], lang))


def uniform(seed: Column | int, key: Column, draw: int) -> Column:
    """A reproducible number in [0, 1) for a key: the first 32 bits of an MD5."""
    said = F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string"), F.lit(str(draw)))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / 4294967296.0


def build_variant_prompt(statement, input_format, output_format, examples, notes, lang, key, seed: int = 42) -> Column:
    """30 % standard, 35 % other headers, 35 % raw; raw if there is a single example or none."""
    args = (statement, input_format, output_format, examples, notes, lang)
    raw = raw_prompt(*args, uniform(seed, key, 3) < 0.5)
    return F.when(F.size(examples) <= 1, raw).when(uniform(seed, key, 1) < 0.3, build_prompt(*args)).when(uniform(seed, key, 2) < 0.5, build_prompt(*args, alt="alt_")).otherwise(raw)


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    """[system?, user, assistant?] as structs; missing parts are left out."""
    one = lambda role, c: F.when(present(c).isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.array_compact(F.array(one("system", system), one("user", user), one("assistant", assistant)))


def benchmark_prompt(question: Column, lang: str) -> Column:
    return F.format_string("Question:\n%s\nAnswer in %s.", question, F.lit(lang))


#: One example is shown, the first; %s in order: statement, input format, output format, input, output, language, its fence.
TRANSLATED = "Solve this task.\n\n%s\n\nInput: %s\nOutput: %s\n\nFor the input\n%s\nthe output is\n%s\n\nThink first, then give a whole program in %s, in one block that starts with ```%s.\n"


def translated_prompt(statement, input_format, output_format, tests, long_name, lang, template: str = TRANSLATED) -> Column:
    first = F.get(tests, F.lit(0))
    return F.format_string(template, statement, input_format, output_format, first["input"], first["output"], long_name, lang)


#: What turns thinking off, by a model family's own word for it (fixed values).
NO_THINKING = {"qwen": "/nothink", "smollm3": "/no_think"}


def model_messages(prompt: Column, completion: Column, family: str, pairs: Column | None = None) -> Column:
    """The family's system turn, earlier (user, assistant) pairs, the prompt and, if there is one, the completion."""
    if family not in NO_THINKING:
        raise ValueError(f"unknown model family {family!r}")
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    said = none if pairs is None else F.flatten(F.transform(pairs, lambda p: F.array(one("user", p["user"]), one("assistant", p["assistant"]))))
    return F.concat(F.array(one("system", F.lit(NO_THINKING[family]))), said, F.array(one("user", prompt)), F.when(present(completion).isNotNull(), F.array(one("assistant", completion))).otherwise(none))
