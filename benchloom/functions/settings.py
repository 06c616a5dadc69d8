"""Small languages for optimizers and schedulers, parsed on the driver."""

from __future__ import annotations

import ast
import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIMIZERS = {"Adam", "AdamW"}
OPTIONS = {"lr": float, "eps": float, "weight_decay": float, "amsgrad": bool, "fused": bool, "betas": tuple}
SCHEDULERS = {"cosine", "linear", "constant"}


def _call(text: str) -> tuple[str, dict]:
    """name(key=value ...): values are numbers, booleans or pairs of numbers; blanks or commas separate them."""
    name, bracket, rest = text.strip().partition("(")
    if not bracket or not rest.rstrip().endswith(")") or not name.strip().isidentifier():
        raise ValueError(f"not a setting: {text!r}")
    body, found, depth, word = rest.rstrip()[:-1], [], 0, ""
    for c in body + " ":
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            raise ValueError(f"brackets in {text!r}")
        if (c.isspace() or c == ",") and not depth:
            found += [word] if word else []
            word = ""
        else:
            word += "" if c.isspace() else c
    out: dict = {}
    for part in found:
        key, eq, value = part.partition("=")
        if not eq or not value:
            raise ValueError(f"not key=value: {part!r}")
        if key in out:
            raise ValueError(f"duplicate parameter: {key}")
        try:
            out[key] = ast.literal_eval(value)
        except (ValueError, SyntaxError):
            raise ValueError(f"bad value in {part!r}") from None
    return name.strip(), out


def parse_optimizer(text: str) -> tuple[str, dict]:
    name, found = _call(text)
    if name not in OPTIMIZERS:
        raise ValueError(f"unknown optimizer {name!r}")
    for key, value in found.items():
        kind = OPTIONS.get(key)
        if kind is None:
            raise ValueError(f"unknown parameter {key!r}")
        pair = isinstance(value, tuple) and len(value) == 2 and all(isinstance(x, int | float) for x in value)
        fine = pair if kind is tuple else isinstance(value, bool) if kind is bool else isinstance(value, int | float) and not isinstance(value, bool)
        if not fine:
            raise ValueError(f"bad value for {key!r}")
        found[key] = tuple(map(float, value)) if kind is tuple else kind(value)
    return name, found


def parse_scheduler(text: str, steps: int) -> tuple[str, int]:
    """(name, warm-up steps): warmup_steps, or warmup_ratio of all steps, rounded down; not both."""
    name, found = _call(text)
    if name not in SCHEDULERS or set(found) - {"warmup_ratio", "warmup_steps"} or len(found) > 1:
        raise ValueError(f"not a scheduler: {text!r}")
    return name, int(found.get("warmup_steps", math.floor(steps * found.get("warmup_ratio", 0))))


def worker_count(asked: int | None, cpus: int | None = None) -> int:
    """None: all but one processor, 16 at most; 0: all but one; else as asked."""
    free = max(1, (cpus or os.cpu_count() or 1) - 1)
    return min(free, 16) if asked is None else asked or free


def exclusive(*, need_one: bool = False, **options) -> str | None:
    """The name of the option given, of several that exclude each other."""
    given = [k for k, v in options.items() if v is not None and v is not False]
    if len(given) > 1 or need_one and not given:
        raise ValueError(f"{'exactly' if need_one else 'at most'} one of {', '.join(options)} may be given, not {given}")
    return given[0] if given else None


#: By architecture, what a weight's name has in it that is not decayed. Biases never are.
UNDECAYED = {
    "GPTBigCodeForCausalLM": "ln_",
    "LlamaForCausalLM": "_layernorm",
    "Olmo2ForCausalLM": "norm",
    "Phi3ForCausalLM": "norm",
    "Qwen2ForCausalLM": "norm",
    "Qwen3ForCausalLM": "norm",
    "SmolLM3ForCausalLM": "_layernorm",
    "Starcoder2ForCausalLM": "_layernorm",
}


def decay_group(architecture: Column, name: Column) -> Column:
    """`decay` or `no_decay`; null for an architecture that is not in the table."""
    part = F.create_map(*[F.lit(x) for pair in UNDECAYED.items() for x in pair])[architecture]
    free = name.contains("bias") | (name.contains(part) & name.contains("weight"))
    return F.when(part.isNotNull(), F.when(free, "no_decay").otherwise("decay"))
