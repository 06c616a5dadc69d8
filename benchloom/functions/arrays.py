"""Token and score arithmetic on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_outputs(prompt: Column, output: Column, limit: int) -> tuple[Column, Column]:
    """Prompt and output clipped together; a prompt over the limit leaves the output empty."""
    return F.slice(prompt, 1, limit), F.slice(output, 1, F.greatest(F.lit(0), limit - F.size(prompt)))


def prompt_mask(prompt: Column, completion: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), F.size(prompt)), F.array_repeat(F.lit(1), F.size(completion)))


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), n - F.size(ids))))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def masked_mean(x: Column, mask: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return total(F.zip_with(x, mask, lambda a, m: a * m)) / total(F.transform(mask, lambda m: m.cast("double")))


def kl_estimate(ref: Column, new: Column) -> Column:
    return F.zip_with(ref, new, lambda r, n: F.exp(r - n) - (r - n) - 1)


def clipped_objective(new: Column, old: Column, advantage: Column, clip: float) -> Column:
    def one(n, o):
        ratio = F.exp(n - o)
        return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)

    return F.zip_with(new, old, one)


def gathered(matrix: Column, ids: Column) -> Column:
    return F.zip_with(matrix, ids, lambda row, i: F.get(row, i))


def no_signal(advantages: Column, eps: float = 1e-7) -> Column:
    return F.forall(advantages, lambda a: F.abs(a) < eps)


def rewards(status: Column, proper: float = 1.0, partial: float = 0.2) -> Column:
    """{proper, partial} of an execution status."""
    return F.create_map(F.lit("proper"), F.when(status == "success", proper).otherwise(0.0), F.lit("partial"), F.when(status == "fail:wrong-output", partial).otherwise(0.0))


def is_checkpoint(step: Column, last: Column | int, every: int) -> Column:
    return F.lit(False) if every == 0 else (step > 1) & (step != F.lit(last) - 1) & (step % every == 0)


def is_evaluation(step: Column, every: int, overlap: bool = False) -> Column:
    return (step % every == 0) | ((step == 1) if overlap else F.lit(False))


def scaled(scores: Column, advantage: Column) -> Column:
    """Each token's score times its sequence's advantage."""
    return F.transform(scores, lambda s: s * advantage)


def loss(masked_means: Column, accumulation_steps: Column | int) -> Column:
    """An aggregate: the loss of a micro-batch from the masked means of its rows."""
    return -F.avg(masked_means) / accumulation_steps


def is_epoch_end(step: Column, max_steps: Column, epochs: Column) -> Column:
    """At the last step, and at multiples of an epoch's whole steps; never at step 0."""
    each = F.floor(max_steps / epochs)
    return (step != 0) & ((step == max_steps) | ((each != 0) & (step % F.nullif(each, F.lit(0)) == 0).eqNullSafe(F.lit(True))))


def evaluation_steps(max_steps: Column, epochs: Column, each_epoch: Column) -> Column:
    """Steps at which to evaluate, the last first; one too close to the end is left out."""
    between = F.floor(F.floor(max_steps / epochs) / each_epoch)
    steps = F.transform(F.sequence(F.lit(1).cast("long"), (each_epoch * epochs).cast("long")), lambda i: i * between)
    return F.reverse(F.when(max_steps - 1 - F.element_at(steps, -1) < between, F.slice(steps, 1, F.size(steps) - 1)).otherwise(steps))


def steps_of(rows: Column, batch: Column, epochs: Column) -> Column:
    """All steps of a run: whole batches of an epoch, times epochs."""
    return (epochs * F.floor(rows / batch)).cast("long")


def warmup_steps(n: Column, ratio: Column) -> Column:
    return F.floor(n * ratio).cast("long")


def gib(n: Column) -> Column:
    return n / 1024**3


def chat_parts(messages: Column) -> tuple[Column, Column]:
    """The messages before the last one, and the last one's content."""
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), F.try_element_at(messages, F.lit(-1))["content"]


def byte_tokens(text: Column) -> Column:
    """The default tokeniser: UTF-8 bytes, so that every text has tokens without a vocabulary."""
    return F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
