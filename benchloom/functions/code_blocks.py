"""Code paragraphs inside a response's thinking; these need a Python parser, so they run in workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from benchloom.functions import text as T
from benchloom.functions.py_syntax import is_program

BLOCKS = "struct<blocks:array<struct<code:string,at:int>>,end:int>"
BREAK = re.compile(r"\n\n+|(\n?</think>\n*)")
CODE_STARTS = (T.FENCE, "#", "import ", "from ")
SHORT = 100


def unfenced(text: str) -> str:
    body = text.lstrip()
    if opening := re.match(rf"{T.FENCE}.*\n+", body):
        body = body[opening.end() :]
    closing = re.search(rf"^{T.FENCE}(?:$|\n)", body, re.M)
    return body[: closing.start()] if closing else body


def paragraphs(text: str, only_thinking: bool = True) -> tuple[list[tuple[str, int]], int]:
    """Paragraphs with their places, and where the thinking ends.

    What follows the last break is no paragraph unless the thinking ends with it.
    """
    out, at = [], 0
    for m in BREAK.finditer(text):
        out.append((text[at : m.start()], at))
        at = m.end()
        if m[1] is not None and only_thinking:
            return out, at
    return out, len(text)


def code_blocks(text: str, only_thinking: bool = True) -> tuple[list[tuple[str, int]], int]:
    """Paragraphs that look like code and parse, neighbours merged as long as the merged text parses."""
    found, end = paragraphs(text, only_thinking)
    out: list[tuple[str, int]] = []
    open_ = False
    for par, at in found:
        good = False
        if par and (par.lstrip().startswith(CODE_STARTS) or len(par) < SHORT or "\n" in par):
            code, place = unfenced(par), at
            if open_:
                code, place = f"{out[-1][0]}\n\n{code}", out[-1][1]
            if good := is_program(code):
                out[-1:] = [(code, place)] if open_ else [*out[-1:], (code, place)]
        open_ = good
    return out, end


def find_code_blocks(response: Column) -> Column:
    """(blocks with their places, end of the thinking)."""

    @F.pandas_udf(BLOCKS)
    def found(texts):
        import pandas as pd

        rows = [code_blocks(t) if t is not None else (None, None) for t in texts]
        return pd.DataFrame({"blocks": [None if b is None else [{"code": c, "at": i} for c, i in b] for b, _ in rows], "end": pd.array([e for _, e in rows], "Int32")})

    return found(response)


def find_code(response: Column) -> tuple[Column, Column]:
    """The code in the thinking, and the final block after it."""
    body = T.strip_open_think(response)
    blocks = find_code_blocks(body)
    rest = F.substring(body, blocks["end"] + 1, F.length(body))
    return F.transform(blocks["blocks"], lambda b: b["code"]), T.final_block(rest)


def parses_as_python(code: Column) -> Column:
    @F.pandas_udf("boolean")
    def fine(texts):
        import pandas as pd

        return pd.Series([None if t is None else is_program(t) for t in texts], dtype="boolean")

    return fine(code)
