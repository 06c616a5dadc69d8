"""Whether a text is a Python program, of today's grammar or of forms that only older ones have.

Programs in old training texts print without brackets, so the interpreter's grammar alone would lose
them. A text that it rejects is scanned into strings, comments, numbers, names and brackets, statement by
statement, and the older forms are written as today's grammar has them: print and exec statements, `<>`, `except
A, b:`, `raise A, b`, numbers like 0777 and 10L, and tabs that stand for eight columns. What then parses is a program. The
rewritten text is never used otherwise.

Texts are rejected as before if their older forms are mixed with what no grammar has, such as a bracket that is
left open. Not taken over: arguments in orders that only the meaning forbids (`f(a=1, 2)`), deleted calls.
"""

from __future__ import annotations

import ast
import re
import warnings

TOKEN = re.compile(
    r"""(?P<string>(?i:[rbuf]{0,2})(?:\"\"\"(?s:\\.|[^\\])*?\"\"\"|'''(?s:\\.|[^\\])*?'''|"(?:\\(?s:.)|[^"\\\n])*"|'(?:\\(?s:.)|[^'\\\n])*'))"""
    r"|(?P<comment>\#[^\n]*)|(?P<number>\d\w*(?:\.\w*)?|\.\d\w*)|(?P<name>[^\W\d]\w*)|(?P<line>\n)|(?P<blank>(?:[ \t\f]|\\\n)+)|(?P<op><>|(?s:.))"
)
WORDS = ("print", "exec", "raise", "except")
#: What may follow print and exec as a name: then they are no statements.
NAMED = {"(", "=", ".", ",", "[", ")", "]", "}", ":", ""}


def parses(code: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _number(text: str) -> str:
    if re.fullmatch(r"\d+[lL]", text):
        text = text[:-1]
    return text.lstrip("0") or "0" if re.fullmatch(r"0\d+", text) else text


def _statement(tokens: list[tuple[str, str]]) -> str:
    """One simple statement or the head of a compound one, in today's form."""
    at = next((i for i, (kind, _) in enumerate(tokens) if kind not in ("blank", "line")), len(tokens))
    word = tokens[at][1] if at < len(tokens) else ""
    rest = tokens[at + 1 :]
    end = len(rest)
    while end and rest[end - 1][0] in ("blank", "comment", "line"):
        end -= 1
    body, tail = rest[:end], rest[end:]
    text = lambda part: "".join(t for _, t in part)
    depth, commas = 0, []
    for i, (kind, t) in enumerate(body):
        if kind == "op":
            depth += (t in "([{") - (t in ")]}")
            if t == "," and depth == 0:
                commas.append(i)
    if word in ("print", "exec"):
        first = next((t for kind, t in body if kind != "blank"), "")
        if first not in NAMED:
            if text(body).lstrip().startswith(">>"):  # a file, then what goes into it
                body = body[next(i for i, (_, t) in enumerate(body) if t == ">") + 2 :]
            inner = text(body).strip().removesuffix(",")
            return f"{text(tokens[:at])}({inner},){text(tail)}"
    elif word == "raise" and commas:
        return f"{text(tokens[: at + 1])} ({text(body).strip()}){text(tail)}"
    elif word == "except" and len(commas) == 1:
        return f"{text(tokens[: at + 1])}{text(body[: commas[0]])} as {text(body[commas[0] + 1 :]).strip()}{text(tail)}"
    return text(tokens)


def todays(code: str) -> str:
    """The code with older forms as today's grammar has them; all else as it is."""
    out, statement, depth = [], [], 0
    lines = True  # whether this is the beginning of a line
    for m in TOKEN.finditer(code):
        kind, t = m.lastgroup, m[0]
        if lines and depth == 0 and kind == "blank":
            t = t.expandtabs(8)
        lines = kind == "line"
        if kind == "number":
            t = _number(t)
        elif t == "<>":
            t = "!="
        statement.append((kind, t))
        if kind == "op":
            depth += (t in "([{") - (t in ")]}")
        # a colon ends the head of a block, or stands in an annotation or lambda, where no word of WORDS follows it
        if depth <= 0 and (kind == "line" or kind == "op" and t in (";", ":")):
            head = [t for k, t in statement if k == "name"][:1]
            # the colon of `except A, b:` belongs to its head
            mark = statement.pop() if t in (";", ":") else None
            out.append(_statement(statement) if head and head[0] in WORDS else "".join(t for _, t in statement))
            if mark:
                out.append(mark[1])
            statement = []
    head = [t for k, t in statement if k == "name"][:1]
    out.append(_statement(statement) if head and head[0] in WORDS else "".join(t for _, t in statement))
    return "".join(out)


def is_program(code: str) -> bool:
    """A text of nothing but blanks is a program, too."""
    return parses(code) or parses(todays(code))
