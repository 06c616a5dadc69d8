"""Operator 2, URL filters on a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL, "." + host + path. All globs are laid out in one row of
bits, a bit for each number of pattern characters matched, in as many 64-bit words as they need. A
character moves all patterns at once, for a whole column of URLs:

    state = ((state << 1, carried over words) & fits[char]) | (state & stays[char])

Wildcards: `?` is a character but "/", `*` any run without "/", `**` any run. A rule of host and path
(`net/x`) is the glob `*.net/x**`: a host has no "/", so its end is where the rule's path begins.
Of the list rules that fit the longest wins; if none does the glob rules decide: block if one fits.

Defined cases: a null URL or one without "://" has empty host and path and no list rule; a URL that
is all host has an empty path; characters above ASCII match byte by byte; repeated rows and ids are
judged row by row; other columns are kept out of the operator.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (rule, verdict), each a host with all its subdomains, then the start of a path.
LIST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Globs that block where no list rule fits.
GLOB_RULES = [
    "**/wp-login.php**", "**/xmlrpc.php**", "**/wp-admin/**", "**/cgi-bin/**", "**/.git/**", "**/.env", "**/admin/login**", "**/phpmyadmin/**",
    "**.exe", "**.zip", "**.rar", "**.7z", "**.apk", "**.dmg", "**.msi", "**.iso", "**.torrent", "**.mp4", "**.mp3", "**.jpg", "**.jpeg", "**.png", "**.gif",
    "*.doubleclick.*/**", ".ads.**", "*.ads.*/**", "*.adserver.**", ".tracker.**", "*.casino*/**", "*.free-bets.*/**", "*.porn*/**", "*.xxx", "*.xxx/**",
    "**/track/pixel**", "**/ads/**", "**/banner??/**", "**/login", "**/logout", "**/cart/**", "**/checkout/**", "**/signin**", "**/tag/*/page/*", "**/feed/rss*",
]


class WildcardAutomaton:
    """All globs at once; matches() runs over many byte strings together."""

    def __init__(self, globs: list[str]):
        self.globs = list(globs)
        literals: list[tuple[int, int]] = []  # (bit, byte or -1 for ?)
        stays: list[tuple[int, bool]] = []  # (bit, also over "/")
        self.first, self.last = [], []
        bit = 0
        for glob in globs:
            raw = glob.encode()
            self.first.append(bit)
            i = 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    run = 1
                    while raw[i + run : i + run + 1] == b"*":
                        run += 1
                    stays.append((bit, run > 1))
                    i += run
                else:
                    bit += 1
                    literals.append((bit, -1 if raw[i : i + 1] == b"?" else raw[i]))
                    i += 1
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.fits = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        every = np.arange(256)
        part = every != ord("/")
        for b, c in literals:
            self.fits[part if c < 0 else c, b // 64] |= np.uint64(1 << b % 64)
        for b, all_ in stays:
            self.stays[every if all_ else part, b // 64] |= np.uint64(1 << b % 64)
        self.start = np.zeros(self.words, np.uint64)
        for b in self.first:
            self.start[b // 64] |= np.uint64(1 << b % 64)

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs): which globs match each whole text."""
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1][order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-size[order], -np.arange(1, (size.max() if n else 0) + 1), side="right")
        for t, k in enumerate(live.tolist()):
            char = data[begin[:k] + t]
            now = state[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.fits[char]
            now &= self.stays[char]
            now |= moved
        out = np.empty((n, len(self.globs)), bool)
        last = np.array(self.last, np.int64)
        out[order] = state[:, last // 64] >> (last % 64).astype(np.uint64) & np.uint64(1) > 0
        return out


def host_of(url: Column) -> Column:
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(found, C.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    return F.when(found, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", list_rules=None, glob_rules=None) -> DataFrame:
    """(key, host, path, rule, glob, verdict) for each row; rule: the list rule, glob: the first glob that fits."""
    list_rules = LIST_RULES if list_rules is None else list_rules
    glob_rules = GLOB_RULES if glob_rules is None else glob_rules
    ranked = sorted(list_rules, key=lambda r: (-len(r[0]), r[0]))
    globs = [f"*.{r}**" for r, _ in ranked] + list(glob_rules)
    # a rule's own "*" or "?" would be wildcards: list rules are literal
    if any(c in r for r, _ in ranked for c in "*?"):
        raise ValueError("list rules have no wildcards")

    def judge(batches):
        import pyarrow as pa

        automaton = WildcardAutomaton(globs)
        k = len(ranked)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = automaton.matches([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            first, glob = hit[:, :k].argmax(axis=1) if k else np.zeros(len(hit), int), hit[:, k:].argmax(axis=1) if len(globs) > k else np.zeros(len(hit), int)
            ruled, globbed = hit[:, :k].any(axis=1), hit[:, k:].any(axis=1)
            rules = [ranked[i][0] if x else None for i, x in zip(first, ruled)]
            verdicts = [ranked[i][1] if x else "block" if y else "allow" for i, x, y in zip(first, ruled, globbed)]
            names = [globs[k + i] if y else None for i, y in zip(glob, globbed)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(rules, pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[key, "host", "path", "rule", "glob", "verdict"])

    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, glob string, verdict string")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _glob_sql(glob: str) -> str:
    """A glob as a regular expression for the oracle."""
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out += "(?:.|\\n)*" if run > 1 else "[^/]*"
            i += run
        else:
            out += "[^/]" if glob[i] == "?" else "\\" + glob[i] if not glob[i].isalnum() and glob[i] not in "/_" else glob[i]
            i += 1
    return out.replace("'", "''")


def _oracle() -> str:
    fits = " ".join(f"WHEN regexp_full_match('.' || host || path, '{_glob_sql(f'*.{r}**')}') THEN '{r}'" for r, _ in sorted(LIST_RULES, key=lambda r: -len(r[0])))
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in LIST_RULES)
    blocked = "|".join(f"(?:{_glob_sql(g)})" for g in GLOB_RULES)
    return f"""
WITH s AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM s
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path FROM h
), r AS (SELECT *, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN regexp_full_match('.' || host || path, '{blocked}') THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""


ORACLE = _oracle()
