"""Running untrusted programs against test cases, inside Spark tasks.

Every program runs in a child process of its own: new session, an environment of PATH, HOME and LANG, a
temporary folder, limits on memory, CPU seconds, processes, file size and open files; the whole process group is
killed at a timeout. Where the kernel allows it, programs run in a box (see box): user, mount and process
namespaces of their own, without network and without the machine's files; elsewhere only the network is cut if that can be. Output is compared as a whole,
up to the limit on file size; only what a result stores is cut. The first failing test decides. Any exception becomes a row, never a failed task. Results are keyed by
item_id, so a retried task only repeats rows that the sink drops.
"""

from __future__ import annotations

import functools
import inspect
import json
import os
import resource
import shutil
import signal
import subprocess
import sys
import tempfile

from pyspark.sql import DataFrame

from benchloom.operators import box
from benchloom.schemas import RESULT

#: lang -> (file name, compile command or None, run command, flags).
LANGUAGES = {
    "python": ("snippet.py", None, [sys.executable, "-I", "snippet.py"], {}),
    "lua": ("snippet.lua", None, ["lua", "snippet.lua"], {}),
    "julia": ("snippet.jl", None, ["julia", "snippet.jl"], {}),
    "r": ("snippet.R", None, ["Rscript", "snippet.R"], {}),
    "c": ("snippet.c", ["gcc", "snippet.c", "-o", "snippet", "-lm"], ["./snippet"], {"killed_is_timeout": True}),
    "cpp": ("snippet.cpp", ["clang++", "-O0", "-g0", "-pipe", "-std=c++17", "snippet.cpp", "-o", "snippet"], ["./snippet"], {"error_is_other": True, "killed_is_timeout": True}),
    "java": ("snippet.java", None, ["java", "snippet.java"], {}),
    "rust": ("snippet.rs", ["rustc", "--edition=2021", "snippet.rs", "-o", "snippet"], ["./snippet"], {"by_lines": True, "killed_is_timeout": True}),
    "ocaml": ("snippet.ml", None, ["utop", "-require", "base", "-require", "stdio", "snippet.ml"], {"timeout_is_error": True}),
    "fortran": ("snippet.f90", ["gfortran", "snippet.f90", "-o", "snippet"], ["./snippet"], {}),
}
MEMORY, OUTPUT, COMPILE_S = 1 << 30, 1 << 20, 60
FILE_SIZE, PROCESSES, OPEN_FILES = 128 << 20, 4096, 1024
FIELDS = ("status", "expected", "got", "stdout", "stderr", "exit_code", "timeout_s", "details")


def available(lang: str) -> bool:
    _, build, run, _ = LANGUAGES[lang]
    return all(shutil.which(c[0]) or c[0].startswith("./") for c in (build or run, run))


#: A box's tmpfs, its processes, and the users that boxes started by root run as.
BOX_BYTES, BOX_PROCESSES, BOX_USERS = 128 << 20, 512, range(200_000, 260_000)


def boxed(command: list[str], folder: str, root: str) -> list[str]:
    """The command in a box; root: an empty folder where the box's file system is made."""
    homes = {os.path.dirname(p) if os.path.basename(p) in ("bin", "sbin") else p for p in os.environ.get("PATH", "").split(os.pathsep) if p.startswith("/")}
    seen = sorted(p for p in {sys.prefix, sys.base_prefix, *homes} if p not in ("/", ""))
    uid = 0 if os.getuid() else BOX_USERS[os.getpid() * 31 % len(BOX_USERS)]
    settings = {"root": root, "folder": os.path.realpath(folder), "seen": seen, "uid": uid, "bytes": BOX_BYTES, "processes": BOX_PROCESSES}
    return [sys.executable, "-I", "-S", "-c", inspect.getsource(box), json.dumps(settings), *command]


@functools.cache
def can_box() -> bool:
    """Whether this machine lets this user make boxes, tried once."""
    if not hasattr(os, "unshare") or os.uname().machine not in box.PIVOT_ROOT:
        return False
    with tempfile.TemporaryDirectory(prefix="run-") as folder, tempfile.TemporaryDirectory(prefix="box-") as root:
        try:
            said = subprocess.run(boxed([sys.executable, "-I", "-c", "print(1)"], folder, root), cwd=folder, capture_output=True, timeout=60, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return False
        return said.returncode == 0 and said.stdout == b"1\n"


def _limits(timeout: float, unshare: bool = True):
    def apply():
        for flags in (os.CLONE_NEWNET, os.CLONE_NEWUSER | os.CLONE_NEWNET) if unshare and hasattr(os, "unshare") else ():
            try:
                os.unshare(flags)
                break
            except OSError:  # not allowed here: the network is then left to the cluster
                continue
        wanted = {"AS": MEMORY if sys.platform != "darwin" else -1, "CPU": int(timeout) + 1, "FSIZE": FILE_SIZE, "CORE": 0, "NPROC": PROCESSES, "NOFILE": OPEN_FILES}
        for what, most in wanted.items():
            kind = getattr(resource, f"RLIMIT_{what}")
            hard = resource.getrlimit(kind)[1]
            most = most if hard == resource.RLIM_INFINITY or most < 0 else min(most, hard)
            resource.setrlimit(kind, (most, most))

    return apply


def execute(command: list[str], stdin: str, timeout: float, folder: str, limit: bool = True) -> tuple[int | None, str, str]:
    """(exit code, stdout, stderr); exit code None at a timeout."""
    folder = os.path.realpath(folder)
    env = {"PATH": os.environ.get("PATH", ""), "HOME": folder, "LANG": "C.UTF-8"}
    in_box = limit and can_box()
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err, tempfile.TemporaryDirectory(prefix="box-") as root:
        if in_box:
            command = boxed(command, folder, root)
        p = subprocess.Popen(command, cwd=folder, env=env, stdin=subprocess.PIPE, stdout=out, stderr=err, start_new_session=True, preexec_fn=_limits(timeout, not in_box) if limit else None)
        try:
            p.communicate(stdin.encode(), timeout)
            code = p.returncode
        except subprocess.TimeoutExpired:
            code = None
        except BrokenPipeError:
            code = p.wait()
        finally:
            try:
                os.killpg(p.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            p.wait()
        texts = []
        for f in (out, err):
            f.seek(0)
            texts.append(f.read().decode(errors="ignore"))
    return code, *texts


def cut(text: str | None) -> str | None:
    """What a result stores of an output: OUTPUT bytes at most, whole characters."""
    return text if text is None or len(text) * 4 <= OUTPUT else text.encode()[:OUTPUT].decode(errors="ignore")


def run_item(code: str, tests: list[dict], lang: str, timeout: float, languages: dict[str, tuple] | None = None) -> dict:
    """The result of one item; see the statuses of benchloom.schemas. languages: more of them, or others of the same name."""
    known = LANGUAGES | (languages or {})
    if lang not in known:
        return {"status": "fail:exception", "details": f"unknown language {lang}"}
    if not (code or "").strip():
        return {"status": "fail:no-answer"}
    if not tests:
        return {"status": "fail:no-tests"}
    name, build, run, flags = known[lang]
    try:
        with tempfile.TemporaryDirectory(prefix="run-") as folder:
            with open(f"{folder}/{name}", "w") as f:
                f.write(code)
            failed = "fail:other" if flags.get("error_is_other") else "fail:error"
            if build:
                exit_code, out, err = execute(build, "", COMPILE_S, folder, limit=False)
                if exit_code != 0:
                    return {"status": failed, "stdout": out, "stderr": err, "exit_code": exit_code, "details": "compile"}
            for test in tests:
                exit_code, out, err = execute(run, test["input"] or "", timeout, folder)
                if exit_code is None or flags.get("killed_is_timeout") and exit_code == -9:
                    status = "fail:error" if flags.get("timeout_is_error") else "fail:timeout"
                    return {"status": status, "stdout": out, "stderr": err, "timeout_s": timeout}
                if exit_code:
                    return {"status": failed, "stdout": out, "stderr": err, "exit_code": exit_code}
                if flags.get("by_lines"):
                    same = [x.rstrip() for x in out.splitlines() if x.strip()] == [x.rstrip() for x in (test["output"] or "").splitlines() if x.strip()]
                else:
                    same = out.rstrip() == (test["output"] or "").rstrip()
                if not same:
                    return {"status": "fail:wrong-output", "expected": test["output"], "got": out, "stderr": err}
        return {"status": "success"}
    except Exception as problem:  # noqa: BLE001  one item must not stop the others
        return {"status": "fail:exception", "details": f"{type(problem).__name__}: {problem}"}


def run_items(items: DataFrame, timeout: float = 15.0, partitions: int | None = None) -> DataFrame:
    """items (item_id, code, test_cases, lang) -> results, without workers; pools.run_pools gives each language tasks of its own."""

    def batches(it):
        import pyarrow as pa

        for b in it:
            for row in b.to_pylist():
                r = {"item_id": row["item_id"]} | dict.fromkeys(FIELDS) | run_item(row["code"], row["test_cases"], row["lang"], timeout)
                if r["timeout_s"] is not None:
                    r["timeout_s"] = float(r["timeout_s"])
                yield pa.RecordBatch.from_pylist([r | {k: cut(r[k]) for k in ("expected", "got", "stdout", "stderr")}], schema=schema)

    import pyarrow as pa

    kinds = {"int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds.get(f.split()[1], pa.string())) for f in RESULT.split(", ")])
    spread = items.repartition(partitions or items.sparkSession.sparkContext.defaultParallelism, "item_id")
    return spread.select("item_id", "code", "test_cases", "lang").mapInArrow(batches, RESULT)
