"""Long-lived execution workers that speak JSON lines, and their supervisor.

A worker says that it is ready in a first line, reads one request a line ({item_id, code, test_cases, lang, timeout_s}) and answers each with one
line ({result, ...}). The supervisor starts it when the first item comes and keeps it for the next ones.
Writing a request and reading its answer have limits; the reading limit holds for the whole item, however
many tests it has, and its clock starts when the worker is ready, so starting never counts against an item. A foreign command that says nothing first is started with ready=False. An answer that can't be decoded, or null, kills the worker and repeats the item, three
times in all (`fail:run-failed`); no answer in time is `fail:timeout`; a worker that was just started and
does not take its input in time is `fail:input-timeout`, a used one is replaced. Any other exception is
`fail:exception`. One-shot runs start a process for each item and also know `fail:nonzero-exit`.
"""

from __future__ import annotations

import json
import os
import selectors
import signal
import subprocess
import sys
import time

from pyspark.sql import DataFrame

RESULT = "item_id string, status string, details string"
ATTEMPTS = 3
#: Seconds that a worker has to say that it is ready, and bytes that a line of it may have.
START_S = 120.0
LINE_BYTES = 64 << 20


def serve(lines, out, languages: dict | None = None) -> None:
    """Says that it is ready, then answers requests until the input ends. An item without tests is answered with null.

    languages: rows of the registry that hold beside the built-in ones.
    """
    from benchloom.operators.runner import cut, run_item

    out.write(json.dumps({"ready": True}) + "\n")
    out.flush()
    for line in lines:
        r = json.loads(line)
        answer = None
        if r["test_cases"]:
            found = run_item(r["code"], r["test_cases"], r["lang"], r["timeout_s"], languages)
            answer = {"result": found.pop("status")} | {k: cut(v) if isinstance(v, str) else v for k, v in found.items() if v is not None}
        out.write(json.dumps(answer) + "\n")
        out.flush()


def own_command(languages: dict | None = None) -> list[str]:
    return [sys.executable, "-c", f"import sys; sys.path[:0] = {[p for p in sys.path if p]!r}; from benchloom.operators.harness import serve; serve(sys.stdin, sys.stdout, {languages!r})"]


class Retry(Exception):
    pass


class Worker:
    def __init__(self, command: list[str], timeout: float = 30.0, write_timeout: float = 300.0, ready: bool = False):
        self.command, self.timeout, self.write_timeout, self.ready = command, timeout, write_timeout, ready
        self.process: subprocess.Popen | None = None
        self.fresh = True
        self.rest = b""

    def start(self) -> None:
        if self.process is None:
            self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
            os.set_blocking(self.process.stdin.fileno(), False)
            os.set_blocking(self.process.stdout.fileno(), False)
            self.fresh, self.rest = True, b""
            if self.ready and self.read_line(START_S) is None:
                raise Retry

    def stop(self) -> None:
        if self.process is not None:
            try:
                os.killpg(self.process.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            self.process.wait()
            self.process.stdin.close()
            self.process.stdout.close()
            self.process = None

    def _wait(self, stream, event: int, until: float) -> bool:
        with selectors.DefaultSelector() as s:
            s.register(stream, event)
            return bool(s.select(max(0.0, until - time.monotonic())))

    def write(self, body: bytes) -> bool:
        until = time.monotonic() + self.write_timeout
        while body:
            if not self._wait(self.process.stdin, selectors.EVENT_WRITE, until):
                return False
            try:
                body = body[os.write(self.process.stdin.fileno(), body) :]
            except BlockingIOError:
                continue
            except BrokenPipeError:
                raise Retry from None
        return True

    def read_line(self, limit: float | None = None) -> bytes | None:
        """None if there is no whole line in time; a worker that ended, or whose line never does, is a Retry."""
        until = time.monotonic() + (self.timeout if limit is None else limit)
        parts, size = [self.rest], len(self.rest)
        while b"\n" not in parts[-1]:
            if not self._wait(self.process.stdout, selectors.EVENT_READ, until):
                return None
            more = os.read(self.process.stdout.fileno(), 1 << 16)
            size += len(more)
            if not more or size > LINE_BYTES:
                raise Retry
            parts.append(more)
        line, self.rest = b"".join(parts).split(b"\n", 1)
        return line

    def once(self, item: dict) -> dict:
        if not self.write((json.dumps({"timeout_s": self.timeout} | item) + "\n").encode(errors="ignore")):
            fresh = self.fresh
            self.stop()
            if fresh:
                return {"status": "fail:input-timeout", "details": {"timeout_s": self.write_timeout}}
            raise Retry
        line = self.read_line()
        if line is None:
            self.stop()
            return {"status": "fail:timeout", "details": {"timeout_s": self.timeout}}
        try:
            answer = json.loads(line.decode(errors="ignore"))
        except ValueError:
            answer = None
        if not isinstance(answer, dict) or "result" not in answer:
            raise Retry
        return {"status": answer.pop("result"), "details": answer}

    def run(self, item: dict) -> dict:
        for _ in range(ATTEMPTS):
            try:
                self.start()
                return self.once(item)
            except Retry:
                self.stop()
            finally:
                self.fresh = False
        return {"status": "fail:run-failed", "details": {}}


def run_once(command: list[str], item: dict, timeout: float = 60.0) -> dict:
    """A process of its own for one item."""
    p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    try:
        out, err = p.communicate((json.dumps(item | {"timeout_s": timeout}) + "\n").encode(errors="ignore"), timeout)
    except subprocess.TimeoutExpired:
        return {"status": "fail:timeout", "details": {"timeout_s": timeout}}
    finally:
        try:
            os.killpg(p.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        p.wait()
    if p.returncode:
        return {"status": "fail:nonzero-exit", "details": {"exit_code": p.returncode, "stderr": err.decode(errors="ignore")[-2000:]}}
    try:
        # a ready line, if there is one, comes before the answer
        lines = out.decode(errors="ignore").strip().split("\n")
        answer = json.loads(lines[0])
        if answer == {"ready": True}:
            answer = json.loads(lines[1])
        return {"status": answer.pop("result"), "details": answer}
    except (ValueError, AttributeError, KeyError, IndexError, TypeError):
        return {"status": "fail:run-failed", "details": {}}


def supervise(items: DataFrame, command: list[str] | None = None, timeout: float = 30.0, write_timeout: float = 300.0, one_shot: bool = False, partitions: int | None = None, by: str = "item_id") -> DataFrame:
    """items (item_id, code, test_cases, lang) -> (item_id, status, details as JSON); a worker for each task."""
    ready = command is None
    command = command or own_command()

    def batches(it):
        import pyarrow as pa

        worker = Worker(command, timeout, write_timeout, ready and not one_shot)
        try:
            for b in it:
                for row in b.to_pylist():
                    try:
                        r = run_once(command, row, timeout) if one_shot else worker.run(row)
                    except Exception as problem:  # noqa: BLE001  one item must not stop the others
                        worker.stop()
                        r = {"status": "fail:exception", "details": {"type": type(problem).__name__, "message": str(problem)}}
                    yield pa.RecordBatch.from_pylist([{"item_id": row["item_id"], "status": r["status"], "details": json.dumps(r["details"])}])
        finally:
            worker.stop()

    spread = items.repartition(partitions or items.sparkSession.sparkContext.defaultParallelism, by)
    return spread.select("item_id", "code", "test_cases", "lang").mapInArrow(batches, RESULT)
