"""External tools: run without a shell, with a timeout and cancellation."""

from __future__ import annotations

import shutil
import subprocess
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class ToolResult:
    executable: str
    args: tuple[str, ...]
    stdout: str
    stderr: str
    exit_code: int
    timed_out: bool = False
    cancelled: bool = False
    duration_ms: float = 0.0

    @property
    def success(self) -> bool:
        return self.exit_code == 0 and not self.timed_out and not self.cancelled


@dataclass(frozen=True)
class ToolRunner:
    timeout: float = 60.0
    poll_interval: float = 0.01
    environment: dict | None = None

    def __post_init__(self):
        if self.timeout <= 0 or self.poll_interval <= 0:
            raise ValueError("timeout and poll interval must be positive")


def tool_path(executable: str) -> str | None:
    return shutil.which(executable)


def tool_available(executable: str) -> bool:
    return tool_path(executable) is not None


def _wanted(cancel) -> bool:
    if cancel is None:
        return False
    if isinstance(cancel, Callable):
        return bool(cancel())
    return cancel.is_set() if isinstance(cancel, threading.Event) else bool(cancel)


def run_tool(runner: ToolRunner, executable: str, args: Sequence[str], stdin: str = "", cancel=None) -> ToolResult:
    """Run a tool. ``cancel`` is a function, an event or a truth value; a missing tool has exit code -1."""
    started = time.monotonic()
    done = lambda **x: ToolResult(executable, tuple(args), duration_ms=(time.monotonic() - started) * 1000, **x)
    try:
        process = subprocess.Popen([executable, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, env=runner.environment)
    except OSError as error:
        return done(stdout="", stderr=str(error), exit_code=-1)
    given: bytes | None = stdin.encode()
    timed_out = cancelled = False
    while True:
        try:
            out, err = process.communicate(given, timeout=runner.poll_interval)
            break
        except subprocess.TimeoutExpired:
            given = None
            cancelled = not timed_out and (cancelled or _wanted(cancel))
            timed_out = not cancelled and time.monotonic() - started >= runner.timeout
            if cancelled or timed_out:
                process.terminate()
                try:
                    out, err = process.communicate(timeout=1)
                except subprocess.TimeoutExpired:
                    process.kill()
                    out, err = process.communicate()
                break
    return done(stdout=out.decode(errors="replace"), stderr=err.decode(errors="replace"), exit_code=process.returncode, timed_out=timed_out, cancelled=cancelled)
