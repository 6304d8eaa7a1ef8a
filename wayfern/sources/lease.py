"""A lease on work that one process may do at a time, with fencing.

A lease is a file that ends at its expiry, so that a holder that has died is
followed by another one; each holder gets a higher token, and whoever writes
checks its token, so that a holder that was only slow does not write after its
follower.  Files lie in a folder of the driver, are made whole by link and
never changed but by their holder.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from contextlib import contextmanager
from pathlib import Path


class Held(RuntimeError):
    """Another holder has the lease."""


class Fenced(RuntimeError):
    """The lease has ended or has another holder by now."""


def create_whole(path: Path, text: str) -> bool:
    """Make a file that is there whole or not at all; false if it is there already."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(text)
    try:
        os.link(part, path)
    except FileExistsError:
        return False
    finally:
        part.unlink()
    return True


def replace_whole(path: Path, text: str) -> None:
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(text)
    os.replace(part, path)


def numbered(folder: Path, pattern: str) -> list[int]:
    """Numbers of the files ``pattern`` (with one ``*``), ascending."""
    head, tail = pattern.split("*")
    return sorted(int(n) for p in folder.glob(pattern) if (n := p.name[len(head) : len(p.name) - len(tail)]).isdigit())


class Lease:
    def __init__(self, folder: str, name: str = "lease", ttl_ms: int = 60_000, clock=lambda: int(time.time() * 1000)):
        self.folder, self.name, self.ttl_ms, self.clock = Path(folder), name, ttl_ms, clock
        self.token: int | None = None

    def _file(self, token: int) -> Path:
        return self.folder / f"{self.name}.{token}"

    def _last(self) -> tuple[int, dict]:
        tokens = numbered(self.folder, f"{self.name}.*")
        return (tokens[-1], json.loads(self._file(tokens[-1]).read_text())) if tokens else (0, {"holder": None, "expires_at_ms": 0})

    def acquire(self, holder: str) -> int:
        """A token higher than any before; ``Held`` while another's lease lasts."""
        last, state = self._last()
        if state["expires_at_ms"] > self.clock():
            raise Held(state["holder"])
        mine = json.dumps({"holder": holder, "expires_at_ms": self.clock() + self.ttl_ms})
        if not create_whole(self._file(last + 1), mine):
            raise Held("another one was first")
        self.token = last + 1
        for old in numbered(self.folder, f"{self.name}.*")[:-2]:  # the last two are enough to go on counting
            self._file(old).unlink(missing_ok=True)
        return self.token

    def check(self) -> int:
        """The token, if the lease is still this one's; ``Fenced`` otherwise."""
        last, state = self._last()
        if self.token is None or last != self.token or state["expires_at_ms"] <= self.clock():
            raise Fenced(f"token {self.token}, last {last}")
        return self.token

    def renew(self) -> None:
        token = self.check()
        state = json.loads(self._file(token).read_text())
        replace_whole(self._file(token), json.dumps(state | {"expires_at_ms": self.clock() + self.ttl_ms}))

    def release(self) -> None:
        """End the lease, if it is still this one's."""
        if self.token is not None and self._last()[0] == self.token:
            replace_whole(self._file(self.token), json.dumps({"holder": None, "expires_at_ms": 0}))
        self.token = None

    @contextmanager
    def held(self, holder: str):
        self.acquire(holder)
        try:
            yield self
        finally:
            self.release()
