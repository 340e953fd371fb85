"""Random reads of bytes: from any file system, or from an HTTP server that serves ranges.

A source has ``size`` and ``read(offset, n)``, which gives n bytes or those up to the end.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

#: A resolved address is asked for again after so many seconds.
FRESH_SECONDS = 600


class Source(Protocol):
    size: int

    def read(self, offset: int, n: int) -> bytes: ...

    def close(self) -> None: ...


class FileRange:
    """A file of a local, Hadoop or object store, by path or URI."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        self._file = system.open_input_file(name)
        self.size = self._file.size()

    def read(self, offset: int, n: int) -> bytes:
        return self._file.read_at(max(0, min(n, self.size - offset)), offset) if offset < self.size else b""

    def close(self) -> None:
        self._file.close()


class HttpRange:
    """Ranges of a file behind an HTTP address: redirections are followed and remembered, failures and short answers tried again."""

    def __init__(self, url: str, token: str | None = None, retries: int = 5, wait: Callable[[float], None] = time.sleep, timeout: float = 300):
        self.url, self.token, self.retries, self.wait, self.timeout = url, token, retries, wait, timeout
        self._at, self._since = None, 0.0
        self.size = self._resolved()

    def _request(self, url: str, method: str, **headers: str):
        # the token is for the named server, not for where it sends one to
        own = {"Authorization": f"Bearer {self.token}"} if self.token and url.startswith(self.url) else {}
        return urllib.request.urlopen(urllib.request.Request(url, method=method, headers=headers | own), timeout=self.timeout)

    def _resolved(self) -> int:
        with self._request(self.url, "HEAD") as r:
            self._at, self._since = r.url, time.monotonic()
            return int(r.headers["Content-Length"])

    def _address(self) -> str:
        if self._at is None or time.monotonic() - self._since > FRESH_SECONDS:
            try:
                self._resolved()
            except (OSError, urllib.error.URLError):
                return self.url
        return self._at or self.url

    def read(self, offset: int, n: int) -> bytes:
        last = min(offset + n, self.size) - 1
        if n <= 0 or last < offset:
            return b""
        trouble: Exception | None = None
        for attempt in range(self.retries):
            try:
                with self._request(self._address(), "GET", Range=f"bytes={offset}-{last}") as r:
                    data = r.read()
                if len(data) == last - offset + 1:
                    return data
                trouble = OSError(f"{len(data)} bytes instead of {last - offset + 1}")
            except (OSError, urllib.error.URLError) as e:
                trouble = e
            self._at = None  # it may have expired
            if attempt + 1 < self.retries:
                self.wait(min(2**attempt, 30))
        raise OSError(f"bytes {offset} to {last} of {self.url} could not be read: {trouble}")

    def close(self) -> None:
        self._at = None


def open_source(path: str, mount: str | None = None, base_url: str | None = None, token: str | None = None) -> Source:
    """The file under the mount if it is there, else from the server, else by its own path."""
    if mount:
        try:
            return FileRange(f"{mount.rstrip('/')}/{path}")
        except OSError:
            pass
    if base_url:
        return HttpRange(f"{base_url.rstrip('/')}/{path}", token)
    return HttpRange(path, token) if path.startswith(("http://", "https://")) else FileRange(path)
