"""Fetching a source archive: resumed by ranges, checked to the byte. Runs on the driver, before any job."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable

#: Fixed value: how often a broken transfer is taken up again.
ATTEMPTS = 8


class DownloadError(OSError):
    pass


def _open(request: urllib.request.Request):
    return urllib.request.urlopen(request, timeout=60)


def download(url: str, path: str, *, opener: Callable = _open, chunk: int = 1 << 20, attempts: int = ATTEMPTS) -> int:
    """Fetches ``url`` into ``path`` and returns its size. The size is asked for first; what a former call
    left is gone on with by a range, which the server has to honour (206) unless it starts at 0."""
    with opener(urllib.request.Request(url, method="HEAD")) as head:
        total = int(head.headers.get("Content-Length") or 0)
    if total <= 0:
        raise DownloadError(f"{url} doesn't tell its size")
    part = f"{path}.part"
    for _ in range(attempts):
        have = os.path.getsize(part) if os.path.exists(part) else 0
        if have > total:
            os.remove(part)
            have = 0
        if have == total:
            break
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"})
        try:
            with opener(request) as answer, open(part, "ab") as out:
                if have and answer.status != 206:
                    raise DownloadError(f"{url} answered a range with status {answer.status}")
                while data := answer.read(chunk):
                    out.write(data)
        except DownloadError:
            raise
        except OSError:
            continue
    size = os.path.getsize(part) if os.path.exists(part) else 0
    if size != total:
        raise DownloadError(f"{url}: {size} of {total} bytes after {attempts} attempts")
    os.replace(part, path)
    return total
