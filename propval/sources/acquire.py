"""Acquisition on the driver: downloads with retry and checksum, a paginated API to JSON lines, the source manifest."""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from propval.sources.publish import Place, sha256, staged

RETRIES, BACKOFF_S, BLOCK = 5, 1.0, 1 << 20
RETRIED = (429, 500, 502, 503, 504)


def opened(url: str, retries: int = RETRIES, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep):
    """The response, after retries with growing waits for the statuses in RETRIED and for connection errors."""
    for k in range(retries + 1):
        try:
            return opener(url)
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or k == retries:
                raise
        except urllib.error.URLError:
            if k == retries:
                raise
        sleep(BACKOFF_S * 2**k)
    raise AssertionError("unreachable")


def download(url: str, path: str | Path, force: bool = False, expected: str | None = None, **how: object) -> bool:
    """path holds url's content; True if the cached file was good. Empty content or a wrong checksum is an error, and leaves the file as it was."""
    if not force and Place(path).exists():
        with Place(path).local() as f:
            good = f.stat().st_size and (expected is None or sha256(f) == expected)
        if good:
            return True
    with staged(path) as part:
        with opened(url, **how) as src, part.open("wb") as dst:
            while block := src.read(BLOCK):
                dst.write(block)
        if not part.stat().st_size:
            raise RuntimeError(f"{url} is empty")
        if expected is not None and (got := sha256(part)) != expected:
            raise RuntimeError(f"{url}: SHA-256 {got}, expected {expected}")
    return False


def pages(url: str | None, **how: object) -> Iterator[dict]:
    """The pages of a linked list of them: each names the next."""
    while url:
        with opened(url, **how) as r:
            page = json.load(r)
        yield page
        url = page.get("next")


def complete(key: str, url: str, **how: object) -> Iterator[dict]:
    """The rows of all pages of a key; an error at the end unless as many came as the first page promised."""
    promised, came = None, 0
    for page in pages(url, **how):
        promised = page["total"] if promised is None else promised
        came += len(page["results"])
        yield from page["results"]
    if came != promised:
        raise RuntimeError(f"{key}: {came} of {promised} rows came")


def paginated(url_of: Callable[[str], str], keys: Iterable[str], path: str | Path, force: bool = False, wanted: set[str] | None = None, member: str = "identifiant_ban", **how: object) -> dict:
    """The rows of every key as gzipped JSON lines, without their search scores; only those whose `member` is wanted are kept.
    Returns rows (kept), api_total (received) and cache_hit."""
    if not force and Place(path).exists():
        with Place(path).local() as f, gzip.open(f, "rt", encoding="utf-8") as lines:
            return {"rows": sum(1 for _ in lines), "api_total": None, "cache_hit": True}
    kept = total = 0
    with staged(path) as part, gzip.open(part, "wt", encoding="utf-8") as out:
        for key in keys:
            for row in complete(key, url_of(key), **how):
                total += 1
                if wanted is None or row.get(member) in wanted:
                    out.write(json.dumps({k: v for k, v in row.items() if k != "_score"}, ensure_ascii=False, sort_keys=True) + "\n")
                    kept += 1
    return {"rows": kept, "api_total": total, "cache_hit": False}


def manifest_record(source_id: str, producer: str, license_name: str, url: str, path: str | Path, root: str | Path, **extra: object) -> dict:
    path = Path(path)
    return {
        "id": source_id,
        "producer": producer,
        "license": license_name,
        "url": url,
        "path": path.relative_to(root).as_posix(),
        "retrieved_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "bytes": path.stat().st_size,
        "sha256": sha256(path),
        **extra,
    }


__all__ = ["download", "manifest_record", "opened", "paginated"]
