"""What fetches: requests with retries and a budget, feeds from safe addresses, archives unpacked safely. Not on executors."""

from __future__ import annotations

import datetime as dt
import ipaddress
import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

#: Seconds and attempts of a request, codes worth another, the longest wait, bytes and hops of a feed.
TIMEOUT, ATTEMPTS, RETRY, LONGEST, FEED_BYTES, HOPS = 20, 3, (429, 499), 10, 2_000_000, 3
#: A sync's requests and the days that it may look back.
BUDGET, LOOK_BACK = 60, (1, 14)


def get_json(url: str, headers: dict[str, str] | None = None, parameters: dict[str, str] | None = None, open_url: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> object:
    """A JSON answer; 429, 499 and 5xx are asked again, after Retry-After or a growing wait, at most 10 seconds."""
    if parameters:
        url = f"{url}?{urllib.parse.urlencode(sorted(parameters.items()))}"
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with open_url(urllib.request.Request(url, headers=headers or {}), timeout=TIMEOUT) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if attempt == ATTEMPTS or e.code not in RETRY and e.code < 500:
                raise
            wait = e.headers.get("Retry-After") if e.headers else None
            sleep(min(LONGEST, float(wait) if wait and wait.replace(".", "", 1).isdigit() else 2.0 ** (attempt - 1)))
        except (urllib.error.URLError, TimeoutError):
            if attempt == ATTEMPTS:
                raise
            sleep(min(LONGEST, 2.0 ** (attempt - 1)))
    raise AssertionError("the loop returns or raises")


def safe_url(url: str, resolve: Callable = socket.getaddrinfo) -> str:
    """url, if it is https, without user, and all its addresses are public; else an error."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme != "https" or not parts.hostname or parts.username or parts.password:
        raise ValueError("a feed's address must be https, without user")
    for entry in resolve(parts.hostname, parts.port or 443):
        if not ipaddress.ip_address(entry[4][0]).is_global:
            raise ValueError("a feed's address must be public")
    return url


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch_feed(url: str, open_url: Callable | None = None, resolve: Callable = socket.getaddrinfo) -> bytes:
    """A feed of at most 2 MB; each of at most three redirects is checked as the first address was."""
    open_url = open_url or urllib.request.build_opener(_NoRedirect).open
    for _ in range(HOPS + 1):
        try:
            with open_url(safe_url(url, resolve), timeout=TIMEOUT) as answer:
                data = answer.read(FEED_BYTES + 1)
            if len(data) > FEED_BYTES:
                raise ValueError("the feed is too large")
            return data
        except urllib.error.HTTPError as e:
            if e.code not in (301, 302, 303, 307, 308) or not e.headers.get("Location"):
                raise
            url = urllib.parse.urljoin(url, e.headers["Location"])
    raise ValueError("too many redirects")


def unpack(archive: Path, to: Path, most: int = 4 << 30) -> list[Path]:
    """The files of a zip, none outside `to` and not over `most` bytes in all."""
    to = to.resolve()
    with zipfile.ZipFile(archive) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        if sum(m.file_size for m in members) > most:
            raise ValueError("the archive is too large")
        out = [(m, (to / m.filename).resolve()) for m in members]
        if any(not p.is_relative_to(to) for _, p in out):
            raise ValueError("the archive has a file outside its folder")
        for m, p in out:
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(z.read(m))
    return [p for _, p in out]


def planned_requests(leagues: int, fixtures: int, budget: int = BUDGET) -> int:
    """Requests of a sync: a list and its fixtures for each league; an error beyond the budget."""
    n = leagues * (1 + fixtures)
    if n > budget:
        raise ValueError(f"{n} requests exceed the budget of {budget}")
    return n


def sync_window(first: dt.date | None, last: dt.date | None, days: int, today: dt.date) -> tuple[dt.date, dt.date]:
    """The days to read: those given, both and in order, or the last `days`."""
    if (first is None) != (last is None) or first and last < first:
        raise ValueError("both days are given, in order, or neither")
    if first:
        return first, last
    if not LOOK_BACK[0] <= days <= LOOK_BACK[1]:
        raise ValueError(f"a look back is of {LOOK_BACK[0]} to {LOOK_BACK[1]} days")
    return today - dt.timedelta(days - 1), today


def unique_league(leagues: list[tuple[str, str, str]], country: str, name: str) -> str:
    """The id of the one league (id, country, name) of that country and name, by trimmed case-folded text."""
    found = {i for i, c, n in leagues if (c.strip().casefold(), n.strip().casefold()) == (country.strip().casefold(), name.strip().casefold())}
    if len(found) != 1:
        raise ValueError(f"{len(found)} leagues match")
    return found.pop()
