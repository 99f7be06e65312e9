"""Configuration files: competitions of the radar, and news sources. What isn't as it must be is an error, not a row."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Kinds of news sources, and the fields of a competition.
KINDS, COMPETITION = ("expert", "media", "fan", "other"), ("code", "name", "country")
_CODE = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def _items(path: str) -> list[dict]:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise ValueError(f"{path} must be a list of objects")
    return found


def _text(item: dict, name: str) -> str:
    value = item.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} is missing of {item}")
    return value.strip()


def _once(codes: Sequence[str]) -> None:
    twice = {c for c in codes if codes.count(c) > 1}
    if twice:
        raise ValueError(f"codes come twice: {sorted(twice)}")


def competitions(spark: SparkSession, path: str) -> DataFrame:
    """code, name and country of each competition: these fields, no others."""
    items = _items(path)
    for item in items:
        if set(item) != set(COMPETITION):
            raise ValueError(f"a competition has {COMPETITION}: {item}")
    rows = [tuple(_text(item, c) for c in COMPETITION) for item in items]
    _once([r[0] for r in rows])
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COMPETITION))


def news_sources(spark: SparkSession, path: str) -> DataFrame:
    """code, display_name, source_kind, homepage_url, feed_url and is_active (true unless said) of each source; feeds are https, without user."""
    rows = []
    for item in _items(path):
        code, kind, feed, home = _text(item, "code"), _text(item, "source_kind"), _text(item, "feed_url"), (item.get("homepage_url") or "").strip() or None
        parts = urlsplit(feed)
        if not _CODE.fullmatch(code):
            raise ValueError(f"{code} is no code")
        if kind not in KINDS:
            raise ValueError(f"{code}: {kind} is none of {KINDS}")
        if parts.scheme != "https" or not parts.hostname or parts.username or parts.password:
            raise ValueError(f"{code}: a feed's address must be https, without user")
        if home and not home.startswith(("https://", "http://")):
            raise ValueError(f"{code}: {home} is no address")
        rows.append((code, _text(item, "display_name"), kind, home, feed, bool(item.get("is_active", True))))
    _once([r[0] for r in rows])
    return spark.createDataFrame(rows, "code string, display_name string, source_kind string, homepage_url string, feed_url string, is_active boolean")
