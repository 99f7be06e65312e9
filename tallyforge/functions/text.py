"""Scalar functions of text, dates and numbers, as columns; the few that Spark lacks as Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with marks and the plain letters that they fold to.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)

#: Words of club names that say nothing, and names that stand for others.
TEAM_STOPWORDS = ("fc", "afc", "sc", "sv", "tsg", "vfb", "vfl", "bsc", "spvgg", "ev", "rc", "ud")
TOKEN_ALIASES = {"munich": "munchen"}
NAME_ALIASES = {
    "brighton": "brighton hove albion", "leeds": "leeds united", "man city": "manchester city", "man united": "manchester united", "newcastle": "newcastle united",
    "nott'm forest": "nottingham forest", "tottenham": "tottenham hotspur", "west ham": "west ham united", "wolves": "wolverhampton wanderers", "celta vigo": "celta de vigo",
}
#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid")
#: Positions and their families and roles.
FAMILIES = {
    "GK": "goalkeeper", "CB": "centre_back", "RB": "fullback_wingback", "LB": "fullback_wingback", "RWB": "fullback_wingback", "LWB": "fullback_wingback", "CDM": "defensive_midfielder", "DM": "defensive_midfielder", "CM": "central_midfielder",
    "CAM": "attacking_midfielder", "AM": "attacking_midfielder", "RW": "winger", "LW": "winger", "RM": "winger", "LM": "winger", "ST": "forward", "CF": "forward", "FW": "forward",
}
ROLES = {
    "G": "goalkeeper", "GK": "goalkeeper", "GOALKEEPER": "goalkeeper", "D": "defender", "DEF": "defender", "DEFENDER": "defender", "M": "midfielder", "MID": "midfielder", "MIDFIELDER": "midfielder", "F": "forward", "FW": "forward", "FORWARD": "forward",
}


def mapped(key: Column, values: dict[str, str]) -> Column:
    """values[key], or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def folded(text: Column) -> Column:
    """Lower case, Latin marks dropped, white space collapsed. Built-in functions only; folded_fully() covers every script."""
    low = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(F.translate(low, _MARKED, _PLAIN), r"\s+", " "))


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once a row however often `then` names it.

    The optimizer puts an expression in each place that names it, also where
    that is a condition, which shares nothing; a lambda's variable it leaves.
    """
    return F.get(F.transform(F.array(x), then), F.lit(0))


@F.pandas_udf(T.StringType())
def folded_fully(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, case-folded, white space collapsed."""
    def one(x):
        return None if x is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold().split())

    return text.map(one)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def team_name(raw: Column) -> Column:
    """Tokens of a club's name without stopwords and numbers, sorted; short names are spelt out first."""
    low = folded(raw)
    spelt = F.coalesce(mapped(low, NAME_ALIASES), low)
    kept = F.filter(tokens(F.regexp_replace(spelt, r"[^a-z0-9\s]", " ")), lambda t: ~t.isin(*TEAM_STOPWORDS) & ~t.rlike(r"^\d+$"))
    return F.array_join(F.array_sort(F.transform(kept, lambda t: F.coalesce(mapped(t, TOKEN_ALIASES), t))), " ")


def player_name(raw: Column) -> Column:
    """A person's name without marks and punctuation, in its own order; empty where there is none."""
    low = F.regexp_replace(folded(F.coalesce(raw, F.lit(""))), r"[.\-'’,]", " ")
    return F.array_join(tokens(F.regexp_replace(low, r"[^0-9a-z ]+", " ")), " ")


def unescaped_twice(text: Column) -> Column:
    """Text in which \\uXXXX was escaped once too often, repaired; other text as it is."""
    read = F.from_json(F.concat(F.lit('{"x":"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"}')), "x string").getField("x")
    return F.when(text.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(read, text)).otherwise(text)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default ports, tracking parameters and fragment dropped, parameters sorted; null unless absolute HTTP(S) without user."""
    url = F.trim(url)
    scheme, host, user = (F.lower(F.try_parse_url(url, F.lit(p))) for p in ("PROTOCOL", "HOST", "USERINFO"))
    port = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:(\d+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.try_parse_url(url, F.lit("PATH"))
    pairs = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|" + "|".join(TRACKING) + r")(=|$)"))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    out = F.concat(scheme, F.lit("://"), host, shown, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & host.isNotNull() & user.isNull(), out)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of folded parts."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(folded(p), F.lit("")) for p in parts)), 256)


def pair_key(refs: Column) -> Column:
    """SHA-256 of an array's sorted references."""
    return F.sha2(F.array_join(F.array_sort(refs), "|"), 256)


#: The entities that plain_html() reads, in its order.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_html(html: Column) -> Column:
    """Text of simple markup: scripts, styles, comments and tags dropped, the common entities read, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, c in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text of any markup, with all entities."""
    def one(x):
        if x is None:
            return None
        parser = _Text()
        parser.feed(x)
        parser.close()
        return " ".join(" ".join(parser.out).split())

    return html.map(one)


def utc_timestamp(text: Column) -> Column:
    """ISO 8601 with Z, an offset or neither (then UTC; the session's zone is UTC), or RFC 822; null if it's none."""
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UT|UTC)$", "+0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm Z")))


def season_label(text: Column) -> Column:
    """2025 and 2526 as 2025-2026; labels of two years as they are; else null."""
    def label(first: Column) -> Column:
        return F.when(first.isNotNull(), F.concat_ws("-", first.cast("string"), (first + 1).cast("string")))

    def first(text: Column) -> Column:
        year = F.when(text.rlike(r"^\d{4}$"), text.cast("int"))
        short = F.when(text.rlike(r"^\d{4}$") & ((year % 100) == ((year / 100).cast("int") + 1) % 100) & ~text.rlike(r"^(19|20)\d\d$"), 2000 + (year / 100).cast("int"))
        long = F.regexp_extract(text, r"^(\d{4})[-/](\d{2}|\d{4})$", 1)
        return F.coalesce(short, year, F.when(long != "", long.cast("int")))

    return once(once(F.trim(text), first), label)


def lenient_int(text: Column) -> Column:
    """A number's whole part; null if it's none."""
    return lenient_number(text).cast("int")


def lenient_number(text: Column) -> Column:
    """'55%' and ' 12.5 ' as numbers; else null."""
    return F.try_variant_get(F.try_parse_json(F.regexp_replace(F.trim(text), r"\s*%$", "")), "$", "double")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays [x, y]."""
    return F.sqrt(F.pow(a[0] - b[0], F.lit(2)) + F.pow(a[1] - b[1], F.lit(2)))


def position_family(position: Column) -> Column:
    return mapped(F.upper(F.trim(position)), FAMILIES)


def position_role(position: Column) -> Column:
    return mapped(F.upper(F.trim(position)), ROLES)


def within_days(a: Column, b: Column, days: int = 1) -> Column:
    return F.abs(F.datediff(a, b)) <= days
