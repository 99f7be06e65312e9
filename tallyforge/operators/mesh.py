"""Facts from several sources: keys, date clusters, identities, reconciliation, crosswalks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import CRITICAL
from ..functions.shared import written
from ..functions.text import player_name, team_name, within_days

#: Confidence of one source; of agreement, by further source, at most; of a conflict.
SINGLE, AGREED, MORE, MOST, CONFLICT = 0.35, 0.60, 0.10, 0.95, 0.20
#: Fixed value: days between a cluster's first date and its last.
TOLERANCE = 1
#: Fixed values: (source, its own id, competition).
COMPETITIONS = (
    ("thesportsdb", "4406", "ARG_LPF"), ("thesportsdb", "4328", "ENG_PL"), ("thesportsdb", "4335", "ESP_LL"), ("thesportsdb", "4332", "ITA_SA"), ("thesportsdb", "4331", "GER_BL1"), ("thesportsdb", "4334", "FRA_L1"),
    ("thesportsdb", "4337", "NED_ED"), ("thesportsdb", "4344", "POR_PL"), ("thesportsdb", "4351", "BRA_A"), ("thesportsdb", "4346", "USA_MLS"), ("openligadb", "bl1", "GER_BL1"),
    ("football-data-org", "PL", "ENG_PL"), ("football-data-org", "PD", "ESP_LL"), ("football-data-org", "SA", "ITA_SA"), ("football-data-org", "BL1", "GER_BL1"), ("football-data-org", "FL1", "FRA_L1"), ("football-data-org", "DED", "NED_ED"),
    ("football-data-org", "PPL", "POR_PL"), ("football-data-org", "BSA", "BRA_A"), ("football-data-uk", "E0", "ENG_PL"), ("football-data-uk", "SP1", "ESP_LL"), ("football-data-uk", "I1", "ITA_SA"), ("football-data-uk", "D1", "GER_BL1"),
    ("football-data-uk", "F1", "FRA_L1"), ("football-data-uk", "N1", "NED_ED"), ("football-data-uk", "P1", "POR_PL"), ("openfootball", "en.1.json", "ENG_PL"), ("wyscout-open", "364", "ENG_PL"), ("statsbomb-open", "2", "ENG_PL"),
    ("wyscout-open", "795", "ESP_LL"), ("statsbomb-open", "11", "ESP_LL"),
)
#: Facts of two sources that compare exactly, and those that don't compare: (granularity, metrics).
EXACT = (
    ("match", ("home_score", "away_score", "round_name")), ("player_appearance", ("started",)), ("player_match", ("goals", "non_penalty_goals")),
    ("team_match", ("goals_for", "goals_against", "home_away")), ("goalkeeper_match", ("clean_sheets",)),
)
NOT_COMPARABLE = (
    ("player_match", ("touches", "duels_total", "ground_duels", "passes_total", "passes_accurate", "pass_completion_pct")), ("team_match", ("passes_total", "passes_accurate", "pass_accuracy_pct", "offsides")),
    ("goalkeeper_match", ("passes", "distribution_accuracy_pct")),
)


#: The versions that the policies were reviewed at.
REVIEWED = {"statsbomb-open": "statsbomb-open-v0.4", "wyscout-open": "wyscout-open-v0.2"}
#: Kinds of sources whose values count.
OBJECTIVE = ("objective_structured", "objective_official", "objective_web")


def policies(spark: SparkSession, first: str = "statsbomb-open", second: str = "wyscout-open", versions: Mapping[str, str] | None = None) -> DataFrame:
    """sources (sorted array of source@version), metric, granularity, comparable: 22 rows.

    A policy holds for the versions that it was reviewed at (of the two sources
    named by default: REVIEWED), and for no other; a source without one is named alone.
    """
    versions = REVIEWED if versions is None else versions
    pair = sorted(f"{s}@{versions[s]}" if s in versions else s for s in (first, second))
    rows = [(pair, m, g, fine) for fine, groups in ((True, EXACT), (False, NOT_COMPARABLE)) for g, metrics in groups for m in metrics]
    return spark.createDataFrame(rows, "sources array<string>, metric string, granularity string, comparable boolean")


def resolve_competitions(rows: DataFrame, source: str = "source", external: str = "external_id") -> DataFrame:
    """rows with competition, or null where the table doesn't say; nothing is guessed."""
    known = rows.sparkSession.createDataFrame(list(COMPETITIONS), f"{source} string, {external} string, competition string")
    return rows.join(F.broadcast(known), [source, external], "left")  # 31 rows


def team_key(competition: Column, name: Column) -> Column:
    own = team_name(name)
    return F.when(competition.isNotNull() & (own != ""), F.concat_ws(":", F.lit("team"), competition, own))


def match_key(competition: Column, season: Column, home: Column, away: Column, date: Column) -> Column:
    """Both teams, distinct, and the date; else null."""
    fine = home.isNotNull() & away.isNotNull() & (home != away) & date.isNotNull() & competition.isNotNull() & season.isNotNull()
    return F.when(fine, F.concat_ws(":", F.lit("match"), competition, season, home, away, F.date_format(date, "yyyy-MM-dd")))


def fact_key(granularity: Column, competition: Column, season: Column, match: Column, team: Column, player: Column) -> Column:
    """The key of a fact at its granularity; null if a part that it needs is missing or blank."""
    def part(c):
        return F.when(F.trim(c) != "", c)

    competition, season, match, team, player = map(part, (competition, season, match, team, player))

    def key(name, *parts):
        fine = parts[0].isNotNull()
        for p in parts[1:]:
            fine = fine & p.isNotNull()
        return F.when((granularity == name) & fine, F.concat_ws(":", F.lit(name.replace("_", "-")), *parts))

    return F.coalesce(
        key("competition", competition), F.when(granularity == "team", team), F.when(granularity == "match", match), key("team_match", match, team), key("player_appearance", match, player),
        key("player_match", match, player), key("player_season", competition, season, player), key("goalkeeper_match", match, player), key("goalkeeper_season", competition, season, player))


def date_clusters(rows: DataFrame, keys: Sequence[str], date: str, tolerance: int = TOLERANCE) -> DataFrame:
    """rows with cluster: the first date of its cluster. A new one begins more than `tolerance` days after the last one's FIRST date, so clusters don't chain.

    Distinct dates of a key are folded in order; a key has as many as a calendar, whatever its rows.
    """
    days = rows.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(date).cast("date"))).alias("_days"))
    start = F.array().cast("array<struct<day:date,first:date>>")

    def fold(done, day):
        last = F.try_element_at(done, F.lit(-1))["first"]
        first = F.when(last.isNotNull() & within_days(day, last, tolerance), last).otherwise(day)
        return F.concat(done, F.array(F.struct(day.alias("day"), first.alias("first"))))

    only = F.get("_days", F.lit(0))
    clusters = F.when(F.size("_days") == 1, F.array(F.struct(only.alias("day"), only.alias("first")))).otherwise(F.aggregate("_days", start, fold))  # most keys have one
    named = days.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.explode(clusters).alias("c")).select("*", F.col("c.day").alias("_day"), F.col("c.first").alias("cluster")).drop("c")
    on = F.col(date).cast("date") == F.col("_day")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(named, on, "left").select(*rows.columns, "cluster")


def comparable_value(kind: Column, number: Column, text: Column, flag: Column) -> Column:
    """One text for each value: whole and decimal numbers are one class, flags and texts others."""
    return F.when(kind == "bool", F.concat(F.lit("bool:"), flag.cast("string"))).when(kind.isin("int", "float"), F.concat(F.lit("num:"), number.cast("double").cast("string"))).otherwise(F.concat(F.lit("str:"), text))


def usable(observations: DataFrame) -> Column:
    """Whether an observation's value counts: it is known, and of an objective source where source_type is a column."""
    fine = F.col("value").isNotNull()
    return fine & F.coalesce(F.col("source_type").isin(*OBJECTIVE), F.lit(False)) if "source_type" in observations.columns else fine


def latest_by_source(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each source's newest usable value of a fact: keys, source, value (null: none), observed_at, and its versions. Ties go to the larger value."""
    fine = usable(observations)
    versions = [F.min(F.when(fine, F.col("version"))).alias("version"), F.max(F.when(fine, F.col("version"))).alias("_version")] if "version" in observations.columns else []
    return observations.groupBy(*keys, "source").agg(F.max_by("value", F.when(fine, F.struct("observed_at", "value"))).alias("value"), F.max(F.when(fine, F.col("observed_at"))).alias("observed_at"), *versions)


def _resolved(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    fine = F.lit(True)
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    return observations.where(fine)


def resolution_report(observations: DataFrame, key: str = "fact_key", granularity: str = "granularity") -> DataFrame:
    """resolved, unresolved and missing_granularity: how many observations have a fact's key, have none, or lack a granularity (and are counted there alone)."""
    grain, known = F.col(granularity).isNotNull(), F.col(key).isNotNull()
    return observations.agg(F.count_if(grain & known).alias("resolved"), F.count_if(grain & ~known).alias("unresolved"), F.count_if(~grain).alias("missing_granularity"))


def reconcile(observations: DataFrame, keys: Sequence[str] = ("fact_key", "metric", "granularity"), priority: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """keys, status, confidence, sources, value, winner.

    Newest usable value of each source first. No source: unresolved. One:
    single_source. Equal values: agreed, with more confidence by source. Else
    conflict: values are never averaged; `priority` (metric: sources, best
    first) names the value to show, which doesn't settle it. Observations
    without a key are in no fact; resolution_report() counts them.
    """
    each = latest_by_source(_resolved(observations, keys), keys)
    ranks = [(m, s, i) for m, own in (priority or {}).items() for i, s in enumerate(own)]
    if ranks:
        each = each.join(F.broadcast(each.sparkSession.createDataFrame(ranks, "metric string, source string, _rank int")), ["metric", "source"], "left")  # a caller's list
    else:
        each = each.withColumn("_rank", F.lit(None).cast("int"))
    there = F.col("value").isNotNull()
    found = each.groupBy(*keys).agg(
        F.count("value").alias("sources"), F.count_distinct("value").alias("_values"), F.min_by("value", F.when(there, F.col("source"))).alias("_value"), F.min(F.when(there, F.col("source"))).alias("_source"),
        F.min_by(F.struct("value", "source"), F.when(there, F.col("_rank"))).alias("_best"))
    status = F.when(F.col("sources") == 0, "unresolved").when(F.col("sources") == 1, "single_source").when(F.col("_values") == 1, "agreed").otherwise("conflict")
    confidence = F.when(status == "single_source", SINGLE).when(status == "agreed", F.least(F.lit(MOST), AGREED + MORE * (F.col("sources") - 1))).when(status == "conflict", CONFLICT).otherwise(0.0)
    value = F.when(status.isin("single_source", "agreed"), F.col("_value")).when(status == "conflict", F.col("_best.value"))
    winner = F.when(status == "single_source", F.col("_source")).when(status == "conflict", F.col("_best.source"))
    return found.select(*keys, status.alias("status"), F.round(confidence, 6).alias("confidence"), "sources", value.alias("value"), winner.alias("winner"))


def reconcile_by_policy(observations: DataFrame, policy: DataFrame, keys: Sequence[str] = ("fact_key", "metric", "granularity")) -> DataFrame:
    """As reconcile(), but two sources compare only where a policy of their versions says so.

    Two sources without a policy, more than two, or a source whose version changes
    within the fact: methodology_pending. A policy that says no: not_comparable.
    Both have no confidence and no value. Observations without a key or a
    granularity are in no fact; resolution_report() counts them.
    """
    each = latest_by_source(_resolved(observations, keys), keys)
    versioned = "version" in observations.columns
    there = F.col("value").isNotNull()
    name = F.when(F.col("version").isNull(), F.col("source")).otherwise(F.concat_ws("@", "source", "version")) if versioned else F.col("source")
    own = [F.coalesce(F.max(F.col("version") != F.col("_version")), F.lit(False)).alias("_mixed")] if versioned else [F.lit(False).alias("_mixed")]
    found = each.groupBy(*keys).agg(F.count("value").alias("sources"), F.count_distinct("value").alias("_values"), F.min_by("value", F.when(there, F.col("source"))).alias("_value"), F.array_sort(F.collect_set(F.when(there, name))).alias("_pair"), *own)
    rules = policy.select(F.col("sources").alias("_sources"), F.col("metric").alias("_m"), F.col("granularity").alias("_g"), "comparable")
    joined = found.join(F.broadcast(rules), (F.col("_pair") == F.col("_sources")) & (F.col("metric") == F.col("_m")) & (F.col("granularity") == F.col("_g")), "left")  # 22 rows
    status = (F.when(F.col("sources") == 0, "unresolved").when(F.col("sources") == 1, "single_source").when((F.col("sources") > 2) | F.col("_mixed") | F.col("comparable").isNull(), "methodology_pending")
              .when(~F.col("comparable"), "not_comparable").when(F.col("_values") == 1, "agreed").otherwise("conflict"))
    confidence = F.when(status == "single_source", SINGLE).when(status == "agreed", AGREED + MORE).when(status == "conflict", CONFLICT).otherwise(0.0)
    return joined.select(*keys, status.alias("status"), F.round(confidence, 6).alias("confidence"), "sources", F.when(status.isin("single_source", "agreed"), F.col("_value")).alias("value"))


def contradictions(rows: DataFrame, identity: Sequence[str], value: str = "value") -> DataFrame:
    """Identities with several values: an adapter that emits any must fail."""
    return rows.groupBy(*identity).agg(F.count_distinct(value).alias("values")).where("values > 1")


def crosswalk(appearances: DataFrame) -> DataFrame:
    """canonical, source, player, matches of people that two sources both name alike, once, in the same team of the same match.

    appearances: source, player, name, match_key, team_key. A slot (match, team,
    name) counts where it holds one player of each source; a pair that any slot
    contradicts, on either side, is dropped. canonical is the hash of both
    references. Slots are grouped, never paired.
    """
    a = appearances.withColumn("_name", player_name(F.col("name"))).where("_name <> '' and match_key is not null and team_key is not null")
    slots = a.groupBy("match_key", "team_key", "_name", "source").agg(F.min("player").alias("p"), F.max("player").alias("q"))
    both = slots.groupBy("match_key", "team_key", "_name").agg(F.array_sort(F.collect_list(F.struct("source", "p", "q"))).alias("s")).where(F.size("s") == 2).where(F.forall("s", lambda x: x["p"] == x["q"]))
    pairs = both.select("match_key", "team_key", "_name", F.get("s", F.lit(0))["source"].alias("s1"), F.get("s", F.lit(0))["p"].alias("p1"), F.get("s", F.lit(1))["source"].alias("s2"), F.get("s", F.lit(1))["p"].alias("p2"))
    grouped = written(pairs.groupBy("s1", "p1", "s2", "p2").agg(F.count_distinct("_name").alias("names"), F.count_distinct("match_key").alias("matches")), "pairs")
    one = grouped.groupBy("s1", "p1", "s2").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    two = grouped.groupBy("s1", "s2", "p2").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    kept = grouped.where("names = 1").join(one, ["s1", "p1", "s2"], "left_semi").join(two, ["s1", "s2", "p2"], "left_semi")
    refs = F.array_sort(F.array(F.concat_ws(":", "s1", "p1"), F.concat_ws(":", "s2", "p2")))
    return kept.select(F.sha2(F.array_join(refs, "|"), 256).alias("canonical"), F.inline(F.array(F.struct(F.col("s1").alias("source"), F.col("p1").alias("player")), F.struct(F.col("s2").alias("source"), F.col("p2").alias("player")))), "matches")


def overlap(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and where: shared, first_only or second_only."""
    a, b = first.select(*keys).distinct().withColumn("_a", F.lit(True)), second.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, list(keys), "full").select(*keys, F.when(F.col("_a") & F.col("_b"), "shared").when(F.col("_a"), "first_only").otherwise("second_only").alias("where"))


def mentions(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """texts' id, and the id of each name that stands in the text between word boundaries. Names of under 4 letters or shared by several ids don't count.

    Names are met by their longest word among the text's words, which few texts
    have, and only then compared: an equi-join in place of every name against every text.
    """
    from ..functions.text import folded

    n = names.withColumn("_name", folded(F.col(name))).where(F.length("_name") >= 4)
    n = n.groupBy("_name").agg(F.min("name_id").alias("name_id"), F.count_distinct("name_id").alias("_n")).where("_n = 1").withColumn("_word", F.array_max(F.transform(F.regexp_extract_all("_name", F.lit(r"(\w+)")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).where("_word is not null")
    t = texts.withColumn("_text", folded(F.col(text)))
    words = t.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(\w+)")))).alias("_word"))
    met = words.join(n.select("name_id", "_name", "_word"), "_word").select("text_id", "name_id", "_name")
    joined = met.join(t.select("text_id", "_text"), "text_id")
    padded = F.concat(F.lit(" "), F.regexp_replace("_text", r"\W+", " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.trim(F.regexp_replace("_name", r"\W+", " ")), F.lit(" "))
    return joined.where(F.contains(padded, wanted)).select("text_id", "name_id").distinct()


# -- coverage -------------------------------------------------------------------------

def coverage_state(reliability: Column, token: Column, probe: Column, role: Column, sample: Column, observed: Column, current: Column) -> Column:
    """unsupported, token_required, not_probed, missing, previous_season, partial, historical_only or current_available, in the rules' order.

    reliability: full or partial, null where the provider doesn't report the
    metric. token: whether a needed token is missing. probe: ok, not_attempted,
    skipped_token_required, error or null. role: current or historical.
    observed of sample rows have the metric. current: whether the probe is of
    this season.
    """
    n, seen = F.coalesce(sample, F.lit(0)), F.coalesce(observed, F.lit(0))
    return (F.when(reliability.isNull(), "unsupported").when(F.coalesce(token, F.lit(False)), "token_required").when(probe.isNull() | (probe == "not_attempted"), "not_probed").when(probe == "skipped_token_required", "token_required")
            .when(probe == "error", "not_probed").when((n == 0) | (seen == 0), "missing").when((role == "current") & ~F.coalesce(current, F.lit(True)), "previous_season").when(seen < n, "partial")
            .when(role == "historical", "historical_only").when(reliability == "full", "current_available").otherwise("partial"))


#: The states that satisfy a requirement of a provider's role.
SATISFYING = {"current": ("current_available",), "historical": ("historical_only",)}


def requirements(entries: DataFrame, wanted: DataFrame, role: str = "current", states: Sequence[str] | None = None, keys: Sequence[str] = ("competition", "granularity", "metric")) -> DataFrame:
    """wanted (keys) with satisfied, gap_key and critical: whether any provider of the role has each requirement in a state that counts.

    critical marks gaps of the metrics that matter most, for the present only.
    """
    states = SATISFYING[role] if states is None else states
    have = entries.where(F.col("role") == role).groupBy(*keys).agg(F.bool_or(F.col("state").isin(*states)).alias("_has"))
    joined = wanted.select(*keys).distinct().join(have, list(keys), "left").withColumn("satisfied", F.coalesce("_has", F.lit(False))).drop("_has")
    gap = F.when(~F.col("satisfied"), F.concat_ws(":", *keys))
    return joined.withColumn("gap_key", gap).withColumn("critical", ~F.col("satisfied") & F.lit(role == "current") & F.col("metric").isin(*CRITICAL))


def recent_requirements(entries: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("competition", "granularity", "metric")) -> DataFrame:
    """requirements() that evidence of the last complete season alone satisfies; it never counts as present."""
    return requirements(entries, wanted, "current", ("previous_season",), keys).withColumn("critical", F.lit(False))


def coverage_fraction(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, numerator, denominator, gap_keys and critical_gap_keys (sorted) of requirements()."""
    return rows.groupBy(*by).agg(F.count_if("satisfied").alias("numerator"), F.count("*").alias("denominator"), F.array_sort(F.collect_list("gap_key")).alias("gap_keys"), F.array_sort(F.collect_list(F.when(F.col("critical"), F.col("gap_key")))).alias("critical_gap_keys"))


def probe_summary(observations: DataFrame) -> DataFrame:
    """source, metric, granularity, observed and sample: each metric's rows, over what its grain can have.

    observations: source, entity_type (match, team, player, goalkeeper),
    entity_id, match_id, metric. Metrics of matches are over the source's
    matches, those of teams over its distinct (team, match) slots, those of
    players over the entities that the metric was seen of.
    """
    kind = F.col("entity_type")
    totals = observations.groupBy("source").agg(F.count_distinct(F.when(kind == "match", F.col("entity_id"))).alias("_matches"), F.count_distinct(F.when((kind == "team") & F.col("match_id").isNotNull(), F.struct("entity_id", "match_id"))).alias("_slots"))
    each = observations.groupBy("source", "entity_type", "metric").agg(F.count("*").alias("observed"), F.count_distinct("entity_id").alias("_entities"))
    grain = F.when(kind == "match", "match").when(kind == "team", "team_match").when(kind == "goalkeeper", "goalkeeper_match").otherwise("player_match")
    sample = F.when(kind == "match", F.col("_matches")).when(kind == "team", F.col("_slots")).otherwise(F.col("_entities"))
    return each.join(totals, "source").select("source", "metric", grain.alias("granularity"), "observed", sample.alias("sample"))
