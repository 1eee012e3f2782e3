"""A run that derives and serves the public dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.operators import quality
from playbill.operators.artists import attach_artists, build_artist_index
from playbill.operators.classify import apply_genres, apply_title_en
from playbill.operators.overlap import merge_promoters
from playbill.operators.select import list_events, upcoming
from playbill.operators.venues import assign_venue_key, venue_index
from playbill.session import cut_lineage
from playbill.sinks import calendar, feed


@dataclass(frozen=True)
class Roles:
    """Which sources play which part; fixed values of the model."""

    promoters: Sequence[str] = ("sogo_tokyo", "creativeman", "smash_jpn", "udo_artists",
                                "disk_garage", "livenation_jp")
    festival: str = "festivals"
    seasonal: Sequence[str] = ("matsuri", "hanabi", "flowers")


#: festival -> venues that host it (fixed values)
FESTIVAL_HOSTS = (("summer_sonic_tokyo", "makuhari_messe"),
                  ("summer_sonic_tokyo", "zozo_marine_stadium"),
                  ("countdown_japan", "makuhari_messe"))


@dataclass(frozen=True)
class Published:
    events: DataFrame
    fates: DataFrame
    artists: Mapping[str, DataFrame]
    feed: DataFrame
    calendars: DataFrame


def publish(staged: DataFrame, registry: DataFrame, venue_aliases: DataFrame | None,
            artist_aliases: DataFrame, hosts: DataFrame, genre_cache: DataFrame,
            title_cache: DataFrame, runs: DataFrame, sources: DataFrame,
            as_of: Column, now: Column, roles: Roles = Roles(),
            match_aliases: Mapping[str, str] | None = None) -> Published:
    """Public rows still to come, with venue identity, duplicates folded,
    genres, artists and English titles; the merge comes before tagging and
    the artist index.  The date filter runs before any Python stage."""
    public = upcoming(list_events(staged, public_only=True, ordered=False), as_of)
    curated = (roles.festival, *roles.seasonal)
    keyed = assign_venue_key(public, venue_index(registry, venue_aliases), curated, roles.promoters) \
        .withColumn("ord", F.struct("start_date", "id"))
    merged, fates = merge_promoters(keyed, roles.promoters, roles.festival, hosts,
                                    match_aliases, curated)
    tagged = cut_lineage(apply_genres(merged.drop("ord", "folded"), genre_cache))
    index = build_artist_index(tagged, artist_aliases)
    events = cut_lineage(apply_title_en(attach_artists(tagged, index), title_cache)
                  .drop("uncertain", "title_queued"))
    health = quality.live_health(quality.latest_runs(runs), sources)
    inner = ("content_hash", "first_seen", "last_seen", "updated_at")
    document = feed.feed_lines(events.drop(*inner), health,
                               quality.capacity_map(events, registry), now)
    return Published(events, fates, index, document, calendar.calendar_lines(events, now))
