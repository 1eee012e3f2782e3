"""Same show, two sources: overlap tests, folds and festival windows.

Rows are never paired inside a (date, venue).  Titles and names become *part*
strings; the containment join finds which part strings overlap; what a row
needs (its first partner, its component) is then an aggregate over parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import every_day
from playbill.functions.text import match_key, match_keys, name_key, needle_floor
from playbill.operators.containment import contained_pairs
from playbill.operators.firstfit import IN_ORDER, SHORTEST_NAME, first_fit
from playbill.operators.ranking import null_safe_join
from playbill.operators.select import union_links
from playbill.schema import LINKS
from playbill.session import cut_lineage, sized_broadcast

GROUP = ("start_date", "venue_key")
FILLS = ("open_time", "start_time", "price_text", "price_min", "is_free", "ticket_url")


def parts_of(rows: DataFrame, aliases: Mapping[str, str] | None = None,
             extra: Sequence[str] = ()) -> DataFrame:
    """(group, id, ord, source, part, is_title): every title and line-up name
    in match form.  Folding happens once, here."""
    titles = F.array(match_key(F.col("title_ja"), aliases), match_key(F.col("title_en"), aliases))
    names = match_keys(F.coalesce("lineup", F.array().cast("array<string>")), aliases)

    def tag(parts: Column, is_title: bool) -> Column:
        return F.transform(parts, lambda p: F.struct(p.alias("part"),
                                                     F.lit(is_title).alias("is_title")))

    return rows.select(*GROUP, "id", "ord", "source", *extra,
                       F.explode(F.array_distinct(F.concat(tag(titles, True), tag(names, False))))
                       .alias("_p")) \
        .select(*GROUP, "id", "ord", "source", *extra, "_p.part", "_p.is_title") \
        .filter("part <> ''")


def _searchable(parts: DataFrame) -> DataFrame:
    """Parts a venue row may be looked for by: names from three characters,
    titles from three with kana or ideographs and four without."""
    floor = F.when(F.col("is_title"), needle_floor(F.col("part"))).otherwise(SHORTEST_NAME)
    return parts.filter(F.length("part") >= floor)


def overlapping_parts(promo: DataFrame, venue: DataFrame) -> DataFrame:
    """Distinct (group, p_part, v_part, by): ``promo`` when the promoter's
    part lies inside the venue's, ``venue`` the other way round."""
    forward = contained_pairs(
        promo.select(*GROUP, F.col("part").alias("p_part")),
        venue.select(*GROUP, F.col("part").alias("v_part")), GROUP, "p_part", "v_part")
    backward = contained_pairs(
        _searchable(venue).select(*GROUP, F.col("part").alias("v_part")),
        promo.select(*GROUP, F.col("part").alias("p_part")), GROUP, "v_part", "p_part")
    return forward.select(*GROUP, "p_part", "v_part", F.lit("promo").alias("by")) \
        .unionByName(backward.select(*GROUP, "p_part", "v_part", F.lit("venue").alias("by")))


def first_overlap(promo_parts: DataFrame, venue_parts: DataFrame) -> DataFrame:
    """(id, ord, venue_id): for every promoter row the first venue row, by
    ``ord``, on the same day and venue that overlaps it."""
    promo = cut_lineage(promo_parts.select(*GROUP, "id", "ord", "part"))
    strings = cut_lineage(promo.select(*GROUP, "part").distinct())
    # of the venue rows only the first per string counts; strings come many times
    venue = cut_lineage(venue_parts.groupBy(*GROUP, "part", "is_title").agg(F.min(F.struct("ord", "id")).alias("_first")))
    pairs = overlapping_parts(strings, venue)
    first = F.min("_first").alias("_first")
    # a venue part reached by the promoter's needle counts for every row that
    # shows it; one used as a needle only for rows it is searchable in
    any_row = venue.groupBy(*GROUP, F.col("part").alias("v_part")).agg(first) \
        .withColumn("by", F.lit("promo"))
    able_row = _searchable(venue).groupBy(*GROUP, F.col("part").alias("v_part")).agg(first) \
        .withColumn("by", F.lit("venue"))
    reach = null_safe_join(pairs, any_row.unionByName(able_row), [*GROUP, "v_part", "by"], "inner") \
        .groupBy(*GROUP, F.col("p_part").alias("part")).agg(F.min("_first").alias("_first"))
    return null_safe_join(promo, reach, [*GROUP, "part"], "inner") \
        .groupBy("id", "ord").agg(F.min("_first").alias("_first")) \
        .select("id", "ord", F.col("_first.id").alias("venue_id"))


def fold_into(targets: DataFrame, folds: DataFrame) -> DataFrame:
    """Apply folded rows to their targets.

    ``folds`` holds the folded rows' fields plus ``target_id`` and ``ord``.
    Sold-out is OR-ed, links are joined by URL, and each blank field takes the
    first filler in order.  All fillers are combinable aggregates; the link
    list is bounded by the distinct URLs of one show.
    """
    link = F.posexplode_outer("ticket_links").alias("_pos", "_l")
    firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f"_f_{f}")
              for f in FILLS]
    fills = folds.groupBy("target_id").agg(
        F.bool_or("is_sold_out").alias("_f_sold"), F.count(F.lit(1)).alias("folded"), *firsts)
    at = F.struct("ord", "_pos")  # as printed, row by row
    urls = folds.select("target_id", "ord", link).filter("_l.url is not null") \
        .groupBy("target_id", "_l.url").agg(F.min_by("_l", at).alias("_l"), F.min(at).alias("_at")) \
        .groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_l")))
                                  .alias("_links"))
    fills = fills.join(urls, "target_id", "left")
    joined = targets.join(fills, F.col("id") == F.col("target_id"), "left").drop("target_id")
    merged = joined.withColumn(
        "is_sold_out", F.col("is_sold_out") | F.coalesce("_f_sold", F.lit(False))) \
        .withColumn("ticket_links", union_links(
            F.col("ticket_links"), F.transform("_links", lambda s: s["_l"]).cast(LINKS)))
    for f in FILLS:
        merged = merged.withColumn(f, F.coalesce(f, f"_f_{f}"))
    return merged.withColumn("folded", F.coalesce("folded", F.lit(0))) \
        .drop("_f_sold", "_links", *[f"_f_{f}" for f in FILLS])


# --- promoter against promoter ---------------------------------------------


def fold_promoters(rows: DataFrame, aliases: Mapping[str, str] | None = None, in_order: int = IN_ORDER) -> DataFrame:
    """(id, ord, target_id): promoter rows of one day and venue that describe
    a show an earlier kept row already lists.

    The rule depends on order: a row joins the *first* kept row whose start
    time agrees (unknown agrees) and that overlaps it, by title when the
    source is the same and by any name otherwise; a kept row without a time
    takes the first one folded into it.

    Copies (same source, time and parts) always share one fate when they
    overlap themselves, so only the first of them is judged.  ``first_fit``
    takes small days and venues in order and settles larger ones together in
    rounds.
    """
    parts = cut_lineage(parts_of(rows, aliases, extra=("start_time",)))
    looks = parts.groupBy(*GROUP, "id", "ord", "source", "start_time").agg(
        F.sort_array(F.collect_set(F.struct("is_title", "part"))).alias("_parts"))
    # a copy overlaps itself only through a title long enough to search for
    own = F.exists("_parts", lambda p: p["is_title"] & (F.length(p["part"])
                                                        >= needle_floor(p["part"])))
    looks = looks.withColumn("_own", F.when(~own, F.col("id")))
    sig = [*GROUP, "source", "start_time", "_parts", "_own"]
    judged = cut_lineage(looks.groupBy(*sig).agg(F.min_by("id", "ord").alias("lead"),
                                          F.min("ord").alias("lead_ord")))
    groups = cut_lineage(judged.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_size"))
                         .filter("_size > 1").withColumn("g", F.monotonically_increasing_id()).drop("_size"))
    scanned = first_fit(null_safe_join(judged, groups, GROUP, "inner"), in_order)
    fate = null_safe_join(looks.select(*sig, "id", "ord"), judged.select(*sig, "lead"),
                          sig, "inner").join(scanned, "lead", "left") \
        .withColumn("kept", F.coalesce("kept", "lead"))
    return fate.filter(F.col("id") != F.col("kept")) \
        .select("id", "ord", F.col("kept").alias("target_id"))


# --- festivals --------------------------------------------------------------


def festival_days(festivals: DataFrame) -> DataFrame:
    """(venue_key, name, day): every covered day of a festival with its base
    name (venue name before a bracket, first non-empty one in order)."""
    base = name_key(F.element_at(F.split(F.coalesce("venue_name", F.lit("")), r"\(", 2), 1))
    named = festivals.withColumn("_name", base)
    names = named.groupBy("venue_key").agg(
        F.min_by("_name", F.when(F.col("_name") != "", F.struct("ord", "id"))).alias("name"))
    days = named.select("venue_key", F.explode(every_day(F.col("start_date"), F.col("end_date")))
                        .alias("day")).distinct()
    return days.join(names, "venue_key").filter("name is not null")


def festival_duplicates(rows: DataFrame, days: DataFrame, hosts: DataFrame,
                        promoters: Sequence[str]) -> DataFrame:
    """Ids of rows that are a festival seen through its host's or promoter's
    calendar: dated inside the window, named after it, and from a promoter or
    at a host venue.  ``hosts`` is (festival_key, host_key)."""
    title = name_key(F.concat_ws(" ", F.coalesce("title_ja", F.lit("")),
                                 F.coalesce("title_en", F.lit(""))))
    texts = rows.select("id", "source", "venue_key", F.col("start_date").alias("day"),
                        title.alias("hay"))
    named = contained_pairs(days.select("day", F.col("name").alias("needle")),
                            texts.select("day", "hay"), ["day"], shortest=1)
    open_days = days.select("day", F.col("venue_key").alias("festival_key"),
                            F.col("name").alias("needle"))
    at = named.join(open_days, ["day", "needle"]).join(
        sized_broadcast(hosts.withColumnRenamed("host_key", "_host")), "festival_key", "left") \
        .select("day", "hay", F.col("_host")).distinct()
    hit = texts.join(at, ["day", "hay"]).filter(
        F.col("source").isin(*promoters) | (F.col("venue_key") == F.col("_host")))
    return hit.select("id").distinct()


# --- the export-stage merge -------------------------------------------------


def merge_promoters(events: DataFrame, promoters: Sequence[str], festival_source: str,
                    hosts: DataFrame, aliases: Mapping[str, str] | None = None,
                    curated: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, fates) after folding.

    ``events`` carries id, ord and venue_key.  Fates: ``kept``, ``festival``
    (duplicate of a festival), ``unresolved`` (promoter row without a venue),
    ``venue`` (folded into a venue row), ``promoter`` (folded into an earlier
    promoter row), each with its target.
    """
    events = cut_lineage(events)
    is_promo = F.col("source").isin(*promoters)
    is_fest = F.col("source") == festival_source
    dup = festival_duplicates(events.filter(~is_fest), festival_days(events.filter(is_fest)),
                              hosts, promoters).withColumn("_dup", F.lit(True))
    marked = events.join(cut_lineage(dup), "id", "left") \
        .withColumn("_dup", F.coalesce("_dup", F.lit(False)))
    open_promo = marked.filter(is_promo & ~F.col("_dup") & F.col("venue_key").isNotNull())
    # a venue row that is a festival duplicate is still offered as a target
    venue = marked.filter(~is_promo & ~is_fest & ~F.col("source").isin(*curated))
    to_venue = cut_lineage(first_overlap(parts_of(open_promo, aliases), parts_of(venue, aliases)))
    left = open_promo.join(to_venue.select("id"), "id", "left_anti")
    to_promo = cut_lineage(fold_promoters(left, aliases))

    targets = to_venue.select("id", F.col("venue_id").alias("target_id"),
                              F.lit("venue").alias("_by")) \
        .unionByName(to_promo.select("id", "target_id", F.lit("promoter").alias("_by")))
    fated = marked.join(targets, "id", "left").withColumn(
        "fate", F.when(F.col("_dup"), "festival")
        .when(is_promo & F.col("venue_key").isNull(), "unresolved")
        .otherwise(F.coalesce("_by", F.lit("kept"))))
    folds = fated.filter(F.col("fate").isin("venue", "promoter"))
    rows = fold_into(fated.filter("fate = 'kept'").drop("_dup", "_by", "target_id"), folds)
    return rows.drop("fate"), fated.select("id", "source", "fate", "target_id")


def duplicate_groups(events: DataFrame, promoters: Sequence[str],
                     aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(group, rows, sources, class) for every day and venue that more than
    one row shows and a promoter is part of.

    cross-source   several sources
    performances   one source; all titles align and all times differ
    distinct       one source; no two titles align
    unexplained    everything else (a fold should have taken it)

    "All pairs" is decided by counting, not by listing pairs: of n rows there
    are n(n-1)/2, and aligned pairs are counted over distinct titles.
    """
    dated = events.filter(F.col("venue_key").isNotNull() & F.col("start_date").isNotNull())
    groups = dated.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("rows"), F.collect_set("source").alias("sources"),
        F.count("start_time").alias("_timed"),
        F.count_distinct("start_time").alias("_times")) \
        .filter((F.col("rows") > 1) & F.arrays_overlap(
            "sources", F.array(*[F.lit(p) for p in promoters])))
    single = groups.filter(F.size("sources") == 1)
    rows = dated.join(single.select(*GROUP), list(GROUP), "left_semi")
    aligned = aligned_pairs(rows, aliases)
    counted = null_safe_join(groups, aligned, GROUP, "left").withColumn(
        "_aligned", F.coalesce("_aligned", F.lit(0)))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    all_differ = (F.col("_timed") == F.col("rows")) & (F.col("_times") == F.col("rows"))
    label = (F.when(F.size("sources") > 1, "cross-source")
             .when((F.col("_aligned") == pairs) & all_differ, "performances")
             .when(F.col("_aligned") == 0, "distinct")
             .otherwise("unexplained"))
    return counted.select(*GROUP, "rows", F.sort_array("sources").alias("sources"),
                          label.alias("class"))


def aligned_pairs(rows: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """(group, _aligned): number of row pairs of a group whose titles align.

    Rows with equal title sets are counted together; only distinct title sets
    are compared, through the containment join.
    """
    titles = F.array_distinct(F.filter(
        F.array(match_key(F.col("title_ja"), aliases), match_key(F.col("title_en"), aliases)),
        lambda t: t != ""))
    sets = cut_lineage(rows.groupBy(*GROUP, F.sort_array(titles).alias("_set")).agg(
        F.count(F.lit(1)).alias("_n")))
    parts = sets.select(*GROUP, "_set", "_n", F.explode("_set").alias("part"))
    able = parts.filter(F.length("part") >= needle_floor(F.col("part")))
    inside = contained_pairs(able.select(*GROUP, F.col("part").alias("needle")),
                             parts.select(*GROUP, F.col("part").alias("hay")), GROUP)
    a = able.select(*GROUP, F.col("part").alias("needle"), F.col("_set").alias("_a"),
                    F.col("_n").alias("_na"))
    b = parts.select(*GROUP, F.col("part").alias("hay"), F.col("_set").alias("_b"),
                     F.col("_n").alias("_nb"))
    both = null_safe_join(null_safe_join(inside, a, [*GROUP, "needle"], "inner"), b,
                          [*GROUP, "hay"], "inner")
    apart = both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *GROUP, F.when(F.col("_a") < F.col("_b"), F.col("_a")).otherwise(F.col("_b")).alias("_x"),
        F.when(F.col("_a") < F.col("_b"), F.col("_b")).otherwise(F.col("_a")).alias("_y"),
        (F.col("_na") * F.col("_nb")).alias("_pairs")).distinct()
    same = able.select(*GROUP, F.col("_set").alias("_x"), F.col("_set").alias("_y"),
                       (F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("_pairs")).distinct()
    return apart.unionByName(same).groupBy(*GROUP).agg(F.sum("_pairs").alias("_aligned"))
