"""Artist index: names from line-ups, links from titles.

Three derived tables, rebuilt from the public events: ``artists`` (norm_key,
name), ``artist_aliases`` (norm_key of the alias, alias, artist_key) and
``event_artists`` (id, artist_key).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.names import bare_entry, clean_artist
from playbill.functions.text import escape_regex, fold, name_key, squeeze
from playbill.operators.containment import contained_pairs
from playbill.operators.ranking import spread_join
from playbill.schema import MUSIC_CATEGORIES
from playbill.session import cut_lineage, sized_broadcast

# Curated spellings of one act (norm key -> headline spelling).
CURATED_ALIASES: Mapping[str, str] = {
    "yorushika": "ヨルシカ",
    "zutomayo": "ずっと真夜中でいいのに。",
    "ずとまよ": "ずっと真夜中でいいのに。",
    "gen hoshino": "星野源",
    "hoshino gen": "星野源",
    "kenshi yonezu": "米津玄師",
    "yonezu kenshi": "米津玄師",
    "fujii kaze": "藤井風",
    "kaze fujii": "藤井風",
    "sakanaction": "サカナクション",
    "hitsujibungaku": "羊文学",
    "tatsuro yamashita": "山下達郎",
    "utada hikaru": "宇多田ヒカル",
    "hikaru utada": "宇多田ヒカル",
    "アン・ウィルソン": "ANN WILSON",
}
BILLING_CHARS = 20
SHORTEST_ASCII, SHORTEST_OTHER = 4, 3
# Character classes whose run a match must not cut.
_SCRIPTS = {
    "hira": "ぁ-ゟ",
    "kata": "゠-ヿ",
    "kanji": "一-鿿",
    "latin": "0-9A-Za-z",
}


def alias_table(spark, aliases: Mapping[str, str] = CURATED_ALIASES) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "alias_key string, spelling string")


def spell_canonically(names: DataFrame, name: str, aliases: DataFrame,
                      out: str = "spelling") -> DataFrame:
    """Add the curated spelling of a name; unknown names pass through."""
    dim = sized_broadcast(aliases.select("alias_key", F.col("spelling").alias("_to")))
    return names.withColumn("_key", name_key(F.col(name))) \
        .join(dim, F.col("_key") == F.col("alias_key"), "left") \
        .withColumn(out, F.coalesce("_to", F.col(name))).drop("_key", "_to", "alias_key")


def lineup_names(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, raw, cleaned, name, key, pos): acts named in line-ups.  A long
    entry equal to the event's own title is a billing line, not an act, also
    when the title begins like a role ("With ...")."""
    rows = events.select("id", name_key(F.col("title_ja")).alias("_ja"),
                         name_key(F.col("title_en")).alias("_en"),
                         F.posexplode("lineup").alias("pos", "raw")) \
        .withColumn("cleaned", clean_artist(F.col("raw"))).filter("cleaned is not null") \
        .withColumn("_k0", name_key(F.col("cleaned"))).withColumn("_whole", name_key(bare_entry(F.col("raw"))))

    def own_title(key: str) -> Column:
        return F.col(key).isin(F.col("_ja"), F.col("_en")) & (F.length(key) >= BILLING_CHARS)

    billing = own_title("_k0") | own_title("_whole")
    # keys are folded once, of aliases in their small table: each further fold would be one more Python worker per core
    dim = sized_broadcast(aliases.select("alias_key", F.col("spelling").alias("_to"), name_key(F.col("spelling")).alias("_to_key")))
    return rows.filter(~billing).join(dim, F.col("_k0") == F.col("alias_key"), "left").select(
        "id", "pos", "raw", "cleaned", F.coalesce("_to", "cleaned").alias("name"), F.when(F.col("_to").isNull(), F.col("_k0"))
        .otherwise(F.col("_to_key")).alias("key"))


def display_names(names: DataFrame) -> DataFrame:
    """(key, name): most used spelling; shorter, then first seen, on a tie."""
    votes = names.groupBy("key", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return votes.groupBy("key").agg(F.min_by("name", F.struct(
        (-F.col("n")).alias("n"), F.length("name").alias("len"), "first")).alias("name"))


def alias_spellings(names: DataFrame) -> DataFrame:
    """(norm_key, alias, artist_key): every spelling seen, one per norm key
    (the smallest (artist_key, alias) wins)."""
    seen = names.select(F.col("key").alias("artist_key"),
                        F.explode(F.array("name", "cleaned")).alias("alias")).distinct()
    return seen.withColumn("norm_key", name_key(F.col("alias"))).groupBy("norm_key").agg(
        F.min_by("alias", F.struct("artist_key", "alias")).alias("alias"),
        F.min("artist_key").alias("artist_key"))


def _script_class(char: Column) -> Column:
    """Regex class a neighbour of ``char`` must not belong to."""
    pick = None
    for ranges in _SCRIPTS.values():
        test, value = char.rlike(f"[{ranges}]"), F.lit(f"[{ranges}]")
        pick = F.when(test, value) if pick is None else pick.when(test, value)
    return pick.otherwise(F.lit(f"[^{''.join(_SCRIPTS.values())}]"))


def bounded_pattern(key: Column) -> Column:
    """Regex that finds ``key`` at its boundaries: no letter or digit around
    an ASCII key, no run of the same script continued by any other key."""
    ascii_key = key.rlike(r"^[\x20-\x7e]+$")
    before = F.when(ascii_key, "[0-9a-z]").otherwise(_script_class(F.substring(key, 1, 1)))
    after = F.when(ascii_key, "[0-9a-z]").otherwise(_script_class(F.substring(key, -1, 1)))
    return F.concat(F.lit("(?<!"), before, F.lit(")"), escape_regex(key),
                    F.lit("(?!"), after, F.lit(")"))


def title_text() -> Column:
    """Both titles as one folded text."""
    return squeeze(fold(F.concat_ws(" ", F.coalesce("title_ja", F.lit("")),
                                    F.coalesce("title_en", F.lit("")))))


#: where a run of letters and digits of folded text begins or ends
_EDGE = "(?<=[0-9a-z])(?=[^0-9a-z])|(?<=[^0-9a-z])(?=[0-9a-z])"
#: a key that begins and ends with such a run is found by its runs alone
_TOKEN_RUN = r"^[0-9a-z](?:[\x20-\x7e]*[0-9a-z])?$"


def token_run_spans(hays: DataFrame, keys: DataFrame) -> DataFrame:
    """(hay, needle, at): first occurrence of keys that are token runs.

    A text is cut where letters and digits begin and end, so a key at its
    boundaries is a run of pieces.  A piece is met with the lengths that keys
    beginning with it have, and runs of those lengths with the keys
    themselves: two equi-joins without a false candidate and without a pattern
    per row."""
    cut = F.split("needle", _EDGE)
    keys = keys.select("needle", F.get(cut, F.lit(0)).alias("_first"), F.size(cut).alias("_n"))
    longest = keys.agg(F.max("_n")).first()[0] or 1
    lengths = keys.groupBy("_first").agg(F.array_sort(F.collect_set("_n")).alias("_lengths"))
    tokens = hays.select("hay", F.split("hay", _EDGE).alias("_p")) \
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_p")))) \
        .select("hay", "_i", F.slice("_p", F.col("_i"), F.lit(longest)).alias("_run")) \
        .withColumn("_first", F.get("_run", F.lit(0))).filter(F.col("_first").rlike("^[0-9a-z]"))
    runs = tokens.join(sized_broadcast(lengths), "_first").withColumn("_n", F.explode("_lengths")) \
        .filter(F.col("_n") <= F.size("_run")) \
        .select("hay", "_i", F.array_join(F.slice("_run", F.lit(1), F.col("_n")), "").alias("needle"))
    first = runs.join(sized_broadcast(keys.select("needle")), "needle").groupBy("hay", "needle").agg(F.min("_i").alias("_i"))
    before = F.array_join(F.slice(F.split("hay", _EDGE), F.lit(1), F.col("_i") - 1), "")
    return first.select("hay", "needle", (F.length(before) + 1).alias("at"))


def find_names(texts: DataFrame, keys: DataFrame, text: str = "hay") -> DataFrame:
    """(text, match_key, link_key, at, until): first bounded occurrence of
    every key in every distinct text, longest match wins.

    Keys that are token runs are found by equi-joins; for the others (other
    scripts, marks at an end) the containment join proposes candidates and a
    boundary pattern decides.  ``keys`` is (match_key, link_key).
    """
    floor = F.when(F.col("match_key").rlike(r"^[\x20-\x7e]+$"), SHORTEST_ASCII) \
        .otherwise(SHORTEST_OTHER)
    # both sides are read several times below and fold text in Python
    able = cut_lineage(keys.filter(F.length("match_key") >= floor))
    hays = cut_lineage(texts.select(F.col(text).alias("hay")).distinct())
    needles = able.select(F.col("match_key").alias("needle")).distinct()
    run = F.col("needle").rlike(_TOKEN_RUN)
    pairs = contained_pairs(needles.filter(~run), hays, [])
    others = pairs.withColumn("at", F.regexp_instr("hay", bounded_pattern(F.col("needle")))).filter("at > 0")
    spans = token_run_spans(hays, needles.filter(run)).unionByName(others) \
        .withColumn("until", F.col("at") + F.length("needle"))
    return longest_spans(spans).join(able.withColumnRenamed("match_key", "needle"), "needle") \
        .select(F.col("hay").alias(text), F.col("needle").alias("match_key"), "link_key",
                "at", "until")


def longest_spans(spans: DataFrame) -> DataFrame:
    """Drop a match that lies inside a longer match of the same text.  The
    spans of one text are bounded by its length, so they are one array."""
    per_text = spans.groupBy("hay").agg(F.collect_list(F.struct("at", "until", "needle")).alias("s"))
    inside = F.filter("s", lambda a: ~F.exists("s", lambda b: (
        (b["at"] <= a["at"]) & (a["until"] <= b["until"])
        & ((b["until"] - b["at"]) > (a["until"] - a["at"])))))
    return per_text.select("hay", F.explode(inside).alias("s")).select("hay", "s.*")


def match_universe(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(match_key, link_key): every act under its own key, and every curated
    alias of a known act that is not itself a key."""
    own = names.select(F.col("key").alias("match_key")).distinct() \
        .withColumn("link_key", F.col("match_key"))
    curated = aliases.select(F.col("alias_key").alias("match_key"),
                             name_key(F.col("spelling")).alias("link_key"))
    extra = curated.join(own.select("link_key"), "link_key", "left_semi") \
        .join(own.select("match_key"), "match_key", "left_anti") \
        .select("match_key", "link_key")
    return own.unionByName(extra)


def build_artist_index(events: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """The three tables, from events with id, titles, line-up and category."""
    names = cut_lineage(lineup_names(events, aliases))
    by_lineup = names.select("id", F.col("key").alias("artist_key"))
    music = events.filter(F.col("category").isin(*MUSIC_CATEGORIES)) \
        .select("id", title_text().alias("hay"))
    found = find_names(music, match_universe(names, aliases))
    # a title a third of all events carry, and an act they all name, are hot keys
    by_title = spread_join(music, found.select("hay", "link_key"), "hay", "inner") \
        .select("id", F.col("link_key").alias("artist_key"))
    return {
        "artists": display_names(names).withColumnRenamed("key", "norm_key"),
        "artist_aliases": alias_spellings(names),
        "event_artists": by_lineup.unionByName(by_title).distinct(),
    }


def attach_artists(events: DataFrame, index: Mapping[str, DataFrame]) -> DataFrame:
    """Add ``artists``: sorted display names, empty when none is linked."""
    spelled = index["artists"].select(F.col("norm_key").alias("artist_key"), "name")
    named = spread_join(index["event_artists"], spelled, "artist_key", "inner") \
        .groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("artists"))
    return events.join(named, "id", "left").withColumn(
        "artists", F.coalesce("artists", F.array().cast("array<string>")))
