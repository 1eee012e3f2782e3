"""Genre and title classification: rules, priors, cached verdicts, queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.text import let, mostly_ascii
from playbill.operators.ranking import top_per_key
from playbill.schema import GENRES, MUSIC_CATEGORIES
from playbill.session import cut_lineage

# Tagging rules in order, and what an untagged row most likely is.
GENRE_RULES = (
    ("idol", r"(?iu)アイドル|IDOL|生誕祭|定期公演|研究生|特典会|お披露目|"
             r"(?:AKB|SKE|NMB|HKT|NGT|STU)48|(?:乃木|櫻|欅|日向|高嶺の)坂?46?|"
             r"KAWAII LAB|[≠≒=]LOVE|ハロプロ|ハロー[!！]?プロジェクト"),
    ("k-pop", r"(?iu)[가-힯]|K-?POP|케이팝"),
    ("jazz-soul", r"(?iU)ジャズ|JAZZ|ソウル|\bSOUL\b|BIG ?BAND|ビッグバンド"),
    ("classical", r"(?iu)クラシック|CLASSICAL|オーケストラ|ORCHESTRA|交響|管弦楽|"
                  r"フィルハーモ|PHILHARMONIC|弦楽四重奏|リサイタル|RECITAL"),
    ("hiphop-rnb", r"(?iU)HIP ?-?HOP|ヒップホップ|R&B|\bRAP\b|ラッパー|ラップ|MC ?バトル|FREESTYLE"),
    ("electronic", r"(?iU)TECHNO|テクノ|ELECTRO|EDM|\bRAVE\b|レイヴ|DRUM ?['&N]? ?BASS|"
                   r"DJセット|DJ ?SET"),
    ("anime-seiyu", r"(?iu)声優|アニメ|アニソン|ラブライブ|バンドリ|BanG ?Dream|プロセカ|"
                    r"ウマ娘|ホロライブ|にじさんじ|VTUBER|アイドルマスター|アイマス"),
    ("international", r"(?iu)来日|JAPAN ?TOUR|TOUR.{0,16}JAPAN|IN JAPAN|WORLD TOUR|"
                      r"ワールドツアー|ジャパンツアー|\((?:US|UK|CA|AU|AUS|DE|FR|BR|SE|NO|NZ|IT|ES)\)"),
)
ALL_NIGHT = r"(?iu)オールナイト|ALL ?NIGHT"
DJ = r"(?iU)\bDJ\b|ＤＪ"
ART_RULES = (
    ("photography", r"(?iu)写真|フォト|PHOTOGRAPH|PHOTO"),
    ("manga-anime", r"(?iu)マンガ|漫画|アニメ|コミック|ジブリ|Fate/Grand ?Order|ハイキュー"),
    ("design", r"(?iu)デザイン|DESIGN|建築|ARCHITECT|ポスター|グラフィック"),
    ("craft", r"(?iu)工芸|陶磁|陶芸|やきもの|茶碗|七宝|民藝|民芸|うつわ|ガラス|漆|染織"),
    ("nihonga-classical", r"(?iu)日本画|古美術|浮世絵|琳派|仏教|国宝|茶の湯|刀剣|皇室|書跡|水墨|"
                          r"江戸絵画|日本美術|真言|縄文|広重|源氏物語"),
    ("western-art", r"(?iu)西洋|印象派|ルーヴル|オルセー|ルネサンス|バロック|ゴッホ|モネ|"
                    r"ピカソ|レンブラント|ターナー|大英博物館"),
    ("contemporary", r"(?iu)現代美術|現代アート|コンテンポラリー"),
)
SOURCE_PRIOR = {
    **dict.fromkeys((
        "liquidroom", "oeast", "owest", "ocrest", "onest",
        "zepp_divercity", "zepp_haneda", "zepp_shinjuku", "zepp_yokohama",
        "quattro_shibuya", "www", "www_x", "duo", "loft_shinjuku", "shelter",
        "loft_heaven", "toyosu_pit", "fever_shindaita", "que_shimokitazawa"), "j-rock"),
    "bluenote_tokyo": "jazz-soul",
    "cotton_club": "jazz-soul",
    "opera_city": "classical",
    "orchard_hall": "classical",
    "shibuya_dive": "idol",
}
COLLECTION_PRIOR = {
    "top_museum": "photography",
    "design_sight_2121": "design",
    "ggg": "design",
    "mot": "contemporary",
    "mori_art_museum": "contemporary",
    "opera_city_gallery": "contemporary",
    "what_museum": "contemporary",
    "nmwa": "western-art",
    "sompo": "western-art",
    "artizon": "western-art",
    "panasonic_shiodome": "western-art",
    "nezu": "nihonga-classical",
    "yamatane": "nihonga-classical",
    "mitsui": "nihonga-classical",
    "tnm": "nihonga-classical",
    "shozokan": "nihonga-classical",
    "mori_arts_center_gallery": "manga-anime",
}
MOST_GENRES = 2
GENRE_QUEUE, TITLE_QUEUE, BATCH = 150, 200, 20

Rules = Sequence[tuple[str, str]]
_NONE = "array<string>"


def event_text() -> Column:
    """Titles, subtitle, line-up and tags as one text; nulls and empty parts
    leave no space behind."""
    parts = F.concat(F.array("title_ja", "title_en", "subtitle"),
                     F.coalesce("lineup", F.array().cast(_NONE)),
                     F.coalesce("tags", F.array().cast(_NONE)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def rule_labels(text: Column, rules: Rules = GENRE_RULES, most: int = MOST_GENRES,
                compound: tuple[str, Sequence[str]] | None = ("electronic", (ALL_NIGHT, DJ))
                ) -> Column:
    """Labels of the rules that match, in rule order, at most ``most``.  The
    compound rule adds its label when all its patterns match."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), g) for g, p in rules]))
    if compound is not None:
        label, patterns = compound
        every = F.lit(True)
        for p in patterns:
            every = every & text.rlike(p)
        hits = let(hits, lambda h: F.when(~F.array_contains(h, label) & every,
                                          F.array_append(h, label)).otherwise(h))
    return F.slice(hits, 1, most)


def first_label(text: Column, rules: Rules = ART_RULES) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), g) for g, p in rules])


def rule_genres(events: DataFrame, rules: Rules = GENRE_RULES,
                prior: Mapping[str, str] = SOURCE_PRIOR) -> DataFrame:
    """Add ``rule_genres`` and ``confident``: rules, else the source's prior,
    which is never confident."""
    hits = let(event_text(), lambda t: rule_labels(t, rules))
    guess = lookup(prior, F.col("source"))
    return events.withColumn("_hits", hits).withColumn("confident", F.size("_hits") > 0) \
        .withColumn("rule_genres", F.when(F.col("confident"), F.col("_hits"))
                    .when(guess.isNotNull(), F.array(guess))
                    .otherwise(F.array().cast(_NONE))).drop("_hits")


def art_genres(rules: Rules = ART_RULES, prior: Mapping[str, str] = COLLECTION_PRIOR,
               place: Column | None = None) -> Column:
    """One facet for an exhibition: first title rule, else the collection's
    prior, else none."""
    titles = F.concat_ws(" ", F.coalesce("title_ja", F.lit("")), F.coalesce("title_en", F.lit("")))
    where = F.col("source") if place is None else place
    label = F.coalesce(first_label(titles, rules), lookup(prior, where))
    return F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast(_NONE))


def apply_genres(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill ``genres`` and add ``uncertain``.

    Preset genres win, then the cached verdict (event_id, genres), then rules,
    then the prior.  Exhibitions use art facets; other categories are left as
    they are.
    """
    place = F.coalesce("venue_key", "source") if "venue_key" in events.columns else None
    ruled = rule_genres(events)
    verdicts = cache.select(F.col("event_id").alias("_eid"), F.col("genres").alias("_cached"))
    joined = ruled.join(verdicts, F.col("id") == F.col("_eid"), "left").drop("_eid")
    preset = F.coalesce(F.size("genres") > 0, F.lit(False))
    music = F.col("category").isin(*MUSIC_CATEGORIES)
    picked = (F.when(preset, F.col("genres"))
              .when(F.col("category") == "art", art_genres(place=place))
              .when(~music, F.col("genres"))
              .otherwise(F.coalesce("_cached", "rule_genres")))
    unsure = music & ~preset & F.col("_cached").isNull() & ~F.col("confident")
    return joined.withColumn("uncertain", unsure).withColumn("genres", picked) \
        .drop("_cached", "rule_genres", "confident")


def verdict_queue(rows: DataFrame, order: Sequence[Column], cap: int = GENRE_QUEUE,
                  batch: int = BATCH) -> DataFrame:
    """Rows for an outside tagger: the first ``cap`` with their batch number.
    The cap is the size of a run, the rest waits for the next one.  The queue
    is stored: whoever reads it again does not classify all rows again."""
    return cut_lineage(top_per_key(rows.withColumn("_all", F.lit(1)), ["_all"], order, cap, "queue_pos")
                       .withColumn("batch_no", F.floor((F.col("queue_pos") - 1) / batch).cast("int")).drop("_all"))


def accept_verdicts(queue: DataFrame, verdicts: DataFrame,
                    vocabulary: Sequence[str] = GENRES) -> DataFrame:
    """Cache rows from returned verdicts: vocabulary only, at most two; an
    empty verdict keeps what the rules said.  Unanswered rows stay queued."""
    known = F.array(*[F.lit(g) for g in vocabulary])
    answer = F.slice(F.filter("verdict", lambda g: F.array_contains(known, g)), 1, MOST_GENRES)
    said = verdicts.filter("verdict is not null").select(
        F.col("event_id").alias("_eid"), answer.alias("_said"), "tagger")
    return queue.join(said, F.col("id") == F.col("_eid")).select(
        F.col("id").alias("event_id"),
        F.when(F.size("_said") > 0, F.col("_said")).otherwise(F.col("genres")).alias("genres"),
        "tagger")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache after a run; a fresh verdict replaces the old one."""
    return cache.join(fresh.select("event_id"), "event_id", "left_anti") \
        .unionByName(fresh, allowMissingColumns=True)


def needs_english() -> Column:
    """No English title, and a title that is not readable without Japanese."""
    return (F.coalesce("title_en", F.lit("")) == "") & (F.coalesce("title_ja", F.lit("")) != "") \
        & ~mostly_ascii(F.coalesce("title_ja", F.lit("")))


def apply_title_en(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill missing English titles from the cache (event_id, title_en) and
    flag them; real titles are untouched.  ``title_queued`` marks the rest."""
    said = cache.select(F.col("event_id").alias("_eid"), F.col("title_en").alias("_said"))
    joined = events.withColumn("_want", needs_english()) \
        .join(said, F.col("id") == F.col("_eid"), "left")
    filled = F.col("_want") & F.col("_said").isNotNull()
    return joined.withColumn("title_en_mt", F.when(filled, F.lit(True))) \
        .withColumn("title_queued", F.col("_want") & F.col("_said").isNull()) \
        .withColumn("title_en", F.when(filled, F.col("_said")).otherwise(F.col("title_en"))) \
        .drop("_eid", "_said", "_want")


def title_queue(events: DataFrame, order: Sequence[Column], cap: int = TITLE_QUEUE, batch: int = BATCH) -> DataFrame:
    """Titles for an outside translator: of the rows ``apply_title_en`` left
    queued the first ``cap`` of a run, with their batch number."""
    return verdict_queue(events.filter("title_queued"), order, cap, batch)


def accept_titles(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cache rows (event_id, title_en) from returned titles: of queued rows
    only, and none that is blank; of several answers the smallest.  Rows
    without one stay queued."""
    said = verdicts.filter(F.trim(F.coalesce("title_en", F.lit(""))) != "") \
        .groupBy("event_id").agg(F.min("title_en").alias("title_en"))
    return said.join(queue.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi")
