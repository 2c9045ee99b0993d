"""Delimited strings of places and themes as arrays of structs, and article features from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import first_per_key

# Fixed values of the feed: target codes, home domains, field orders.
TARGETS = {"MY12": "Selangor", "MY14": "Kuala Lumpur"}
HOME = "MY"
HOME_DOMAINS = (
    "malaymail.com", "freemalaysiatoday.com", "bernama.com", "malaysiakini.com", "theedgemarkets.com", "astroawani.com",
    "themalaysianinsight.com", "thestar.com.my", "nst.com.my", "malaysia-today.net", "theborneopost.com",
)
AGGREGATORS = ("reports.pr-inside.com", "forums.asiaone.com")
V2_FIELDS = ("type", "name", "country", "adm1", "adm2", "lat", "lon", "feature_id", "offset")
V1_FIELDS = ("type", "name", "country", "adm1", "lat", "lon", "feature_id")
NUMBER = r"^\s*[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"


def locations(text: Column, fields: tuple[str, ...] = V2_FIELDS) -> Column:
    """Array of structs of the `;` entries that have exactly the fields between `#`, with numeric coordinates
    (and a whole offset).  Other entries are left out."""
    parts = F.transform(F.split(text, ";"), lambda e: F.split(e, "#"))
    at = {name: k for k, name in enumerate(fields)}

    def good(p: Column) -> Column:
        ok = F.size(p) == len(fields)
        for name in ("lat", "lon"):
            ok = ok & F.coalesce(F.get(p, at[name]).rlike(NUMBER), F.lit(False))
        return ok & F.coalesce(F.get(p, at["offset"]).rlike(WHOLE), F.lit(False)) if "offset" in at else ok

    def made(p: Column) -> Column:
        kind = {"lat": "double", "lon": "double", "offset": "bigint"}
        return F.struct(*((F.trim(F.get(p, k)).try_cast(kind[n]) if n in kind else F.get(p, k)).alias(n) for n, k in at.items()))

    return F.transform(F.filter(parts, good), made)


def themes(text: Column) -> Column:
    """Array of (theme, offset) of the `THEME,offset` entries whose offset is a number."""
    parts = F.transform(F.split(text, ";"), lambda e: F.split(e, ",", 2))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & F.get(p, F.lit(1)).rlike(r"^\d+$"))
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("theme"), F.get(p, F.lit(1)).try_cast("bigint").alias("offset")))


def domain_of(url: Column) -> Column:
    """Host and port in lower case without a leading www.; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")


def is_home_domain(domain: Column) -> Column:
    out = domain.endswith(".my")
    for d in HOME_DOMAINS:
        out = out | domain.endswith(d)
    return out


def url_date(url: Column) -> Column:
    """yyyy-mm-dd from a /20yy/mm/dd/ path, else empty."""
    pattern = r"/(20\d\d)/(\d\d)/(\d\d)/"
    return F.when(url.rlike(pattern), F.concat_ws("-", *(F.regexp_extract(url, pattern, k) for k in (1, 2, 3)))).otherwise("")


def distinct_names(places: Column, only_home: bool = False) -> Column:
    some = F.filter(places, lambda p: (p["country"] == HOME) & (p["adm1"] != HOME)) if only_home else places
    return F.size(F.array_distinct(F.transform(some, lambda p: p["name"]))).cast("bigint")


def least_distance(places: Column, offsets: Column) -> Column:
    """Smallest distance of a place's offset from one of the offsets; null if either is empty."""
    return F.array_min(F.flatten(F.transform(places, lambda p: F.transform(offsets, lambda o: F.abs(p["offset"] - o)))))


def build_tables(raw: DataFrame, profile: str = "v2") -> tuple[DataFrame, DataFrame]:
    """(articles, target_locations) of a raw table, the earliest row of each url.

    v2: DATE, url, V2Locations, V2Themes.  v1: DATE, DocumentIdentifier, SourceCommonName, Themes, Locations;
    there places have no offsets and a name anywhere in the field counts.
    """
    v1 = profile == "v1"
    if v1:
        raw = raw.withColumnsRenamed({"DocumentIdentifier": "url", "SourceCommonName": "source"})
    first = first_per_key(raw, ["url"], ["DATE"])
    place_text = F.col("Locations" if v1 else "V2Locations")
    d = first.withColumn("places", locations(place_text, V1_FIELDS if v1 else V2_FIELDS)).withColumn("domain", domain_of(F.col("url")))
    d = d.withColumn("target", F.filter("places", lambda p: p["adm1"].isin(*TARGETS)))
    if v1:
        d = d.withColumn("names", F.split("Themes", ";")).withColumn("min_flood_loc_dist", F.lit(None).cast("double"))
    else:
        d = d.withColumn("pairs", themes(F.col("V2Themes"))).withColumn("names", F.transform("pairs", lambda t: t["theme"]))
        offsets = F.transform(F.filter("pairs", lambda t: F.contains(t["theme"], F.lit("FLOOD"))), lambda t: t["offset"])
        d = d.withColumn("min_flood_loc_dist", least_distance(F.col("target"), offsets).cast("double"))

    def has(code: str) -> Column:
        found = F.exists("target", lambda p: p["adm1"] == code)
        return found | F.contains(place_text, F.lit(TARGETS[code])) if v1 else found

    part = lambda s: F.exists("names", lambda t: F.contains(t, F.lit(s)))
    d = d.withColumns({
        "date": F.to_timestamp_ntz("DATE", F.lit("yyyyMMddHHmmss")), "my_domain": is_home_domain(F.col("domain")), "n_locations": distinct_names(F.col("places")),
        "n_my_places": distinct_names(F.col("places"), True), "has_selangor": has("MY12"), "has_kl": has("MY14"), "flood": part("FLOOD"), "flash_flood": part("FLASH_FLOOD"),
        "heavy_rain": F.array_contains("names", "NATURAL_DISASTER_HEAVY_RAIN"), "monsoon": F.array_contains("names", "NATURAL_DISASTER_MONSOON"), "torrential_rain": F.array_contains("names", "TORRENTIAL_RAIN") if v1 else F.lit(False),
    }).withColumn("has_target", F.col("has_selangor") | F.col("has_kl"))
    columns = ["date", "url", "domain", *(["source"] if v1 else []), "my_domain", "n_locations", "n_my_places", "has_selangor", "has_kl", "has_target", "flood", "flash_flood", "heavy_rain", "monsoon", "torrential_rain", "min_flood_loc_dist"]
    region = F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv))
    locs = d.select("date", "url", F.explode("target").alias("p")).select("date", "url", region[F.col("p.adm1")].alias("region"), "p.*")
    return d.select(*columns), locs


def article_days(articles: DataFrame) -> DataFrame:
    """articles with local day and the strict tier."""
    from tidemark.functions.columns import local_day
    from tidemark.operators.series import near_flood

    strict = F.col("flood") & near_flood(F.col("min_flood_loc_dist")) & ~F.col("domain").isin(*AGGREGATORS)
    return articles.withColumns({"day": local_day(F.col("date")), "strict": strict})
