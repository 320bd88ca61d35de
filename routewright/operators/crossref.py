"""Street candidates against a street gazetteer: lookups, spatial clusters and city hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.functions import geo
from routewright.functions.scores import cluster_confidence
from routewright.functions.streets import name_variants
from routewright.operators.components import connected_components
from routewright.operators.labels import rank_candidates
from routewright.session import as_large, cut_lineage, spread

# Lookups per image, misreadings per name, hits per name, and city hypotheses per image.
MAX_LOOKUPS = 6
VARIANTS = 3
HITS_PER_NAME = 40
HYPOTHESES = 25
# Side of the cells in which nodes of one image meet, in link distances.
_TILE = 8


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def top_hits_per_name(
    gazetteer: DataFrame, limit: int | None = HITS_PER_NAME, wanted: DataFrame | None = None
) -> DataFrame:
    """Most important ``limit`` places of every name, or all. Very common names are cut map-side before they meet a join.

    Gazetteer: name, name_en (may be NULL), lat, lon, city, country, importance, place_id. A place answers to its name
    and to its English name. ``wanted`` (key) keeps only the names asked for.
    """
    keys = F.array_distinct(F.array_compact(F.array(name_key(F.col("name")), name_key(F.col("name_en")))))
    keyed = gazetteer.withColumn("key", F.explode(keys))
    if wanted is not None:
        keyed = keyed.join(wanted, "key", "left_semi")
    order = Window.partitionBy("key").orderBy(F.desc("importance"), "place_id")
    ranked = keyed.withColumn("hit_no", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("hit_no") <= limit)


def match_streets(
    candidates: DataFrame, gazetteer: DataFrame, max_lookups: int | None = MAX_LOOKUPS, variants: int | None = VARIANTS,
    hits_per_name: int | None = HITS_PER_NAME,
) -> DataFrame:
    """Hits of each image's first candidates, by exact name or else by the first misreading that has any.

    Hits stay under the candidate's own name. Names are respelled and looked up once however many images carry them;
    ``None`` lifts a limit.
    """
    asked = as_large(rank_candidates(candidates, max_lookups).select(
        "image_id", F.col("normalized").alias("street"), "confidence", "rank"
    ))
    spellings = name_variants(F.col("street"), variants) if variants != 0 else F.array("street")
    spelled = asked.select("street").distinct().select(
        "street", F.posexplode(spellings).alias("attempt", "spelling")
    ).withColumn("key", name_key(F.col("spelling")))
    found = top_hits_per_name(gazetteer, hits_per_name, spelled.select("key").distinct()).select(
        "key", "hit_no", "lat", "lon", "city", "country")
    answered = spelled.join(found.select("key").distinct(), "key").groupBy("street").agg(
        F.min_by(F.struct("spelling", "key"), "attempt").alias("_a")).select("street", "_a.*")
    # Hits meet names before images, and what comes out is dealt by image: it is many times what went in.
    hits = answered.join(as_large(found), "key").drop("key")
    return spread(asked.join(as_large(hits), "street"), "image_id").select(
        "street", "image_id", "confidence", "rank", "spelling", "hit_no", "lat", "lon", "city", "country")


def near_pairs(points: DataFrame, radius_km: float) -> DataFrame:
    """Point pairs of one image at most ``radius_km`` apart (a.point_id < b.point_id), by cells instead of all pairs."""
    size = geo.degrees_for_m(radius_km, geo.CLUSTER_RADIUS_KM)
    reach = F.lit(size)
    left = geo.explode_cells(points.select(
        "image_id", F.col("point_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")
    ), F.col("a_lat"), F.col("a_lon"), reach, size)
    right = points.select(
        "image_id", F.col("point_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
        geo.cell_id(F.col("lat"), F.col("lon"), size).alias("cell"),
    )
    distance = geo.haversine(
        F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"), geo.CLUSTER_RADIUS_KM, True
    )
    return (
        left.join(right, ["image_id", "cell"]).filter("a < b").withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= radius_km).select("image_id", "a", "b", "distance_km")
    )


def single_link_clusters(points: DataFrame, radius_km: float) -> DataFrame:
    """Add ``component``: points of one image linked by steps of at most ``radius_km``.

    Points are first folded into cells so small that everything inside one is linked, so a dense spot becomes one node
    and needs no pairs. One point of each node meets those of the nodes around it; only where these two lie apart, but not
    too far for others of their nodes to be close, are the points of both compared.
    """
    # A cell is one side high and, near the poles, up to two sides wide: its diagonal stays under 2.3 sides.
    reach = geo.degrees_for_m(radius_km, geo.CLUSTER_RADIUS_KM)
    keyed = cut_lineage(points.withColumn("node", geo.cell_id(F.col("lat"), F.col("lon"), reach / 2.3)))
    coords = keyed.select("image_id", "lat", "lon", "node").distinct()
    nodes = cut_lineage(coords.groupBy("image_id", "node").agg(F.min(F.struct("lat", "lon")).alias("_p")).select("image_id", "node", "_p.*"))
    first, second = [nodes.select(
        "image_id", F.col("node").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")) for n in "ab"]

    def apart(a: str, b: str) -> Column:
        return geo.haversine(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"), geo.CLUSTER_RADIUS_KM, True)

    # Points of two nodes within the radius: each is at most the radius from the one point that stands for its node.
    tile = _TILE * reach
    first = first.withColumn("tile", geo.cell_id(F.col("a_lat"), F.col("a_lon"), tile))
    second = geo.explode_cells(second, F.col("b_lat"), F.col("b_lon"), F.lit(3 * reach), tile, "tile")
    close = cut_lineage(first.join(second, ["image_id", "tile"]).filter("a < b").withColumn("_d", apart("a", "b")).filter(
        F.col("_d") <= 3 * radius_km * 1.000001).select("image_id", "a", "b", (F.col("_d") <= radius_km).alias("linked")))
    ends = [coords.select("image_id", F.col("node").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")) for n in "ab"]
    found = close.filter("NOT linked").join(as_large(ends[0]), ["image_id", "a"]).join(as_large(ends[1]), ["image_id", "b"]).filter(
        apart("a", "b") <= radius_km).select("image_id", "a", "b").distinct()
    links = close.filter("linked").select("image_id", "a", "b").unionByName(found)
    labelled = connected_components(nodes.select("image_id", "node"), links, ["image_id"])
    return keyed.join(labelled, ["image_id", "node"]).drop("node")


def score_clusters(clustered: DataFrame, min_streets: int) -> DataFrame:
    """Clusters with enough distinct names: centroid, box, streets, modes of city and country, confidence.

    Input rows: image_id, component, street, confidence, hit_no, lat, lon, city, country. Repeated points all count;
    of points equal in place and name, the last one's city and country stand for all.
    """
    same = Window.partitionBy("image_id", "street", "lat", "lon")
    # Dealt by image once: both the window and the groups below keep to it.
    told = spread(clustered, "image_id").withColumn(
        "_p", F.max_by(F.struct("city", "country"), "hit_no").over(same)
    )
    known = {c: F.when(F.col(f"_p.{c}") != "", F.col(f"_p.{c}")) for c in ("city", "country")}
    per_name = told.groupBy("image_id", "component").agg(
        F.count_distinct("street").alias("n_names"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.sort_array(F.collect_set(F.struct("street", "confidence"))).alias("_names"),
        F.count("*").alias("n_ways"),
        F.mode(known["city"], True).alias("city"), F.mode(known["country"], True).alias("country"),
        F.min(F.struct("lat", "lon")).alias("seed"),
    ).filter(F.col("n_names") >= min_streets)
    conf_sum = F.aggregate("_names", F.lit(0.0), lambda acc, n: acc + n["confidence"])
    return per_name.withColumn("conf_sum", conf_sum).select(
        "image_id", "component", "n_names", "conf_sum", "lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon",
        F.transform("_names", lambda n: n["street"]).alias("streets"), "n_ways",
        cluster_confidence(F.col("n_names"), F.col("conf_sum")).alias("confidence"), "city", "country", "seed",
    )


def best_cluster(clusters: DataFrame) -> DataFrame:
    """Winner per image: most names, then confidence sum, then points, then the south-west-most seed."""
    rank = F.struct(
        (-F.col("n_names")).alias("n"), (-F.round("conf_sum", 9)).alias("c"), (-F.col("n_ways")).alias("w"), "seed"
    )
    best = clusters.groupBy("image_id").agg(F.min_by(F.struct(*clusters.columns), rank).alias("_b"))
    return best.select("_b.*").drop("seed", "component")


def city_hypotheses(matches: DataFrame, limit: int | None = HYPOTHESES) -> DataFrame:
    """Cities in which an image's candidates have hits, by number of candidates; the first ``limit`` per image, or all."""
    counted = (
        matches.filter("city <> '' AND country <> ''").groupBy("image_id", "city", "country")
        .agg(F.count_distinct("street").alias("n_candidates"))
    )
    order = Window.partitionBy("image_id").orderBy(F.desc("n_candidates"), "city", "country")
    ranked = counted.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def verify_city_hypotheses(
    hypotheses: DataFrame, candidates: DataFrame, matches: DataFrame, gazetteer: DataFrame,
    hits_per_name: int | None = HITS_PER_NAME,
) -> DataFrame:
    """Hits of every candidate in every hypothesised city: its worldwide hits there, else the gazetteer's by either name.

    Rows: image_id, city, country, rank, street, confidence, lat, lon.
    """
    asked = as_large(hypotheses.select("image_id", "city", "country", F.col("rank").alias("h_rank")).join(
        as_large(candidates.select("image_id", F.col("normalized").alias("street"), "confidence")), "image_id"
    ))
    here = ["image_id", "city", "country", "street"]
    told = matches.select(*here, "lat", "lon", F.lit(True).alias("_told"))
    # Written: both halves would work out candidates, hits and hypotheses again.
    asked = cut_lineage(spread(asked, *here).join(as_large(told), here, "left"))
    known = asked.filter("_told")
    rest = asked.filter("_told IS NULL").drop("lat", "lon", "_told").withColumn("key", name_key(F.col("street")))
    names = F.array_distinct(F.array_compact(F.array(name_key(F.col("name")), name_key(F.col("name_en")))))
    wanted = rest.select("key", "city", "country").distinct()
    places = gazetteer.select(F.explode(names).alias("key"), "city", "country", "lat", "lon", "importance", "place_id").join(
        wanted, ["key", "city", "country"], "left_semi")
    if hits_per_name is not None:
        order = Window.partitionBy("key", "city", "country").orderBy(F.desc("importance"), "place_id")
        places = places.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= hits_per_name).drop("_n")
    filled = rest.join(places.drop("importance", "place_id"), ["key", "city", "country"])
    cols = [*here, "h_rank", "confidence", "lat", "lon"]
    return known.select(*cols).unionByName(filled.select(*cols))


def best_hypothesis(verified: DataFrame, min_streets: int) -> DataFrame:
    """City with the most verified names per image, first in hypothesis order on a tie, shaped like a cluster."""
    scored = verified.groupBy("image_id", "city", "country", "h_rank").agg(
        F.count_distinct("street").alias("n_names"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.sort_array(F.collect_set(F.struct("street", "confidence"))).alias("_names"),
        F.count("*").alias("n_ways"),
    ).filter(F.col("n_names") >= min_streets)
    scored = scored.withColumn(
        "conf_sum", F.aggregate("_names", F.lit(0.0), lambda acc, n: acc + n["confidence"])
    ).withColumn("confidence", cluster_confidence(F.col("n_names"), F.col("conf_sum"))).withColumn(
        "streets", F.transform("_names", lambda n: n["street"])
    ).drop("_names")
    best = scored.groupBy("image_id").agg(
        F.min_by(F.struct(*scored.columns), F.struct(-F.col("n_names"), "h_rank")).alias("_b")
    )
    return best.select("_b.*").drop("h_rank")


def find_geocodes(
    candidates: DataFrame, gazetteer: DataFrame, min_streets: int = 2, radius_km: float = 3.0,
    max_lookups: int | None = MAX_LOOKUPS, variants: int | None = VARIANTS, two_pass: bool = True,
    hits_per_name: int | None = HITS_PER_NAME, max_hypotheses: int | None = HYPOTHESES,
) -> tuple[DataFrame, DataFrame]:
    """(best cluster per image, matches). Images whose matched names never co-locate get the city check.

    The four limits are those of a paid lookup service: names per image, misreadings per name, hits per name, cities per
    image. ``None`` takes everything.
    """
    matches = cut_lineage(match_streets(candidates, gazetteer, max_lookups, variants, hits_per_name))
    enough = matches.groupBy("image_id").agg(F.count_distinct("street").alias("_n")).filter(
        F.col("_n") >= min_streets
    ).select("image_id")
    eligible = matches.join(enough, "image_id", "left_semi")
    clusters = cut_lineage(best_cluster(score_clusters(single_link_clusters(eligible, radius_km), min_streets)))
    if not two_pass:
        return clusters, matches
    open_images = cut_lineage(enough.join(clusters.select("image_id"), "image_id", "left_anti"))
    if open_images.isEmpty():
        return clusters, matches
    open_matches = eligible.join(open_images, "image_id", "left_semi")
    verified = verify_city_hypotheses(
        city_hypotheses(open_matches, max_hypotheses), candidates.join(open_images, "image_id", "left_semi"), open_matches,
        gazetteer, hits_per_name,
    )
    return as_large(clusters.unionByName(best_hypothesis(verified, min_streets))), matches
