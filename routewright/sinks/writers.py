"""Sinks: GPX, KML and GeoJSON documents as text columns, and route files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.functions.text import xml_escape
from routewright.session import cut_lineage

CREATOR = "routewright"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
_GPX = (
    '<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1" '
    'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
    'xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">\n'
)

# Line colour (alpha, blue, green, red) and width of exported map lines.
KML_COLOR, KML_WIDTH = "ffe8731a", 4


def valid_coords(lat: Column, lon: Column) -> Column:
    """Finite and within ±90 / ±180."""
    return F.coalesce(
        ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False)
    )


def _plain(c: Column) -> Column:
    """The double's own digits without exponent or trailing zeros; coordinates have three digits before the point at most."""
    digits = F.regexp_replace(c.cast("string").cast("decimal(38,30)").cast("string"), r"0+$", "")
    return F.regexp_replace(digits, r"\.$", ".0")


def _fixed6(c: Column) -> Column:
    return F.format_string("%.6f", c)


def _element(tag: str, text: Column, indent: str = "") -> Column:
    shown = F.concat(F.lit(f"{indent}<{tag}>"), xml_escape(text), F.lit(f"</{tag}>\n"))
    return F.when(F.coalesce(text, F.lit("")) != "", shown).otherwise("")


def gpx_route(
    line: Column, name: Column, description: Column, source: Column, keywords: Column, creator: str = CREATOR
) -> Column:
    """GPX 1.1 document with one route; points out of range or not finite are left out, an empty route is legal."""
    kept = F.filter(line, lambda p: valid_coords(p["lat"], p["lon"]))
    points = F.transform(kept, lambda p: F.concat(
        F.lit('    <rtept lat="'), _plain(p["lat"]), F.lit('" lon="'), _plain(p["lon"]), F.lit('"/>\n')
    ))
    tags = F.array_join(keywords, ", ")
    return F.concat(
        F.lit(_HEAD + _GPX.format(creator=creator) + "  <metadata>\n"), _element("name", name, "    "),
        _element("desc", description, "    "), _element("keywords", tags, "    "), F.lit("  </metadata>\n  <rte>\n"),
        _element("name", name, "    "), _element("desc", description, "    "), _element("src", source, "    "),
        F.array_join(points, ""), F.lit("  </rte>\n</gpx>\n"),
    )


def _nonempty(line: Column, document: Column) -> Column:
    return F.when(F.size(line) > 0, document).otherwise(F.raise_error(F.lit("line is empty")))


def gpx_route_and_track(
    line: Column, name: Column, description: Column, stamp: str, creator: str = CREATOR
) -> Column:
    """GPX 1.1 document with the line both as route and as track; an empty line is an error."""
    def points(tag: str, indent: str) -> Column:
        return F.array_join(F.transform(line, lambda p: F.concat(
            F.lit(f'{indent}<{tag} lat="'), _fixed6(p["lat"]), F.lit('" lon="'), _fixed6(p["lon"]), F.lit('"/>\n')
        )), "")

    title, about = xml_escape(name), xml_escape(description)
    return _nonempty(line, F.concat(
        F.lit(_HEAD + _GPX.format(creator=creator) + "  <metadata><name>"), title, F.lit("</name><desc>"), about,
        F.lit(f"</desc><time>{stamp}</time></metadata>\n  <rte>\n    <name>"), title, F.lit("</name>\n"),
        points("rtept", "    "), F.lit("  </rte>\n  <trk>\n    <name>"), title, F.lit("</name>\n    <trkseg>\n"),
        points("trkpt", "      "), F.lit("    </trkseg>\n  </trk>\n</gpx>\n"),
    ))


def kml_line(line: Column, name: Column, description: Column) -> Column:
    """KML 2.2 document with one styled line, lon,lat,0 triples; an empty line is an error."""
    triples = F.array_join(F.transform(
        line, lambda p: F.concat(_fixed6(p["lon"]), F.lit(","), _fixed6(p["lat"]), F.lit(",0"))
    ), " ")
    title, about = xml_escape(name), xml_escape(description)
    return _nonempty(line, F.concat(
        F.lit(_HEAD + '<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>'), title,
        F.lit("</name>\n    <description>"), about,
        F.lit(
            '</description>\n    <Style id="routeStyle">\n      <LineStyle>\n'
            f"        <color>{KML_COLOR}</color>\n        <width>{KML_WIDTH}</width>\n      </LineStyle>\n"
            "    </Style>\n    <Placemark>\n      <name>"
        ), title,
        F.lit(
            "</name>\n      <styleUrl>#routeStyle</styleUrl>\n      <LineString>\n        <tessellate>1</tessellate>\n"
            "        <coordinates>"
        ), triples,
        F.lit("</coordinates>\n      </LineString>\n    </Placemark>\n  </Document>\n</kml>\n"),
    ))


def to_geojson(line: Column) -> Column:
    """LineString document, lon before lat."""
    pairs = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")))


def route_file_name(route_id: Column) -> Column:
    return F.format_string("route_%05d.gpx", route_id)


def shippable(outcomes: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Outcomes (id, gpx_xml, confidence) good enough to write, with the relative path they get."""
    return outcomes.filter(F.col("gpx_xml").isNotNull() & (F.col("confidence") >= min_confidence)).withColumn(
        "gpx_path", F.concat(F.lit("gpx/"), route_file_name(F.col("id")))
    )


def write_documents(rows: DataFrame, folder: str) -> DataFrame:
    """Write one file per row (id, path, body) under ``folder`` on the executors; returns (id, path) of what was written.

    A plain path means Spark's default file system; where that is local to each machine, only a local master may use it.
    A file is written under a task's own name and then moved, so a retried task leaves whole files only.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if folder.startswith("file:") and "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def write_part(batches):
        import uuid

        from pyarrow import fs

        filesystem, root = fs.FileSystem.from_uri(folder)
        made = set()
        for pdf in batches:
            for path, body in zip(pdf["path"], pdf["body"]):
                target = f"{root}/{path}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                staged = f"{parent}/.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(staged) as out:
                    out.write(body.encode("utf-8"))
                filesystem.move(staged, target)
            yield pdf[["id", "path"]]

    return cut_lineage(rows.select("id", "path", "body").mapInPandas(write_part, "id long, path string"))


def write_route_files(outcomes: DataFrame, folder: str, min_confidence: float = 0.6) -> DataFrame:
    """Write one GPX file per shippable route under ``folder``; returns (id, gpx_path)."""
    rows = shippable(outcomes, min_confidence).select("id", F.col("gpx_path").alias("path"), F.col("gpx_xml").alias("body"))
    return write_documents(rows, folder).withColumnRenamed("path", "gpx_path")
