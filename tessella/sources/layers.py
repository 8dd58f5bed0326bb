"""Opening layers by path, layer metadata, archives, database URIs, geolocated arrays and source identities."""

from __future__ import annotations

import hashlib
import os
import zipfile
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import wkt

RASTER_EXTENSIONS = ("tif", "tiff", "img", "nc", "hdf", "h5")


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def kind_of(path: str) -> str:
    """"tiles", "raster", "database" or "vector"."""
    if path.lower().startswith(("pg:", "postgresql://", "postgres://", "jdbc:")):
        return "database"
    ext = extension(path)
    return "tiles" if ext == "tiles" else "raster" if ext in RASTER_EXTENSIONS else "vector"


def open_layer(spark: SparkSession, path: str, x: str = "x", y: str = "y", wkt_column: str = "wkt") -> DataFrame:
    """A vector source as a DataFrame: Parquet as it is, CSV and TSV with WKT or x and y, GeoJSON exploded into vertices."""
    ext = extension(path)
    if ext in ("csv", "tsv", "txt"):
        df = spark.read.csv(path, header=True, sep="\t" if ext == "tsv" else ",")
        if wkt_column in df.columns:
            if "fid" not in df.columns:
                df = df.withColumn("fid", F.monotonically_increasing_id())
            return wkt.vertices(df.withColumn("fid", F.col("fid").cast("long")), wkt_column)
        return df.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")})
    if ext in ("json", "geojson"):
        return geojson_vertices(spark, path)
    if ext == "orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def geojson_vertices(spark: SparkSession, path: str) -> DataFrame:
    """fid, type, part, ring, seq, x, y of a feature collection; coordinates stay JSON text until their depth is known."""
    schema = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("fid", "f")).select(F.col("fid").cast("long"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    deep = "array<array<array<array<double>>>>"
    wrap = {"Point": "[[[{}]]]", "MultiPoint": None, "LineString": "[[{}]]", "MultiLineString": None, "Polygon": "[{}]", "MultiPolygon": "{}"}
    parsed = F.lit(None).cast(deep)
    for name, text in wrap.items():
        if text:
            head, tail = text.split("{}")
            one = F.from_json(F.concat(F.lit(head), F.col("c"), F.lit(tail)), deep)
        elif name == "MultiPoint":
            one = F.transform(F.from_json("c", "array<array<double>>"), lambda p: F.array(F.array(p)))
        else:
            one = F.transform(F.from_json("c", "array<array<array<double>>>"), lambda r: F.array(r))
        parsed = F.when(F.col("kind") == name, one).otherwise(parsed)
    kind = F.when(F.col("kind").contains("Polygon"), 1).when(F.col("kind").contains("Line"), 0).otherwise(2)
    parts = f.select("fid", kind.alias("type"), F.posexplode(parsed).alias("part", "rings"))
    rings = parts.select("fid", "type", "part", F.posexplode("rings").alias("ring", "vs"))
    return rings.select("fid", "type", "part", "ring", F.posexplode("vs").alias("seq", "v")).select("fid", "type", "part", "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


class LayerInfo:
    """Counts and extents of layers, remembered by path; a count that was skipped is -1 and filled in when asked for."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], dict] = {}

    def of(self, path: str, layer: DataFrame, name: str = "", with_count: bool = True, epsg: int = 0) -> dict:
        entry = self.known.get((path, name))
        if entry and (entry["feature_count"] >= 0 or not with_count):
            return entry
        minx = "minx" if "minx" in layer.columns else "x"
        cols = {"minx": F.min(minx), "miny": F.min(minx.replace("x", "y")), "maxx": F.max(minx.replace("min", "max")), "maxy": F.max(minx.replace("min", "max").replace("x", "y") if minx == "x" else "maxy")}
        row = layer.agg(*(c.alias(k) for k, c in cols.items()), *([F.count("*").alias("n")] if with_count else [])).first()
        self.known[(path, name)] = {"name": name, "epsg": epsg, "feature_count": row["n"] if with_count else -1, **{k: row[k] for k in cols}}
        return self.known[(path, name)]


def archive_member(path: str) -> str | None:
    """The best vector source inside a zip: shapefiles with an index, shapefiles, then databases; the first of the best."""
    scores = {"shp": 100, "gpkg": 90, "gdb": 90, "sqlite": 90, "parquet": 80, "geojson": 70, "csv": 60}
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
    low = {n.lower() for n in names}
    best, found = 0, None
    for n in names:
        score = scores.get(extension(n), 0)
        if score == 100 and n.lower()[:-4] + ".shx" in low:
            score += 20
        if score > best:
            best, found = score, n
    return found


@dataclass
class PostgresUri:
    host: str = "localhost"
    port: int = 5432
    dbname: str = ""
    user: str = ""
    password: str = ""
    sslmode: str = ""
    extras: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        q = lambda s: quote(s, safe="")
        login = f"{q(self.user)}{':' + q(self.password) if self.password else ''}@" if self.user else ""
        options = ([("sslmode", self.sslmode)] if self.sslmode else []) + list(self.extras.items())
        return f"postgresql://{login}{self.host}:{self.port}/{q(self.dbname)}" + ("?" + "&".join(f"{q(k)}={q(v)}" for k, v in options) if options else "")

    @staticmethod
    def parse(uri: str) -> PostgresUri:
        scheme, sep, rest = uri.partition("://")
        if not sep or scheme.lower() not in ("postgresql", "postgres"):
            raise ValueError("not a database URI")
        rest, _, query = rest.partition("?")
        login, at, place = rest.rpartition("@")
        hostport, _, name = place.partition("/")
        host, _, port = hostport.partition(":")
        user, _, password = login.partition(":") if at else ("", "", "")
        options = dict((unquote(k), unquote(v)) for k, _, v in (p.partition("=") for p in query.split("&") if p))
        return PostgresUri(host or "localhost", int(port or 5432), unquote(name), unquote(user), unquote(password), options.pop("sslmode", ""), options)

    def masked(self) -> str:
        return PostgresUri(self.host, self.port, self.dbname, self.user, "***" if self.password else "", self.sslmode, self.extras).text().replace("%2A%2A%2A", "***")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.jdbc(f"jdbc:postgresql://{self.host}:{self.port}/{self.dbname}", table, properties={"user": self.user, "password": self.password})


def geoloc_spec(path: str, var: str, time: int = 0) -> str:
    return f"GEOLOC:{path}|{var}|{max(0, time)}"


def parse_geoloc(spec: str) -> tuple[str, str, int] | None:
    if not spec.startswith("GEOLOC:"):
        return None
    parts = spec[7:].rsplit("|", 2)
    if len(parts) != 3 or not parts[0] or not parts[1]:
        return None
    try:
        return parts[0], parts[1], max(0, int(parts[2]))
    except ValueError:
        return None


def lonlat_pair(variables: list[dict]) -> tuple[str, str] | None:
    """Names of the longitude and latitude among described variables (name, units), by name or by units."""
    lon = next((v["name"] for v in variables if v["name"].lower() in ("lon", "longitude", "x") or "east" in v.get("units", "").lower()), None)
    lat = next((v["name"] for v in variables if v["name"].lower() in ("lat", "latitude", "y") or "north" in v.get("units", "").lower()), None)
    return (lon, lat) if lon and lat else None


def geoloc_variables(arrays: list[dict]) -> list[dict]:
    """Variables whose coordinates name at least two two-dimensional arrays; arrays have name, shape, coordinates."""
    flat = {a["name"] for a in arrays if len(a["shape"]) == 2}
    out = []
    for a in arrays:
        coords = [c for c in a.get("coordinates", "").split() if c in flat]
        if len(coords) >= 2 and len(a["shape"]) >= 2:
            out.append({"name": a["name"], "time_count": a["shape"][0] if len(a["shape"]) >= 3 else 1, "coordinates": coords})
    return out


def subdatasets(metadata: dict[str, str]) -> list[str]:
    return [v for k, v in metadata.items() if k.endswith("_NAME")]


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def signature(path: str) -> tuple[int, int]:
    """(bytes, newest modification time) of a file, or of all files of a folder."""
    if os.path.isdir(path):
        files = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names]
        return sum(os.path.getsize(f) for f in files), int(max((os.path.getmtime(f) for f in files), default=0))
    s = os.stat(path)
    return s.st_size, int(s.st_mtime)


def source_id(path: str) -> str:
    size, mtime = signature(path)
    return hashlib.sha1(f"{path}|{mtime}|{size}".encode()).hexdigest()


def tile_store_path(path: str, src_epsg: int, dst_epsg: int) -> str:
    """Where the tiles of a source in a system are kept, beside it."""
    size, mtime = signature(path)
    real = os.path.realpath(path)
    return os.path.join(os.path.dirname(real), "tiles", f"{fnv1a64(f'{real}|{size}|{mtime}'):016x}"[:8] + f"_e{src_epsg}_d{dst_epsg}.tiles")


class LayerCache:
    """Layers kept as Parquet under a folder, by source identity; a changed source misses."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _place(self, path: str, layer: str) -> str:
        return os.path.join(self.folder, source_id(path), quote(layer, safe=""))

    def get(self, path: str, layer: str) -> DataFrame | None:
        place = self._place(path, layer)
        return self.spark.read.parquet(place) if os.path.exists(os.path.join(place, "_SUCCESS")) else None

    def put(self, path: str, layer: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._place(path, layer))

    def load(self, path: str, layer: str, read) -> DataFrame:
        """From the cache, or read, kept and then from the cache."""
        hit = self.get(path, layer)
        if hit is None:
            self.put(path, layer, read())
            hit = self.get(path, layer)
        return hit

    def entries(self) -> list[tuple[str, str, int]]:
        """(source, layer, bytes)."""
        out = []
        for source in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            for layer in sorted(os.listdir(os.path.join(self.folder, source))):
                out.append((source, unquote(layer), signature(os.path.join(self.folder, source, layer))[0]))
        return out

    def delete(self, path: str, layer: str) -> None:
        import shutil

        shutil.rmtree(self._place(path, layer), ignore_errors=True)

    def clear(self) -> None:
        import shutil

        shutil.rmtree(self.folder, ignore_errors=True)


def route(estimate: int, has_tiles: bool, threshold: int = 10_000_000) -> str:
    """How a source is opened: existing tiles first, tiles to be built for large sources, else directly."""
    return "tiles" if has_tiles else "build" if estimate >= threshold else "direct"


def read_raw(wanted: int, deepest: int, count: int, ms_per_feature: float, budget_ms: float = 2000.0, indexed: bool = True, margin: int = 1) -> bool:
    """Whether a view deeper than the tiles reads the source itself: only if it is fast enough."""
    if wanted < deepest + margin or (not indexed and count > 20_000):
        return False
    return ms_per_feature * count <= budget_ms


def smoothed(old: float, new: float) -> float:
    """The running time per feature, three tenths of it new."""
    return new if old <= 0 else 0.7 * old + 0.3 * new
