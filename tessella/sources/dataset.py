"""A folder of layers: its list, a selection of them, and one way to open whatever a path holds."""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shared import exists, listed, scratch
from tessella.plans import pyramid
from tessella.sources import arrays, clustered, layers

VECTOR = ("parquet", "csv", "tsv", "json", "geojson", "orc")


def layer_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """Name and path of each layer in a folder, by name; the folder is listed by the engine's file system."""
    return {p.rpartition("/")[2].rpartition(".")[0]: p for p in listed(spark, path) if layers.extension(p) in VECTOR}


def layer_list(spark: SparkSession, path: str, selected: Iterable[str] | None = None) -> DataFrame:
    """One row a layer: layer, n_features, n_fields, selected (all if none are named)."""
    chosen = None if selected is None else set(selected)
    out = None
    for name, p in layer_paths(spark, path).items():
        df = layers.open_layer(spark, p)
        row = df.agg(F.count("*").alias("n_features")).select(F.lit(name).alias("layer"), "n_features", F.lit(len(df.columns)).alias("n_fields"), F.lit(chosen is None or name in chosen).alias("selected"))
        out = row if out is None else out.union(row)
    return out if out is not None else spark.createDataFrame([], "layer string, n_features long, n_fields int, selected boolean")


def open_selected(spark: SparkSession, path: str, selected: Iterable[str]) -> dict[str, DataFrame]:
    """The named layers of a folder; a name that isn't there is an error."""
    known = layer_paths(spark, path)
    if missing := sorted(set(selected) - set(known)):
        raise ValueError(f"no such layers: {', '.join(missing)}")
    return {name: layers.open_layer(spark, known[name]) for name in selected}


def extracted(spark: SparkSession, path: str) -> str:
    """The best member of an archive as a file in the shared folder, copied piece by piece."""
    member = layers.archive_member(path)
    if not member:
        raise ValueError(f"no layer in {path}")
    out = f"{scratch(spark, 'member')}/{member.rpartition('/')[2]}"
    system, where = arrays._place(out)
    with zipfile.ZipFile(path) as z, z.open(member) as source, system.open_output_stream(where) as sink:
        shutil.copyfileobj(source, sink, 1 << 20)
    return out


def open_any(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Whatever a path holds: a database's table, a tile store's rings, an array, an index, an archive's best member, or a vector file."""
    kind = layers.kind_of(path)
    if kind == "database":
        if not table:
            raise ValueError("a database needs a table")
        return spark.read.format("jdbc").option("url", path).option("dbtable", table).load()
    if layers.extension(path) == "zip":
        return layers.open_layer(spark, extracted(spark, path))
    if exists(spark, f"{path}/meta.json"):
        return arrays.open_array(spark, path)
    if exists(spark, f"{path}/rings"):
        return pyramid.open_store(spark, path)[0]
    if (index := clustered.find(spark, path)) is not None:
        return index
    if kind == "raster":
        raise ValueError(f"rasters are opened from array stores, {path} isn't one")
    return layers.open_layer(spark, path)


#: Tables with geometry behind them; the others of the folder hold text.
_WANTED = ("customer", "events", "lineitem", "orders", "part", "supplier")


def dataset_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layers of the given folder that the views are made from, with counts, as a selection of all that are there."""
    return layer_list(spark, d, _WANTED).where("selected").drop("selected")


QUERIES = {"dataset_layers": dataset_layers}
ORACLE_SQL = {
    "dataset_layers": " union all ".join(f"select '{t}' layer, count(*) n_features, cast((select count(*) from (describe {t})) as int) n_fields from {t}" for t in _WANTED),
}
