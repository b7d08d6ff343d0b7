"""Layer lists and stacks: what a stack shows, flattening, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.blobs import layers_or_image, next_layers
from ..schemas import FILE, WHITEOUT


def stack(layers: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Files that a stack of layers shows: ``layers(layer_idx, path, kind, ...)``, a higher index on top.

    Of each path the topmost row counts; it shows if it is a file and no higher layer deletes it
    or a directory above it. One pass for any number of layers: the topmost row is a map-side
    combined max_by, deletions are an equi-join of each path's ancestors."""
    on = [*key, "path"]
    rest = [c for c in layers.columns if c not in on]
    top = layers.groupBy(*on).agg(F.max_by(F.struct(*rest), "layer_idx").alias("__t")).select(*on, "__t.*").where(F.col("kind") == FILE)
    cuts = layers.where(F.col("kind") == WHITEOUT).groupBy(*key, F.col("path").alias("__at")).agg(F.max("layer_idx").alias("__cut"))
    at = top.select(*on, "layer_idx", F.explode(paths.ancestors(F.col("path"))).alias("__at"))
    hidden = at.join(cuts, [*key, "__at"]).where(F.col("__cut") > F.col("layer_idx")).select(*on).distinct()
    return top.join(hidden, on, "left_anti").select(*layers.columns)


def flatten(layers: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """A stack as one layer of index 0."""
    return stack(layers, key).withColumn("layer_idx", F.lit(0).cast(layers.schema["layer_idx"].dataType))


def unnest(snapshots: DataFrame) -> DataFrame:
    """(volume_id, layer_idx, sha256) of each snapshot's layers, the image where there are none."""
    return snapshots.select("volume_id", F.posexplode(layers_or_image(F.col("layers"), F.col("image_sha256"))).alias("layer_idx", "sha256"))


def conflicts(local: DataFrame, server: DataFrame) -> DataFrame:
    """Volumes whose local layer list differs from the server's, with the first place where it does.

    On either side a snapshot without layers counts as one of its image (image_sha256, if there is such
    a column). Volumes that the server does not have are no conflict."""
    own = lambda d, name: d.select("volume_id", layers_or_image(F.col("layers"), F.col("image_sha256") if "image_sha256" in d.columns else F.lit(None).cast("string")).alias(name))
    a, b = own(local, "local_layers"), own(server, "server_layers")
    both = a.join(b, "volume_id").where(~F.col("local_layers").eqNullSafe(F.col("server_layers")))
    same = F.zip_with("local_layers", "server_layers", lambda x, y: x.eqNullSafe(y))
    return both.withColumn("first_difference", F.array_position(same, False) - 1)


def commit_layer(snapshots: DataFrame, new: DataFrame, most: int = 2) -> DataFrame:
    """Layer lists after ``new(volume_id, sha256)``; volumes without a new layer stay as they are."""
    joined = snapshots.join(new.select("volume_id", F.col("sha256").alias("__new")), "volume_id", "left")
    layers = layers_or_image(F.col("layers"), F.col("image_sha256"))
    after = F.when(F.col("__new").isNull(), layers).otherwise(next_layers(layers, F.col("__new"), most))
    return joined.withColumn("layers", after).drop("__new")


def unfit_layers(snapshots: DataFrame, blobs: DataFrame, violations: DataFrame) -> DataFrame:
    """(volume_id, layer_idx, sha256, reason) of layers that may not be committed: no blob, or faults."""
    rows = unnest(snapshots)
    have = blobs.select("sha256", F.lit(True).alias("have")).distinct()
    bad = violations.select(F.col("image").alias("sha256"), F.lit(True).alias("bad")).distinct()
    reason = F.when(F.col("have").isNull(), "missing blob").when(F.col("bad"), "fails check")
    return rows.join(have, "sha256", "left").join(bad, "sha256", "left").withColumn("reason", reason).where("reason IS NOT NULL").select("volume_id", "layer_idx", "sha256", "reason")
