"""Image jobs over rows with Spark's ``image`` struct (BGR bytes, row-major).

Pixels are read once and never shuffled: hashes and recipes are computed next to
the scan, and only keys and hashes go on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.functions import fixed
from tagloom.functions.hashing import uniform, uniform_between
from tagloom.functions.vectors import dct_matrix, lanczos_weights
from tagloom.operators.sampling import recipe
from tagloom.operators.sizing import lookup_join

IMAGE_TYPE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
BGR_MODE = 16  # OpenCV's 8-bit, three channels
TAPS_RADIUS, PASSES = 4.0, 5  # blurs below this radius add up taps, others stack so many boxes


def crop_top(df: DataFrame, frac: float = fixed.CROP_FRACTION, when: Column | None = None) -> DataFrame:
    """Keep rows 0..int(height*frac) at full width; a byte slice, no Python."""
    img = F.col("image")
    height = F.floor(img["height"] * F.lit(float(frac))).cast("int")
    data = F.substring(img["data"], F.lit(1), height * img["width"] * img["nChannels"])
    cut = img.withField("height", height).withField("data", data)
    readable = img["height"] > 0
    test = readable if when is None else readable & when
    return df.withColumn("image", F.when(test, cut).otherwise(img))


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def _gray(px: np.ndarray) -> np.ndarray:
    """Luma in whole numbers; alpha is dropped."""
    if px.shape[2] == 1:
        return px[:, :, 0]
    b, g, r = (px[:, :, i].astype(np.uint32) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def _resize(gray: np.ndarray, side: int) -> np.ndarray:
    """Lanczos to side x side, rounded to bytes after each direction."""
    h, w = gray.shape
    across = np.clip(np.rint(gray.astype(np.float64) @ lanczos_weights(w, side).T), 0, 255)
    return np.clip(np.rint(lanczos_weights(h, side) @ across), 0, 255)


def _fingerprint(gray: np.ndarray, hash_size: int) -> str:
    side = hash_size * 4
    basis = dct_matrix(side)[:hash_size]
    low = basis @ _resize(gray, side) @ basis.T
    bits = "".join("1" if x else "0" for x in (low > np.median(low)).ravel())
    return f"{int(bits, 2):0{(len(bits) + 3) // 4}x}"


def phash(df: DataFrame, hash_size: int = fixed.HASH_SIZE) -> DataFrame:
    """Replace ``image`` by ``fingerprint`` (hex); NULL for unreadable images."""

    @F.arrow_udf("string")
    def kernel(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for h, w, c, d in zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data):
            ok = h is not None and h > 0 and d.is_valid
            out.append(_fingerprint(_gray(_pixels(h, w, c, d.as_buffer())), hash_size) if ok else None)
        return pa.array(out, type=pa.string())

    img = F.col("image")
    return df.withColumn(
        "fingerprint", kernel(img["height"], img["width"], img["nChannels"], img["data"])).drop("image")


def _blur_rows(x: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian smoothing along the last axis, the edge value repeated outside. A small radius adds up its few taps; a large one is PASSES
    boxes of the same variance, each a difference of running sums. Work per pixel is bounded whatever the radius."""
    if radius < TAPS_RADIUS:
        reach = int(3 * radius + 0.5) or 1
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
        kernel /= kernel.sum()
        wide = np.pad(x, ((0, 0), (reach, reach)), mode="edge")
        return sum(k * wide[:, i:i + x.shape[1]] for i, k in enumerate(kernel))
    variance = radius * radius / PASSES
    half = int((np.sqrt(12 * variance + 1) - 1) / 2)
    size = 2 * half + 1
    # the pixels next to the box count in part, so that any variance is met
    part = (variance * size - size * (size * size - 1) / 12) / (2 * ((half + 1) ** 2 - variance))
    out = np.pad(x, ((0, 0), (PASSES * (half + 1), PASSES * (half + 1))), mode="edge")
    for _ in range(PASSES):
        sums = np.concatenate([np.zeros((len(out), 1)), np.cumsum(out, axis=1)], axis=1)
        n = out.shape[1] - size - 1
        whole = sums[:, 1 + size:1 + size + n] - sums[:, 1:1 + n]
        out = (whole + part * (out[:, :n] + out[:, size + 1:size + 1 + n])) / (size + 2 * part)
    return out


def _blur(gray: np.ndarray, radius: float) -> np.ndarray:
    smooth = _blur_rows(_blur_rows(gray.astype(np.float64), radius).T, radius).T
    return np.clip(np.rint(smooth), 0, 255).astype(np.uint8)


def _pencil(gray: np.ndarray, radius: float, alpha: float) -> np.ndarray:
    dodged = 255 - _blur(255 - gray, radius)
    base = gray.astype(np.float64)
    return (base + alpha * (dodged.astype(np.float64) - base)).astype(np.uint8)


def _draw(px: np.ndarray, r) -> np.ndarray:
    if r["style"] == "none":
        return px[:, :, :3] if px.shape[2] >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
    drawn = _pencil(_gray(px), r["blur_radius"], r["alpha"])
    if r["post_blur"] is not None:
        drawn = _blur(drawn, r["post_blur"])
    return np.repeat(drawn[:, :, None], 3, axis=2)


def augment(
    df: DataFrame, id_col: str, variants: int = 1, p: float = fixed.TRAIN_SKETCH_P,
    seed: int = fixed.SEED, fixed_pencil: bool = False,
) -> DataFrame:
    """One drawn copy per (image, variant): the columns of ``df`` with a new
    ``image``, plus ``variant`` and ``style``.

    The recipes are a function of the id, so they are computed as an array on the
    image's own row: no join, and the pixels enter Python once for all variants.
    All recipes are pencil recipes here; :func:`augment_recipes` draws a table of recipes. ``fixed_pencil`` gives the one constant
    drawing (radius 21, alpha 0.5) instead."""
    if fixed_pencil:
        one = F.struct(
            F.lit("pencil").alias("style"), F.lit(fixed.FIXED_PENCIL_RADIUS).alias("blur_radius"),
            F.lit(fixed.FIXED_PENCIL_ALPHA).alias("alpha"), F.lit(None).cast("double").alias("post_blur"))
        recipes = F.array(one)
    else:
        recipes = F.transform(
            F.sequence(F.lit(0), F.lit(variants - 1)),
            lambda v: recipe(F.col(id_col), v, p, ("pencil",), seed))
        recipes = F.transform(recipes, lambda r: F.struct(
            r["style"].alias("style"), r["blur_radius"].alias("blur_radius"),
            r["alpha"].alias("alpha"), r["post_blur"].alias("post_blur")))
    return _drawn(df, recipes)


def drawable(recipes: DataFrame, id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """The recipes with only styles that are drawn here: an edge or threshold recipe becomes a pencil recipe, with the radius and
    alpha that its item and variant draw; whether it is applied and its last blur stay."""
    def u(field: str) -> Column:
        return uniform(f"{seed}:{field}", F.col(id_col), F.col("variant"))

    other = ~F.col("style").isin("none", "pencil")
    none = F.lit(None).cast("int")
    return recipes.withColumns({
        "style": F.when(other, "pencil").otherwise(F.col("style")),
        "blur_radius": F.when(other, uniform_between(*fixed.PENCIL_RADIUS, u("radius"))).otherwise(F.col("blur_radius")),
        "alpha": F.when(other, uniform_between(*fixed.PENCIL_ALPHA, u("alpha"))).otherwise(F.col("alpha")),
        **{c: F.when(~other, F.col(c)).otherwise(none) for c in ("lo", "hi", "block", "c") if c in recipes.columns}})


def augment_recipes(df: DataFrame, recipes: DataFrame, id_col: str, seed: int = fixed.SEED) -> DataFrame:
    """One drawn copy per image and recipe of its id: the columns of ``df`` with a new ``image``, plus ``variant`` and ``style``.

    ``recipes`` is (id, variant, style, blur_radius, alpha, post_blur, ...), for example :func:`draw_recipes` or the second phase's table;
    styles without a kernel are drawn as :func:`drawable` says. The recipes of an id come to its image in one measured join: pixels move
    only if the recipes are too many to broadcast. An image without recipes is not drawn; ids in ``recipes`` are not NULL."""
    plan = drawable(recipes, id_col, seed).select(
        id_col, F.struct(F.col("variant").cast("int").alias("variant"), "style", "blur_radius", "alpha", "post_blur").alias("__r"))
    plans = plan.groupBy(id_col).agg(F.sort_array(F.collect_list("__r")).alias("__plans"))
    planned = lookup_join(df, plans, [id_col], how="inner")
    return _drawn(planned.drop("__plans"), F.col("__plans"), planned)


def _drawn(df: DataFrame, recipes: Column, source: DataFrame | None = None) -> DataFrame:
    """Copies of the images of ``df`` after an array of recipes on each row (of ``source``, if it has more columns)."""
    keep: Sequence[str] = [c for c in df.columns if c != "image"]
    img = F.col("image")
    flat = (df if source is None else source).filter(img["height"] > 0).select(
        *keep, img["origin"].alias("__origin"), img["height"].alias("__h"), img["width"].alias("__w"),
        img["nChannels"].alias("__c"), img["data"].alias("__data"), recipes.alias("__recipes"))
    n_kept = len(keep)
    schema = T.StructType([
        *flat.schema.fields[:n_kept], T.StructField("variant", T.IntegerType()), T.StructField("style", T.StringType()),
        *flat.schema.fields[n_kept:n_kept + 3], T.StructField("__data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the other columns stay Arrow values; one image's copies are held at a time
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                h, w, c = (row.column(n_kept + k)[0].as_py() for k in (1, 2, 3))
                px = _pixels(h, w, c, row.column(n_kept + 4)[0].as_buffer())
                plans = row.column(n_kept + 5)[0].as_py()
                copies = row.select(range(n_kept + 3)).take(pa.array([0] * len(plans)))
                variants = [r.get("variant", i) for i, r in enumerate(plans)]
                yield pa.RecordBatch.from_arrays(
                    [*copies.columns[:n_kept], pa.array(variants, pa.int32()), pa.array([r["style"] for r in plans], pa.string()),
                     *copies.columns[n_kept:], pa.array([_draw(px, r).tobytes() for r in plans], pa.binary())], names=schema.names)

    drawn = flat.mapInArrow(run, schema)
    image = F.struct(
        F.col("__origin").alias("origin"), F.col("__h").alias("height"), F.col("__w").alias("width"),
        F.lit(3).alias("nChannels"), F.lit(BGR_MODE).alias("mode"), F.col("__data").alias("data"))
    return drawn.select(*keep, "variant", "style", image.alias("image"))
