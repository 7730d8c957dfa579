"""Column builders for file names and small JSON or HTML fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + ")$")


def individual(path: Column) -> Column:
    """The file name up to the first underscore."""
    return F.substring_index(base_name(path), "_", 1)


def individual_strict(path: Column) -> Column:
    """As individual(), but an empty name is an error."""
    name = individual(path)
    return F.when(F.length(name) > 0, name).otherwise(F.raise_error(F.concat(F.lit("no individual in "), path)))


def view_strict(path: Column) -> Column:
    """left or right from a case-sensitive suffix of the file name, else null."""
    name = base_name(path)
    return F.when(F.endswith(name, F.lit("_left.jpg")), "left").when(F.endswith(name, F.lit("_right.jpg")), "right")


def view_loose(path: Column) -> Column:
    """left or right anywhere before the suffix or at the end, in either case, else null."""
    name = F.lower(base_name(path))

    def says(side: str) -> Column:
        return F.contains(name, F.lit(f"_{side}.")) | F.endswith(name, F.lit(f"_{side}"))

    return F.when(says("left"), "left").when(says("right"), "right")


def cache_name(path: Column) -> Column:
    """Name of the cached prediction of a file."""
    return F.concat(stem(path), F.lit(".json"))


def reflected(path: Column) -> Column:
    """File name of the mirrored copy."""
    return F.regexp_replace(path, r"(\.[^./]*)$", "_reflected$1")


def photo_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"pexels-photo-(\d+)", 1), F.lit("")).cast("long")


def photo_name(photo: Column, size: Column) -> Column:
    return F.format_string("pexels-photo-%d-%s.jpg", photo, size)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def slider_images(html: Column) -> Column:
    """Addresses of the lazily loaded pictures (class aspect__media) from a page's main slider on; none without a slider."""
    at = F.instr(html, 'id="main-slider"')
    tags = F.regexp_extract_all(F.when(at > 0, F.substr(html, at)).otherwise(""), F.lit("(<img[^>]*>)"), F.lit(1))
    media = F.filter(tags, lambda t: t.rlike(r'class="([^"]* )?aspect__media[ "]') & t.contains("data-flickity-lazyload="))
    return F.transform(media, lambda t: F.regexp_extract(t, r'data-flickity-lazyload="([^"]*)"', 1))


def layer_size(layer: Column) -> Column:
    """Spatial size of a network layer's output by its prefix; an unknown layer is an error."""
    return (
        F.when(F.startswith(layer, F.lit("conv1")), 112).when(F.startswith(layer, F.lit("pool1")), 56).when(F.startswith(layer, F.lit("conv2")), 56).when(F.startswith(layer, F.lit("conv3")), 28)
        .when(F.startswith(layer, F.lit("conv4")), 14).when(F.startswith(layer, F.lit("conv5")), 7)
        .otherwise(F.raise_error(F.concat(F.lit("unknown layer "), layer)).cast("int"))
    )


def model_name(ratio: Column, rembg: Column, least: Column, layer: Column, pool: Column, components: Column) -> Column:
    """Name of the saved model of a configuration."""
    mark = F.when(rembg, "rembg").otherwise("norembg")
    return F.format_string("split%s_%s_min%d_%s_pool%d_pca%d", ratio.cast("string"), mark, least, layer, pool, components)
