"""Stems, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP_STEM = r"^rw_([a-z_]+)_([0-9a-f]{8,})_(\d+)_(\d+)$"
RUN_STEM = r"^rw_(.+)_(\d+)$"


def _parts(stem: Column, pattern: str, names: list[tuple[str, str]]) -> Column:
    got = [F.regexp_extract(stem, pattern, i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(names)]
    return F.when(stem.rlike(pattern), F.struct(*got))


def clip_parts(stem: Column) -> Column:
    """struct(city, video, seq, frame) of a clip stem, else null."""
    return _parts(stem, CLIP_STEM, [("city", "string"), ("video", "string"), ("seq", "string"), ("frame", "long")])


def run_parts(stem: Column) -> Column:
    """struct(prefix, idx) of an index-run stem, else null."""
    return _parts(stem, RUN_STEM, [("prefix", "string"), ("idx", "long")])


def group_key(stem: Column) -> Column:
    """struct(source, grp): the clip of a clip stem, the prefix of a run, else the stem itself."""
    clip, run = clip_parts(stem), run_parts(stem)
    source = F.when(stem.startswith("rw_"), "rw").when(stem.startswith("bdd_") | stem.startswith("bddstop_"), "bdd")
    source = source.when(stem.startswith("coco_"), "coco").otherwise("other")
    grp = F.coalesce(F.concat_ws("/", clip["city"], clip["video"], clip["seq"]), run["prefix"], stem)
    return F.struct(source.alias("source"), F.when(clip.isNull() & run.isNull(), stem).when(clip.isNull(), run["prefix"]).otherwise(grp).alias("grp"))


def audit_key(stem: Column) -> Column:
    """source::group, in which only clips are grouped."""
    clip = clip_parts(stem)
    inner = F.when(clip.isNotNull(), F.concat_ws("/", clip["city"], clip["video"], clip["seq"])).otherwise(stem)
    return F.concat(group_key(stem)["source"], F.lit("::"), inner)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def name_prefix(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def pretty(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def decimals(x: Column, n: int, missing: str = "-") -> Column:
    """Fixed decimals, halves to even first; ``missing`` for null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{n}f", F.bround(x.cast("double"), n))).otherwise(F.lit(missing))


def label_line(cls: Column, box: list[Column]) -> Column:
    """Class number and four fractions with six decimals."""
    return F.concat_ws(" ", cls.cast("string"), *[decimals(c, 6) for c in box])


def frame_label(name: Column, distance: Column, sigma: Column | None = None, method: Column | None = None, score: Column | None = None) -> Column:
    """Name, range, and on request its sigma, method and score; a missing range is said to be so."""
    known = distance.isNotNull()
    reach = F.concat(decimals(distance, 1), F.lit("m"))
    if sigma is not None:
        reach = F.concat(reach, F.when(sigma.isNotNull(), F.concat(F.lit(" +/-"), decimals(sigma, 1))).otherwise(F.lit("")))
    parts = [pretty(name), F.when(known, reach).otherwise(F.lit("range n/a"))]
    parts += [F.when(known, method)] if method is not None else []
    parts += [F.when(score.isNotNull(), decimals(score, 2))] if score is not None else []
    return F.concat_ws(", ", *parts)
