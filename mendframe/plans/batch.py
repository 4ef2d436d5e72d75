"""Composed plans: a whole folder of projects in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.functions.sizes import Size
from mendframe.operators.replay import provenance, provenance_counts, recipes, replay, trace
from mendframe.operators.sessions import export_target


def batch_apply(
    projects: DataFrame, steps: DataFrame, base: DataFrame, width: Size, clips: DataFrame | None = None, empty: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pictures, reports): every project's recipe replayed, and where its MCUs came from.

    `projects`: image_id, source_path, output, export_path; `steps` and `base`
    as in `replay`, keyed by image_id. The recipe is traced once, and the
    original data meets the trace once per project, whatever the length of
    the recipe. Steps are written first: numbering them reads them twice, and
    they may come from stored projects that have to be parsed.
    """
    recipe = materialize(recipes(materialize(steps)))
    named = export_target(projects)
    traced = materialize(trace(base, recipe, width))
    pictures = replay(base, recipe, width, clips, traced=traced).join(named.select("image_id", "target"), "image_id")
    hollow = empty if empty is not None else base.where("false")
    counts = provenance_counts(provenance(traced, hollow, recipe))
    reports = counts.join(named.select("image_id", "source_path", "target"), "image_id")
    return pictures, reports
