"""Scenes of few points as one task's work each: a scene's points are dealt once, and its neighbours are found in arrays.

Scenes of more points, or of so dense ones that a task would compare too many, are left to the joins on cells (``neighbors``); both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenequarry.operators.camera import small
from scenequarry.operators.cloud import XYZ
from scenequarry.operators.stored import remove_stored, stored

#: Points of a scene, and pairs of them that may be near each other, up to which one task takes it.
KEEP, PAIRS = 65_536, 1 << 22


def by_scene(points: DataFrame, work: Callable[..., pd.DataFrame | None], schema: str, rest: Callable[[DataFrame], DataFrame], keep: int = KEEP, marks: DataFrame | None = None) -> DataFrame:
    """Rows ``(scene_id, schema)`` of ``work`` for each scene of ``points(scene_id, id, x, y, z)``, and of ``rest`` for scenes of more than ``keep`` points and those that ``work`` answers None for.

    ``work`` gets a scene's points by rising id, ids unique and places finite, and with ``marks(scene_id, id)`` the ids that are marked, each once.
    """
    points = points.select("scene_id", "id", *XYZ)
    sizes = stored(points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("__n")), "scene-sizes")
    large = sizes.where(F.col("__n") > keep).select("scene_id")
    few = points if large.isEmpty() else points.join(small(large), "scene_id", "left_anti")
    names = [part.split()[0] for part in schema.split(", ")]
    if marks is not None:
        few = few.withColumn("marked", F.lit(False)).unionByName(marks.select("scene_id", "id", F.lit(True).alias("marked")), allowMissingColumns=True)

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        scene, found, marked = frame.scene_id.iloc[0], None, []
        if "marked" in frame:
            marked, frame = [frame.id[frame.marked]], frame[~frame.marked]
        if frame.id.is_unique and np.isfinite(frame[list(XYZ)].to_numpy(float)).all():
            found = work(frame.sort_values("id", ignore_index=True), *marked)
        # A scene that is left open is a row without values.
        found = pd.DataFrame({n: pd.Series([None], dtype=object) for n in names}) if found is None else found.assign(settled=True)
        return found.assign(scene_id=scene, settled=found.get("settled", False))[["scene_id", *names, "settled"]]

    kind = points.schema["scene_id"].dataType.simpleString()
    found = stored(few.groupBy("scene_id").applyInPandas(settle, f"scene_id {kind}, {schema}, settled boolean"), "scenes")
    done = found.where("settled").drop("settled")
    open_ = large.unionByName(found.where("NOT settled").select("scene_id"))
    if open_.isEmpty():
        remove_stored(points.sparkSession, sizes)
        return done
    open_ = stored(open_, "open-scenes")
    return done.unionByName(rest(points.join(small(open_), "scene_id", "left_semi")).select("scene_id", *names))


def near_in_scene(at: np.ndarray, radius: float, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(i, j, d2)`` of all rows of ``at`` with a squared distance up to ``radius`` squared, both ways and each row with itself; None where more than ``pairs`` would be compared.

    Rows are sorted by cells of a little more than the radius; a row meets the nine stretches of three cells around its own.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # Beyond that, rounding could move a row by more than what cells are too large.
    if not radius > 0 or np.abs(at).max() > 1e12 * radius:
        return None
    cell = np.floor((at - at.min(axis=0)) / (radius * 1.01)).astype(np.int64) + 1
    deep, wide = int(cell[:, 2].max()) + 2, int(cell[:, 1].max()) + 2
    if (int(cell[:, 0].max()) + 2) * deep * wide >= 1 << 62:
        return None
    key = (cell[:, 0] * wide + cell[:, 1]) * deep + cell[:, 2]
    order = np.argsort(key, kind="stable")
    around = np.array([(a * wide + b) * deep for a in (-1, 0, 1) for b in (-1, 0, 1)])
    middle = key[:, None] + around
    low = np.searchsorted(key[order], middle - 1, "left").ravel()
    size = np.searchsorted(key[order], middle + 1, "right").ravel() - low
    if (total := int(size.sum())) > pairs:
        return None
    i = np.repeat(np.arange(len(at)), size.reshape(-1, 9).sum(axis=1))
    j = order[np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)]
    apart = at[i] - at[j]
    d2 = apart[:, 0] * apart[:, 0] + apart[:, 1] * apart[:, 1] + apart[:, 2] * apart[:, 2]
    near = d2 <= radius**2
    return i[near], j[near], d2[near]


def nearest_in_scene(frame: pd.DataFrame, k: int, radius: float) -> pd.DataFrame | None:
    """Edges a < b from each point to its ``k`` nearest within ``radius``; of equals the lower id."""
    if (met := near_in_scene(frame[list(XYZ)].to_numpy(float), radius)) is None:
        return None
    i, j, d2 = (v[met[0] != met[1]] for v in met)
    order = np.lexsort((j, d2, i))
    i, j = i[order], j[order]
    # The place of a pair among those of its first point.
    kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    edges = np.unique(np.minimum(i, j)[kept] * len(frame) + np.maximum(i, j)[kept])
    ids = frame.id.to_numpy()
    return pd.DataFrame({"a": ids[edges // len(frame)], "b": ids[edges % len(frame)]})


def wireframe_in_scene(frame: pd.DataFrame, marked: pd.Series, voxel: float, half_range: float, k: int, radius: float) -> pd.DataFrame | None:
    """Edges over the first point of each voxel (``cloud.first_per_voxel``) and the marked ones."""
    at = frame[list(XYZ)].to_numpy(float)
    inside = np.flatnonzero(((at >= -half_range) & (at < half_range)).all(axis=1))
    chosen = frame.id.isin(marked).to_numpy()
    chosen[inside[~pd.DataFrame(np.floor(at[inside] / voxel).astype(np.int64)).duplicated().to_numpy()]] = True
    return nearest_in_scene(frame[chosen].reset_index(drop=True), k, radius)


def clusters_in_scene(frame: pd.DataFrame, radius: float, least: int) -> pd.DataFrame | None:
    """Density clusters of a scene, numbered by their least core id, -1 for noise."""
    if (met := near_in_scene(frame[list(XYZ)].to_numpy(float), radius)) is None:
        return None
    (i, j), n = met[:2], len(frame)
    core = np.bincount(i, minlength=n) >= least
    linked = core[i] & core[j]
    a, b, label = i[linked], j[linked], np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, label[a], label[b])
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    # A point that is no core joins the least component that it touches.
    best = np.where(core, label, n)
    touched = ~core[i] & core[j]
    np.minimum.at(best, i[touched], label[j[touched]])
    roots = np.unique(label[core])
    return pd.DataFrame({"id": frame.id, "cluster": np.where(best < n, np.searchsorted(roots, best), -1).astype(np.int32)})
