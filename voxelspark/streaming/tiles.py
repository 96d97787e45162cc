"""Images blended over time as a stream: the history of each tile of the image, with a border around it, is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_OUT = "frame int, x int, y int, r double, g double, b double, a double"
#: Channels of the history: luma, two of chroma, and a.
_CHANNELS = 4


def _around(v: np.ndarray) -> list[np.ndarray]:
    """The left, right, upper and lower neighbours of each place, 0 outside."""
    wide = np.pad(v, 1)
    return [wide[1:-1, :-2], wide[1:-1, 2:], wide[:-2, 1:-1], wide[2:, 1:-1]]


def _taps(history: np.ndarray, hx: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """The history at places (columns ``hx``, rows ``hy``) by the four pixels around, 0 outside."""
    x, y = np.floor(hx).astype(int), np.floor(hy).astype(int)
    fx, fy = hx - x, hy - y
    wide = np.pad(history, ((1, 1), (1, 1), (0, 0)))
    rows, cols = history.shape[:2]
    at = lambda i, j: wide[np.clip(y + j + 1, 0, rows + 1), np.clip(x + i + 1, 0, cols + 1)]
    return sum(at(i, j) * ((fx if i else 1 - fx) * (fy if j else 1 - fy))[..., None] for i in (0, 1) for j in (0, 1))


class TileHistory(StatefulProcessor):
    """State of a tile: the last frame, its blended pixels, and how far around the tile they still hold.

    Each frame that is blended uses up the border by the reach of its displacements, as what comes from beyond it is unknown; a
    cut begins anew.  State that no row has come for in ``idle_ms`` goes."""

    def __init__(self, blend: float, tile: int, halo: int, width: int, height: int, idle_ms: int | None):
        self.blend, self.tile, self.halo, self.width, self.height, self.idle_ms = blend, tile, halo, width, height, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "frame int, margin int, pixels binary", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))  # a tile and its border, for each frame of the batch
        edge, x0, y0 = self.tile + 2 * self.halo, key[0] * self.tile - self.halo, key[1] * self.tile - self.halo
        history, margin = None, self.halo
        if self.state.exists():
            _, margin, pixels = self.state.get()
            history = np.frombuffer(pixels, "<f8").reshape(edge, edge, _CHANNELS)
        for frame, part in found.groupby("frame", sort=True):
            x, y = part["x"].to_numpy() - x0, part["y"].to_numpy() - y0
            now, move = np.zeros((edge, edge, _CHANNELS)), np.zeros((edge, edge, 2))
            r, g, b = (part[c].to_numpy(float) for c in "rgb")
            t = b + (r - b) * 0.5
            now[y, x] = np.stack([t + (g - t) * 0.5, r - b, g - t, part["a"].to_numpy(float)], axis=1)
            move[y, x] = part[["dx", "dy"]].to_numpy(float)
            if bool(part["cut"].any()):
                history = None
            if history is None:
                blended, margin = now.copy(), self.halo
            else:
                margin -= int(np.ceil(np.abs(move).max())) + 1
                if margin < 0:
                    raise ValueError(f"frame {frame} reaches beyond the border of {self.halo} pixels: more are needed, or an earlier cut")
                blended = self._step(now, move, history, x0, y0)
            blended[..., 3] = now[..., 3] > 0
            inside = np.zeros((edge, edge), bool)
            inside[y, x] = True
            history = np.where(inside[..., None], blended, 0.0)
            yield self._shown(int(frame), history, inside, x0, y0)
        self.state.update((int(found["frame"].max()), margin, history.astype("<f8").tobytes()))

    def _step(self, now: np.ndarray, move: np.ndarray, history: np.ndarray, x0: int, y0: int) -> np.ndarray:
        rows, cols = np.indices(now.shape[:2])
        hx, hy = cols - move[..., 0], rows + move[..., 1]
        past = _taps(history, hx, hy)
        on = (hx + x0 >= -0.5) & (hx + x0 <= self.width - 0.5) & (hy + y0 >= -0.5) & (hy + y0 <= self.height - 0.5)
        response = np.where(~on | (past[..., 3] > 0) | (now[..., 3] > 0), 1.0, self.blend)
        share = np.minimum(np.sqrt((move**2).sum(axis=2)) * 0.5, 1.0)
        out = np.empty_like(now)
        for c in range(3):
            own, h = now[..., c], past[..., c]
            near = [own, *_around(own)]
            h = h + (np.clip(h, np.minimum.reduce(near), np.maximum.reduce(near)) - h) * share
            out[..., c] = h + (own - h) * response
        return out

    def _shown(self, frame: int, image: np.ndarray, inside: np.ndarray, x0: int, y0: int) -> pd.DataFrame:
        core = slice(self.halo, self.halo + self.tile)
        y, x = np.nonzero(inside[core, core])
        lum, co, cg, a = image[core, core][y, x].T
        t = lum - cg * 0.5
        b = t - co * 0.5
        shown = {"r": co + b, "g": cg + t, "b": b}
        return pd.DataFrame({"frame": np.int32(frame), "x": (x + self.halo + x0).astype(np.int32), "y": (y + self.halo + y0).astype(np.int32), **shown, "a": a})


def blend_tiles(pixels: DataFrame, blend: float, width: int, height: int, tile: int = 16, halo: int = 16, idle_ms: int | None = None) -> DataFrame:
    """Each image of a stream blended with its history, as by ``image.temporal_step``, from ``(frame, x, y, r, g, b, dx, dy, a)`` and maybe
    ``cut``, which begins the history anew; frames come in order, all pixels of a frame in one batch.

    A pixel goes to its own tile and to those within ``halo`` of it, so a tile needs no other tile's state.  The border must be as
    wide as the displacements since the last cut reach: the greatest, rounded up, and one, for each frame; else the query
    fails.  State is kept in RocksDB; it goes after ``idle_ms`` without rows, for which the stream then runs on without data
    too: give it a trigger with an interval."""
    spark = pixels.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cut = F.coalesce(F.col("cut"), F.lit(False)) if "cut" in pixels.columns else F.lit(False)
    near = lambda c, most: F.sequence(F.greatest(F.floor((F.col(c) - halo) / tile), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + halo) / tile), F.lit((most - 1) // tile)).cast("int"))
    rows = pixels.select(F.col("frame").cast("int").alias("frame"), "x", "y", *[F.col(c).cast("double").alias(c) for c in ("r", "g", "b", "dx", "dy", "a")], cut.alias("cut"))
    rows = rows.withColumn("tx", F.explode(near("x", width))).withColumn("ty", F.explode(near("y", height)))
    processor = TileHistory(blend, tile, halo, width, height, idle_ms)
    return rows.groupBy("tx", "ty").transformWithStateInPandas(processor, _OUT, "Append", "None" if idle_ms is None else "ProcessingTime")
