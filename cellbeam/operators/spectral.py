"""Radial spectra of images, one image per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def radial_spectrum(images: DataFrame, image: str = "image_id") -> DataFrame:
    """``image_id, radius, magnitude``: mean magnitude of the centred 2-D transform by whole radius."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1))
        a[pdf["row"].to_numpy(int), pdf["col"].to_numpy(int)] = pdf["value"].to_numpy(float)
        f = np.abs(np.fft.fftshift(np.fft.fftn(a, norm="forward")))
        r, c = np.indices(a.shape)
        radius = np.rint(np.hypot(r - a.shape[0] // 2, c - a.shape[1] // 2)).astype(int)
        n = np.bincount(radius.ravel())
        return pd.DataFrame({image: pdf[image].iloc[0], "radius": np.arange(len(n)), "magnitude": np.bincount(radius.ravel(), f.ravel()) / np.maximum(n, 1)})

    return images.select(image, "row", "col", "value").groupBy(image).applyInPandas(run, f"{image} long, radius int, magnitude double")


def spectrum_loss(a: DataFrame, b: DataFrame, middle: float, slope: float = 1.0) -> DataFrame:
    """Mean squared gap of two spectra, weighted by a logistic function of the radius."""
    from pyspark.sql import functions as F

    j = a.join(b.select("image_id", "radius", F.col("magnitude").alias("other")), ["image_id", "radius"])
    w = 1 / (1 + F.exp(-(F.col("radius") - middle) * slope))
    return j.groupBy("image_id").agg(F.avg(w * F.pow(F.col("magnitude") - F.col("other"), 2)).alias("loss"))
