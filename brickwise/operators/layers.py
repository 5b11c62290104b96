"""Battery layers: tracks of layer peaks over sections and angles, and the overhang of anodes over cathodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def track_layers(peaks: DataFrame, by: list[str], step: str, at: str, reach: float) -> DataFrame:
    """peaks with track: peaks of neighbouring steps of a group that are nearest to one another within a reach are one
    layer. A group, one edge and section, is a kernel."""
    schema = peaks.schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields) + ", track int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([step, at], ignore_index=True)
        track = np.full(len(pdf), -1)
        ends: dict[int, float] = {}
        fresh = 0
        last = None
        for s, rows in pdf.groupby(step, sort=True).groups.items():
            if last is not None and s != last + 1:
                ends = {}
            values = pdf.loc[rows, at].to_numpy(float)
            pairs = sorted((abs(v - e), k, t) for k, v in enumerate(values) for t, e in ends.items() if abs(v - e) <= reach)
            used: set[int] = set()
            taken: set[int] = set()
            for _, k, t in pairs:
                if k not in used and t not in taken:
                    track[rows[k]] = t
                    used.add(k)
                    taken.add(t)
            for k in range(len(values)):
                if k not in used:
                    track[rows[k]] = fresh
                    fresh += 1
            ends = {int(track[rows[k]]): values[k] for k in range(len(values))}
            last = s
        return pdf.assign(track=track.astype(np.int32))

    return peaks.groupBy(*by).applyInPandas(run, out)


def overhang(ends: DataFrame, usual: float) -> DataFrame:
    """(edge, section, layer, overhang) of layer ends (edge, section, layer, kind, across, end): a cathode's end against
    those of its anode neighbours at the usual spacing within 40 %; the smaller one counts, and it is negative
    where the cathode sticks out."""
    c = ends.where("kind = 'cathode'").select("edge", "section", "layer", F.col("across").alias("at"), F.col("end").alias("cathode_end"))
    a = ends.where("kind = 'anode'").select("edge", "section", F.col("across").alias("anode_at"), F.col("end").alias("anode_end"))
    near = c.join(a, ["edge", "section"]).where(F.abs(F.abs(F.col("at") - F.col("anode_at")) - usual) <= 0.4 * usual)
    return near.groupBy("edge", "section", "layer").agg(F.min(F.col("anode_end") - F.col("cathode_end")).alias("overhang"))


def stray_ends(samples: DataFrame, limit: float) -> DataFrame:
    """samples (edge, section, layer, end) further than a limit from the upper median end of their edge."""
    from brickwise.operators.histogram import upper_median

    usual = upper_median(samples, "end", ["edge"])
    return samples.join(usual, "edge").where(F.abs(F.col("end") - F.col("median")) > limit).drop("median")
