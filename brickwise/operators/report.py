"""Reports: data as nested structs, a Mustache subset, orders as zones, and result tables as JSON."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(r"\{\{(\{|[#^/!&]?)\s*([\w.]*)[^}]*?\}?\}\}")


def render(template: str, data: dict) -> str:
    """Variables (escaped; triple braces and & unescaped), sections over lists, dicts and truths, inverted sections, dotted
    names and comments."""

    def find(stack: list, name: str):
        if name == ".":
            return stack[-1]
        first, *rest = name.split(".")
        value = next((s[first] for s in reversed(stack) if isinstance(s, dict) and first in s), None)
        for part in rest:
            value = value.get(part) if isinstance(value, dict) else None
        return value

    def parse(at: int, until: str | None) -> tuple[list, int]:
        nodes = []
        while m := TAG.search(template, at):
            nodes.append(("text", template[at : m.start()], None))
            kind, name = m[1], m[2] or "."
            at = m.end()
            if kind in "#^" and kind:
                inner, at = parse(at, name)
                nodes.append((kind, name, inner))
            elif kind == "/":
                if name != until:
                    raise ValueError(f"section {until!r} is closed by {name!r}")
                return nodes, at
            elif kind != "!":
                nodes.append(("raw" if kind in ("{", "&") else "var", name, None))
        if until is not None:
            raise ValueError(f"section {until!r} isn't closed")
        return [*nodes, ("text", template[at:], None)], at

    def write(nodes: list, stack: list) -> str:
        out = []
        for kind, name, inner in nodes:
            if kind == "text":
                out.append(name)
                continue
            value = find(stack, name)
            if kind in ("var", "raw"):
                text = "" if value is None else str(value)
                out.append(html.escape(text) if kind == "var" else text)
            elif kind == "^":
                out.append("" if value else write(inner, stack))
            elif value:
                out += [write(inner, [*stack, v]) for v in (value if isinstance(value, list) else [value])]
        return "".join(out)

    return write(parse(0, None)[0], [data])


def zones_of_order(spark: SparkSession, order: dict) -> DataFrame:
    """(zone, x0, x1, y0, y1, z0, z1, max_size, max_count) of an inspection order's box zones; absent limits are null."""
    rows = []
    for z in order.get("acceptance", {}).get("zones", []):
        if "box_mm" not in z:
            raise ValueError(f"zone {z.get('name')!r} has no box")
        (x0, y0, z0), (x1, y1, z1) = z["box_mm"]
        size, count = z.get("max_pore_size_mm"), z.get("max_pore_count")
        rows.append((z["name"], *map(float, (x0, x1, y0, y1, z0, z1)), None if size is None else float(size), count))
    return spark.createDataFrame(rows, "zone string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, max_size double, max_count long")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document, made by the executors."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def first_article(rated: DataFrame) -> DataFrame:
    """One row of a first article's decision: counts by rating, and accepted if nothing failed or wasn't measured."""
    n = lambda r: F.count(F.when(F.col("rating") == r, F.lit(1)))
    return rated.agg(n("pass").alias("passed"), n("fail").alias("failed"), n("not measured").alias("not_measured"), n("unrated").alias("unrated")).withColumn("accepted", (F.col("failed") == 0) & (F.col("not_measured") == 0))


def battery_report(samples: DataFrame, limits: dict) -> DataFrame:
    """(criterion, measured, bound, ok) of overhang samples (overhang_mm, edge): least and largest overhang and the spread
    of an edge, against the limits that are given."""
    edges = samples.groupBy("edge").agg(F.min("overhang_mm").alias("lo"), F.max("overhang_mm").alias("hi"))
    m = edges.agg(F.min("lo").alias("min_overhang_mm"), F.max("hi").alias("max_overhang_mm"), F.max(F.col("hi") - F.col("lo")).alias("max_edge_spread_mm"))
    rows = F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("measured"), F.lit(float(v)).alias("bound"), (~(F.col(k) < v) if k.startswith("min") else ~(F.col(k) > v)).alias("ok")) for k, v in sorted(limits.items())])
    return m.select(F.explode(rows).alias("r")).select("r.*")


def statistics(rows: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row of (n, mean, deviation, least, most) of a value, weighted if a weight is given."""
    v, w = F.col(value), F.lit(1.0) if weight is None else F.col(weight)
    some = rows.where(v.isNotNull())
    mean = F.sum(v * w) / F.sum(w)
    return some.agg(F.count("*").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum(v * v * w) / F.sum(w) - mean * mean, F.lit(0.0))).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"))


def sections(dataset: DataFrame, pores: DataFrame | None = None, compared: DataFrame | None = None, labels: DataFrame | None = None, fibres: DataFrame | None = None, thickness: DataFrame | None = None, tolerance: float = 0.1, min_wall: float = 0.0) -> DataFrame:
    """(section, json) of a report: the volume, and porosity, comparison, materials, fibres and wall thickness as far as
    they are there. Every section is an aggregate."""
    row = lambda name, df: df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json"))
    out = row("volume", dataset.agg(F.count("*").alias("voxels"), *[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"], F.min("grey").alias("least"), F.max("grey").alias("most")))
    if pores is not None:
        key = "component" if "component" in pores.columns else "key"
        size = next((c for c in ("equivalent", "equivalent_diameter") if c in pores.columns), "n")
        out = out.union(row("porosity", pores.agg(F.count("*").alias("pores"), F.sum("n").alias("voxels"), F.max(size).alias("largest"), F.max_by(key, F.struct(size, -F.col(key))).alias("largest_id"))))
    if compared is not None:
        within = compared.agg(F.avg((F.abs(F.col("distance")) <= tolerance).cast("double")).alias("within"))
        out = out.union(row("comparison", statistics(compared, "distance", "area" if "area" in compared.columns else None).join(within)))
    if labels is not None:
        out = out.union(row("materials", labels.groupBy("material").agg(F.count("*").alias("voxels"))))
    if fibres is not None:
        from brickwise.operators.filters import orientation_tensor

        out = out.union(row("fibres", orientation_tensor(fibres)))
    if thickness is not None:
        thin = thickness.agg(F.avg((F.col("thickness") < min_wall).cast("double")).alias("thin"))
        out = out.union(row("wall_thickness", statistics(thickness, "thickness").join(thin)))
    return out


class Telemetry:
    """Times and Spark metrics of the phases of a run: (phase, seconds, jobs, tasks, hint), from Spark's own counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def measure(self, phase: str, work):
        """Run work() as a phase and keep its result; its jobs are named after the phase."""
        import time

        context = self.spark.sparkContext
        tracker, group = context.statusTracker(), f"phase-{len(self.rows)}-{phase}"
        context.setJobGroup(group, phase)
        began = time.perf_counter()
        try:
            return work()
        finally:
            took = time.perf_counter() - began
            jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j is not None]
            stages = [s for s in (tracker.getStageInfo(k) for j in jobs for k in j.stageIds) if s is not None]
            tasks, failed = sum(s.numTasks for s in stages), sum(s.numFailedTasks for s in stages)
            hint = "tasks failed and were repeated" if failed else "one task did the work" if took > 5 and tasks <= len(stages) else ""
            self.rows.append((phase, took, len(jobs), tasks, hint))
            context.setLocalProperty("spark.jobGroup.id", None)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "phase string, seconds double, jobs int, tasks int, hint string")
