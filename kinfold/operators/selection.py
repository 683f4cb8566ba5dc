"""What to keep and what to delete of each group."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STRATEGIES
from ..functions.scalar import in_dir
from .groups import MB, totals


def keep(members: DataFrame, strategy: str, prefer_dir: str | None = None, min_wasted_mb: float = 0) -> DataFrame:
    """Members with ``keep``: one per group by strategy, ties to the first place; an unknown strategy keeps the first."""
    first = {
        "highest_res": [F.desc(F.col("width").cast("long") * F.col("height"))] if "width" in members.columns else [],
        "largest": [F.desc("size")],
        "oldest": [F.asc("mod_unix")],
        "newest": [F.desc("mod_unix")],
        "prefer_dir": [F.when(in_dir(F.col("dir"), prefer_dir or ""), 0).otherwise(1)] if prefer_dir else [],
    }.get(strategy, [])
    group = Window.partitionBy("gid")
    out = members.withColumn("keep", F.row_number().over(group.orderBy(*first, "pos")) == 1)
    if min_wasted_mb > 0:
        wasted = F.sum("size").over(group) - F.max("size").over(group)
        out = out.withColumn("wasted", wasted).filter(F.col("wasted") / MB >= min_wasted_mb).drop("wasted")
    return out


def delete_plan(members: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths that are in the results; if all of a group are requested, its first member is spared."""
    marked = members.join(requested.select("path").distinct().withColumn("asked", F.lit(1)), "path", "left")
    all_asked = F.count("asked").over(Window.partitionBy("gid")) == F.count("*").over(Window.partitionBy("gid"))
    return marked.withColumn("whole", all_asked).filter("asked = 1 and not (whole and pos = 0)").drop("asked", "whole")


def prune(members: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups) after a deletion; groups of one vanish, gids stay."""
    left = members.join(deleted.select("path"), "path", "left_anti")
    groups = totals(left)
    return left.join(groups.select("gid"), "gid", "left_semi"), groups


class Rules:
    """Named strategies, in a JSON file or in memory; saving one of a known name replaces it."""

    def __init__(self, path: str | None = None):
        self.path, self.rules = path, {}
        if path:
            try:
                with open(path) as f:
                    self.rules = {r["name"]: r for r in json.load(f)}
            except (OSError, ValueError, KeyError, TypeError):
                self.rules = {}

    def save(self, name: str, strategy: str, prefer_dir: str = "", min_wasted_mb: float = 0) -> None:
        if not name.strip() or strategy not in STRATEGIES or (strategy == "prefer_dir" and not prefer_dir.strip()):
            raise ValueError("a rule needs a name, a known strategy and, for prefer_dir, a folder")
        self.rules[name] = {"name": name, "strategy": strategy, "prefer_dir": prefer_dir, "min_wasted_mb": min_wasted_mb}
        self._write()

    def delete(self, name: str) -> None:
        del self.rules[name]
        self._write()

    def list(self) -> list[dict]:
        return [self.rules[name] for name in sorted(self.rules)]

    def apply(self, name: str, members: DataFrame) -> DataFrame:
        r = self.rules[name]
        return keep(members, r["strategy"], r["prefer_dir"] or None, r["min_wasted_mb"])

    def _write(self) -> None:
        if self.path:
            with open(f"{self.path}.new", "w") as f:
                json.dump(list(self.rules.values()), f, indent=1)
            os.replace(f"{self.path}.new", self.path)  # readers see the old rules or the new ones
