"""Six features of a record and an isolation forest over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.dates import is_suspicious
from ..functions.numbers import anomaly_level, anomaly_score, lenient_number
from ..functions.text import strip
from .extraction import owner_count

FEATURES = V.ANOMALY_FEATURES


def _number(df: DataFrame, *names: str) -> Column:
    """The first of the columns that the frame has and that reads as a number."""
    there = [lenient_number(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _supplied(df: DataFrame, name: str, otherwise: Column, broken: float) -> Column:
    """A value that came with the record, held to 0..1; else what the record itself says."""
    if name not in df.columns:
        return otherwise
    n = F.coalesce(lenient_number(F.col(name).cast("string")), F.lit(broken))
    return F.when(F.col(name).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))).otherwise(otherwise)


def hectares(df: DataFrame) -> Column:
    parts = [_number(df, "area"), _number(df, "area_hectares"), _number(df, "area_acres") * 0.404686, _number(df, "area_sqm") / 10000, _number(df, "land_area")]
    return F.coalesce(*parts)


def features(df: DataFrame) -> DataFrame:
    """The six features as columns f_NAME."""
    area = hectares(df)
    owners = F.coalesce(_number(df, "number_of_owners", "owner_count", "owners", "num_owners", "owners_count"), F.nullif(owner_count(_text(df, "owner_name")), F.lit(0)).cast("double"))
    owners = F.when(owners > 0, owners).otherwise(1.0)
    mutations = _number(df, "mutation_frequency", "mutation_count", "mutations", "mutations_per_year")
    mutations = F.when(mutations >= 0, mutations).otherwise(0.0)
    fault = lambda c, p: F.when(c, p).otherwise(0.0)
    consistency = F.greatest(F.lit(0.0), 1 - fault(area <= 0, 0.5) - fault(owners > 100, 0.3) - fault(_number(df, "market_value") < 0, 0.4) - fault(_number(df, "stamp_duty") < 0, 0.4))
    unusual = F.when(area.isNull(), 0.3).when(area <= 0, 1.0).when(area > 1000, 0.9).when(area < 0.0001, 0.7).otherwise(0.0)
    a, b = F.lower(strip(_text(df, "owner_name"))), F.lower(strip(_text(df, "co_owner_name")))
    patterns = F.least(F.lit(1.0), fault((a != "") & (a == b), 0.4) + fault(is_suspicious(_text(df, "registration_date")), 0.5) + fault(mutations > 10, 0.4))
    return df.withColumns({
        "f_area": F.when(area.isNull(), 0.0).when(area < 0, -1.0).otherwise(F.log1p(area)),
        "f_number_of_owners": owners,
        "f_mutation_frequency": mutations,
        "f_numeric_field_consistency": _supplied(df, "numeric_field_consistency", consistency, 1.0),
        "f_unusual_area_values": _supplied(df, "unusual_area_values", unusual, 0.0),
        "f_unusual_record_patterns": _supplied(df, "unusual_record_patterns", patterns, 0.0),
    })


def training_rows(n: int = V.TRAINING_ROWS, contamination: float = V.CONTAMINATION, seed: int = V.TRAINING_SEED) -> np.ndarray:
    """Made-up normal and anomalous feature rows.

    Their distributions are the original's; another generator of random numbers draws
    them, so rows, trees and scores are near its own and not equal to them.
    """
    rng = np.random.default_rng(seed)
    bad = max(1, int(n * contamination))
    good = n - bad
    few, odd = V.NORMAL_ROWS, V.ODD_ROWS
    normal = np.column_stack([
        np.log1p(rng.uniform(*few["area"], good)), rng.choice(few["owners"], good, p=few["owner_shares"]), rng.poisson(few["mutations"], good),
        rng.uniform(*few["consistency"], good), np.zeros(good), rng.uniform(*few["patterns"], good),
    ])
    odd_rows = np.column_stack([
        rng.choice([*odd["log_area"], np.log1p(odd["large_area"])], bad), rng.choice(odd["owners"], bad), rng.uniform(*odd["mutations"], bad),
        rng.uniform(*odd["consistency"], bad), rng.choice(odd["area_values"], bad), rng.uniform(*odd["patterns"], bad),
    ])
    return np.vstack([normal, odd_rows]).astype(float)


def _depth(m: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among m."""
    m = np.asarray(m, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(m == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes as arrays; children of k stand at left[k] and left[k] + 1, a leaf has left 0."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    rest: np.ndarray

    def path(self, x: np.ndarray) -> np.ndarray:
        at, depth = np.zeros(len(x), int), np.zeros(len(x))
        while (go := self.left[at] > 0).any():
            k = at[go]
            at[go] = self.left[k] + (x[go, self.feature[k]] >= self.value[k])
            depth[go] += 1
        return depth + self.rest[at]


def grow(x: np.ndarray, rng: np.random.Generator, height: int) -> Tree:
    feature, value, left, rest = [0], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        k, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= height or not len(spread):
            rest[k] = float(_depth(len(rows)))
            continue
        f = int(rng.choice(spread))
        v = rng.uniform(rows[:, f].min(), rows[:, f].max())
        feature[k], value[k], left[k] = f, v, len(feature)
        for side in (rows[rows[:, f] < v], rows[rows[:, f] >= v]):
            todo.append((len(feature), side, depth + 1))
            feature.append(0), value.append(0.0), left.append(0), rest.append(0.0)
    return Tree(np.array(feature), np.array(value), np.array(left), np.array(rest))


@dataclass
class Forest:
    trees: list[Tree]
    size: int
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        mean = np.mean([t.path(x) for t in self.trees], axis=0)
        return -np.exp2(-mean / _depth(self.size)) - self.offset


def fit(x: np.ndarray, trees: int = 100, contamination: float = 0.05, seed: int = 42) -> Forest:
    """A forest from a bounded sample of rows (all of x in use is min(256, rows) per tree)."""
    if len(x) < 10:
        raise ValueError("an isolation forest needs ten rows or more")
    rng = np.random.default_rng(seed)
    size = min(256, len(x))
    out = Forest([grow(x[rng.choice(len(x), size, replace=False)], rng, int(np.ceil(np.log2(size)))) for _ in range(trees)], size)
    out.offset = float(np.quantile(out.raw(x), contamination))
    return out


def score(df: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """Records with anomaly_score, anomaly_level and anomaly_flag; the forest is sent to executors once."""
    model = df.sparkSession.sparkContext.broadcast(forest or fit(training_rows()))

    @F.pandas_udf("double")
    def raw(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series(model.value.raw(np.nan_to_num(np.column_stack([a, b, c, d, e, f]))))

    out = features(df).withColumn("anomaly_score", anomaly_score(raw(*[F.col(f"f_{n}") for n in FEATURES])))
    return out.withColumn("anomaly_level", anomaly_level(F.col("anomaly_score"))).withColumn("anomaly_flag", F.col("anomaly_score") >= threshold)
