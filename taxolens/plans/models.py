"""Fitted steps: scaling, engineering and selection learnt on one table and applied to others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.functions.numeric import clean, yeo_johnson
from taxolens.operators import cluster, engineer, select


class NotFitted(RuntimeError):
    pass


@dataclass
class Scaler:
    """Scaling learnt on one table and applied to others.

    method: power (fitted exponents, then standard), robust, ensemble (half robust, three tenths power, two
    tenths standard); any other name is standard. Nulls, NaN and infinities stay out of the fit and become null.
    """

    method: str = "power"
    facts: dict[str, dict[str, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> Scaler:
        power = self.method in ("power", "ensemble")
        exponents = engineer.fit_exponents(df, columns) if power else {}
        made = []
        for i, c in enumerate(columns):
            x = clean(F.col(f"`{c}`"))
            parts = {"m": F.avg(x), "s": F.stddev_pop(x)}
            if power:
                y = yeo_johnson(x, exponents[c])
                parts |= {"pm": F.avg(y), "ps": F.stddev_pop(y)}
            made.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(f"c{i}"))
        row = df.agg(*made).first()
        quartiles = engineer.quantiles(df, columns, [0.25, 0.5, 0.75]) if self.method in ("robust", "ensemble") else {}
        self.facts = {c: row[f"c{i}"].asDict() | ({"exponent": exponents[c]} if power else {}) | ({"q": quartiles[c]} if quartiles else {}) for i, c in enumerate(columns)}
        return self

    def scaled(self, c: str) -> Column:
        if c not in self.facts:
            raise NotFitted("fit comes first")
        f, x = self.facts[c], clean(F.col(f"`{c}`"))
        standard = lambda v, m, s: (v - F.lit(m)) / F.lit(s or 1.0)
        robust = lambda: (x - F.lit(f["q"][1])) / F.lit((f["q"][2] - f["q"][0]) or 1.0) if f["q"][0] is not None else F.lit(None).cast("double")
        power = lambda: standard(yeo_johnson(x, f["exponent"]), f["pm"], f["ps"])
        if self.method == "power":
            return power()
        if self.method == "robust":
            return robust()
        if self.method == "ensemble":
            return 0.5 * robust() + 0.3 * power() + 0.2 * standard(x, f["m"], f["s"])
        return standard(x, f["m"], f["s"])

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.facts:
            raise NotFitted("fit comes first")
        return df.select(*[self.scaled(c).alias(c) if c in self.facts else F.col(f"`{c}`") for c in df.columns])


@dataclass
class FeatureEngineer:
    """Learns which columns the rules make from a table, so that later tables get the same ones.

    scaling: a method of Scaler, applied to all columns that come out; None leaves them as they are.
    """

    keep: tuple[str, ...] = ()
    columns: list[str] = field(default_factory=list)
    made: list[str] = field(default_factory=list)
    scaling: str | None = None
    scaler: Scaler | None = None

    def fit_transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        self.columns = columns or [c for c in engineer.numeric_columns(df) if c not in self.keep]
        out = engineer.engineer(df, self.columns, keep=self.keep)
        self.made = [c for c in out.columns if c not in self.keep]
        if self.scaling:
            self.scaler = Scaler(self.scaling).fit(out, self.made)
            out = self.scaler.transform(out)
        return out

    def info(self) -> dict:
        """Counts and names of what came in and what was added."""
        if not self.made:
            raise NotFitted("fit_transform comes first")
        new = [c for c in self.made if c not in self.columns]
        return {"n_original": len(self.columns), "n_total": len(self.made), "n_new": len(new), "new_features": new}


@dataclass
class FeatureSelector:
    """Scores all features of a labelled table by six scores and keeps the best; the kept names are in ascending score.

    With n_features beyond their number, all are scored. alternate: the second form of the scores (see
    select.six_scores), without dropping correlated columns first.
    """

    key: str
    label: str
    n_features: int = 100
    threshold: float = 0.95
    n_clusters: int = 35
    selected: list[str] = field(default_factory=list)
    ranking: list[tuple[str, float]] = field(default_factory=list)
    alternate: bool = False

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> FeatureSelector:
        columns = columns or [c for c in engineer.numeric_columns(df) if c not in (self.key, self.label)]
        if not self.alternate:
            kept = {r.feature for r in select.remove_correlated(df, columns, self.threshold).where("kept").collect()}
            columns = [c for c in columns if c in kept]
        vectors = df.select(self.key, F.array(*[F.coalesce(clean(F.col(f"`{c}`")), F.lit(0.0)) for c in columns]).alias("v"))
        k = max(2, min(self.n_clusters, vectors.count() // 10))
        labels = cluster.forced(vectors, "v", k, 10).select(self.key, "cluster")
        scores = select.six_scores(df, self.key, self.label, columns, labels, self.alternate)
        ranked = select.ensemble(scores, select.WEIGHTS).orderBy("rank").collect()
        self.ranking = [(r.feature, r.ensemble_score) for r in ranked]
        self.selected = [f for f, _ in self.ranking[: self.n_features]][::-1]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.selected:
            raise NotFitted("fit comes first")
        have = [c for c in (self.key, self.label) if c in df.columns]
        return df.select(*[F.col(f"`{c}`") for c in [*have, *self.selected]])

    def info(self) -> dict:
        if not self.selected:
            raise NotFitted("fit comes first")
        return {"n_selected": len(self.selected), "selected_features": self.selected, "scores": dict(self.ranking)}
