"""Writers of results: Parquet keeps types, CSV and JSON are for people and other tools; and a case report."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text, as CSV needs."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_alerts(alerts: DataFrame, path: str, score: str = "composite_risk_score") -> None:
    """alerts as Parquet, CSV and JSON under path, the highest score first."""
    ordered = alerts.orderBy(F.col(score).desc(), alerts.columns[0])
    ordered.write.mode("overwrite").parquet(f"{path}/parquet")
    flat(ordered).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    ordered.write.mode("overwrite").json(f"{path}/json")


def case_report(alerts: DataFrame, entity_id: str, folder: str, key: str = "entity_id") -> str:
    """A Markdown report of one entity's alert; its path. ValueError for an unknown entity."""
    rows = alerts.where(F.col(key) == entity_id).limit(1).collect()
    if not rows:
        raise ValueError(f"no alert for {entity_id}")
    row = rows[0].asDict(recursive=True)
    lines = [f"# Case report: {entity_id}", ""] + [f"- **{c}**: {row[c]}" for c in alerts.columns if row[c] is not None]
    out = Path(folder) / f"case_{entity_id}.md"
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(lines) + "\n")
    return str(out)
