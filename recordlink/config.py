"""What the engine needs to know about a table of records."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from recordlink.functions.distances import distance

# The default record schema. Column names, the distance of each
# column and the output names have to equal these for existing tables to load.
DEFAULT_MATCH_COL = "PRI"
DEFAULT_ID_COL = "GRDT_ID"
DEFAULT_DISTANCES = {
    "GVN_NAME": "EDIT_DISTANCE",
    "SRNM": "EDIT_DISTANCE",
    "PDOB": "EDIT_DISTANCE",
    "postal_code": "EQUALITY",
    "accuracy": "EQUALITY",
    "place_name": "EQUALITY",
    "state_code": "EQUALITY",
    "lat-long": "EUCLIDEAN",
    "EE_CMP": "EQUALITY",
    "LANG_CTZN_CMP": "EQUALITY",
    "ENABLED_IND": "EQUALITY",
    "EMPT_TYP_CMP": "EQUALITY",
    "EDUC_CMP": "EQUALITY",
    "RESM_CMP": "EQUALITY",
    "PSEA_IND": "EQUALITY",
    "EE_EMPT_IND": "EQUALITY",
    "TMPRY_RELOC_IND": "EQUALITY",
}
DEFAULT_TRANSPOSED_PAIR = ("GVN_NAME", "SRNM")
DEFAULT_DATETIME_COLS = ("CDT",)
DEFAULT_POSTAL_COL = "PSTCD"
DEFAULT_CLUSTER_COL = "CLUSTER_LABELS"
DEFAULT_DUPLICATE_COL = "DUPLICATE_LABELS"


@dataclass(frozen=True)
class RecordSpec:
    """Roles of the columns of a record table.

    ``distances`` maps each comparison column to the name of a registered
    distance; its order is the order of every distance vector.
    """

    id_col: str = DEFAULT_ID_COL
    match_col: str = DEFAULT_MATCH_COL
    distances: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_DISTANCES))
    transposed_pair: tuple[str, str] | None = DEFAULT_TRANSPOSED_PAIR
    datetime_cols: tuple[str, ...] = DEFAULT_DATETIME_COLS
    postal_col: str = DEFAULT_POSTAL_COL
    cluster_col: str = DEFAULT_CLUSTER_COL
    duplicate_col: str = DEFAULT_DUPLICATE_COL
    seed: int = 42

    @property
    def columns(self) -> list[str]:
        return list(self.distances)

    def on(self, columns: list[str]) -> "RecordSpec":
        """The same roles, comparing only ``columns``."""
        missing = [c for c in columns if c not in self.distances]
        if missing:
            raise ValueError(f"no distance given for columns {missing}")
        return replace(self, distances={c: self.distances[c] for c in columns})

    def validate(self, df: DataFrame) -> "RecordSpec":
        """Check the roles against the schema of ``df`` before any job runs."""
        for name in self.distances.values():
            distance(name)
        needed = [self.id_col, self.match_col, *self.columns]
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} are not in the table, which has {df.columns}")
        return self
