"""Column roles, year-name rule and the synthesis configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values that decide behaviour (must stay as written).
BLANK_FILL = "Unknown"
LABEL_MAX_DISTINCT = 50          # ordinal label encoding up to this many distinct values
YEAR_MIN, YEAR_MAX = 1900, 2100  # value rule for year-like columns
YEAR_MAX_DISTINCT = 200          # ... and fewer distinct values than this
YES_NO = ("yes", "no", "unknown", "nan")
MALE_FEMALE = ("male", "female", "m", "f", "unknown", "nan")
TRUE_FALSE = ("true", "false", "unknown", "nan")
YES_NO_CODES = {"yes": 1, "no": 0, "unknown": 0, "nan": 0}
MALE_FEMALE_CODES = {"male": 1, "m": 1, "female": 0, "f": 0, "unknown": 0, "nan": 0}
TRUE_FALSE_CODES = {"true": 1, "false": 0, "unknown": 0, "nan": 0}
HASH_BUCKETS = 10000
PRIVACY_LABELS = {"Low": "Medium-Low", "Medium": "Medium", "High": "High"}
PRIVACY_DEFAULT = "Medium"
SIZE_LARGE, SIZE_MEDIUM = 100000, 50000
SCORE_GOOD, SCORE_MEDIUM = 0.8, 0.6
SHAPE_DEFAULT = 0.7
EPS = 1e-10
HIST_BINS = 20
MODELS = ("Gaussian Copula", "CTGAN", "CopulaGAN", "TVAE", "TabularGAN")


def is_numeric_type(dt: T.DataType) -> bool:
    """pandas ``select_dtypes(np.number)``: numbers but not booleans."""
    return isinstance(dt, T.NumericType)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric_type(dt):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    if is_temporal_type(dt):
        return "temporal"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def common_numeric_columns(original: DataFrame, synthetic: DataFrame) -> list[str]:
    """Numeric columns of the original that the synthetic table also has, source order."""
    other = set(synthetic.columns)
    return [c for c in numeric_columns(original) if c in other]


def is_year_name(name: str) -> bool:
    """Name part of the year-like rule."""
    low = name.lower()
    return low == "yr" or "date" in low or low.endswith("year") or low.startswith("year_")


def is_short_year_name(name: str) -> bool:
    """Name part of the short rule (display formatter): only 'year' and 'yr'."""
    return name.lower() in ("year", "yr")


def check_unsupported(df: DataFrame) -> None:
    bad = [f.name for f in df.schema.fields if kind_of(f.dataType) == "other"]
    if bad:
        raise TypeError(f"unsupported column types (nested/binary/interval): {bad}")


@dataclass
class ColumnSpec:
    """What the profile pass learned about one column."""

    name: str
    kind: str
    dtype: str
    count: int = 0                 # non-null values
    nulls: int = 0
    mean: float | None = None
    std: float | None = None
    min: object = None
    max: object = None
    distinct: int | None = None    # exact where it matters (<= EXACT_DISTINCT_LIMIT), else approximate
    distinct_exact: bool = False
    year_by_name: bool = False
    year_by_value: bool = False
    extra: dict = field(default_factory=dict)

    @property
    def is_year(self) -> bool:
        return self.year_by_name or self.year_by_value


@dataclass
class SynthConfig:
    """Parameters of a synthesis run.

    ``num_samples`` None means as many rows as the source.  ``seed`` is honoured: the
    same seed gives the same rows whatever the partitioning.  ``fast`` swaps the md5
    uniforms for xxhash64 ones (still partition independent, no SQL twin).
    """

    num_samples: int | None = None
    method: str = "copula"          # 'copula' (the default model) | 'independent' | 'auto'
    seed: int = 42
    privacy_level: str = "Medium"
    fast: bool = False
    year_rule_on: str = "source"    # 'source' | 'synthetic'
    keep_int: bool = False
    stringify: bool = False
    keep_id: bool = False
    model_type: str = "Gaussian Copula"
