"""The generation flow (L1): read, profile, project, synthesise, format, compare.

``synthesize`` is the driver-side step that picks the method explicitly and says
which one ran; it never silently swaps models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.operators.copula import synthesize_copula
from facsimile.operators.synth import synthesize_independent
from facsimile.schema import MODELS, SynthConfig, check_unsupported


def select_strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, in the order asked; an unknown one is an error that names it."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.select(*[named(c) for c in columns])


def select_lenient(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Keep the asked-for columns that exist (source order); none exist -> all columns."""
    if not columns:
        return df
    keep = [c for c in df.columns if c in set(columns)]
    return df.select(*[named(c) for c in keep]) if keep else df


def default_projection(df: DataFrame, k: int = 5) -> DataFrame:
    """The first five columns, the default column selection."""
    return df.select(*[named(c) for c in df.columns[:k]])


def head(df: DataFrame, n: int | None, order: list[str] | None = None) -> DataFrame:
    """First n rows (None = all); with ``order`` the rows are well defined (top-k, no full sort)."""
    if n is None:
        return df
    return (df.orderBy(*order) if order else df).limit(int(n))


def with_row_number(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Row numbers for an already limited frame (display tables of at most a few hundred rows)."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def synthesize(df: DataFrame, config: SynthConfig | None = None,
               columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """(synthetic table, method used).

    ``config.method``: 'copula' (the default model, Gaussian copula), 'independent'
    (per-column marginals), or 'auto' (copula; independent if the copula cannot be
    fitted, and the returned method says so).  Deep generative models are not built.
    """
    cfg = config or SynthConfig()
    if cfg.model_type not in ("Gaussian Copula",) and cfg.method != "independent":
        if cfg.model_type in MODELS:
            raise NotImplementedError(f"{cfg.model_type} is not available; use 'Gaussian Copula' or 'independent'")
        raise ValueError(f"unknown model {cfg.model_type!r}")
    data = select_lenient(df, columns)
    check_unsupported(data)
    if data.isEmpty():
        raise ValueError("input table is empty")
    if cfg.method == "independent":
        return synthesize_independent(data, cfg), "independent"
    if cfg.method == "copula":
        return synthesize_copula(data, cfg), "copula"
    try:
        return synthesize_copula(data, cfg), "copula"
    except (ValueError, ArithmeticError):      # the marginals or their correlations cannot be modelled
        return synthesize_independent(data, cfg), "independent"


def run_generation(spark, input_path: str, output_dir: str | None = None, config: SynthConfig | None = None,
                   columns: list[str] | None = None, formats: tuple[str, ...] = ("csv", "json"),
                   header_row: int = 0):
    """The whole generation flow: read -> synthesize -> write -> report.

    Returns (synthetic DataFrame, method used, quality report DataFrame).  Outputs go to
    ``output_dir`` (a shared folder on a cluster) as ``synthetic_csv`` / ``synthetic_json``.
    """
    from facsimile.operators.quality import quality_report
    from facsimile.sources import io

    kw = {"header_row": header_row} if input_path.lower().endswith(".xlsx") else {}
    source = io.load_table(spark, input_path, **kw)
    if "source_file" in source.columns:
        source = source.drop("source_file")
    data = select_lenient(source, columns)
    fake, method = synthesize(data, config)
    if output_dir:
        if "csv" in formats:
            io.write_csv(fake, f"{output_dir}/synthetic_csv")
        if "json" in formats:
            io.write_json(fake, f"{output_dir}/synthetic_json")
        # read back what was written so the report scores the delivered table
        fake = io.read_csv(spark, f"{output_dir}/synthetic_csv") if "csv" in formats else fake
    return fake, method, quality_report(data, fake, method, (config or SynthConfig()).privacy_level)
