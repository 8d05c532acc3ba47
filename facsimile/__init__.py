"""facsimile: synthetic tabular data on Spark.

Profile a table, clean and encode it, draw a synthetic table of any size that keeps
the source's marginals (and, with the Gaussian copula, its correlations), format the
result and score how close it is.  Every step is a DataFrame -> DataFrame function;
the row work runs on the executors and only per-column summaries reach the driver.
"""

from facsimile.schema import ColumnSpec, SynthConfig
from facsimile.session import get_session, scratch_path

__all__ = ["ColumnSpec", "SynthConfig", "get_session", "scratch_path"]
