"""fleetsight: estate-audit analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a lazy
DataFrame built from native Spark expressions, so Catalyst can push filters
and projections into the scans and AQE can re-plan joins at run time.
"""

from fleetsight.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
