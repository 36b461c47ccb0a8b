"""overhaul: analytics for a car-service shop, expressed as Spark DataFrame jobs.

Every public operator takes DataFrames (plus scalar parameters) and returns a
DataFrame. Nothing is collected to the driver; the work is planned by Catalyst
and executed by Spark (AQE picks join strategies from runtime sizes).
"""

from overhaul.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
