"""churnwise: customer-churn analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames and stays lazy; the driver only
ever holds a fitted tree, its importances and a handful of scalars.
"""

from churnwise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
