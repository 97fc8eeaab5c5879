"""tabclean: profile and clean tabular data with Spark DataFrames.

Every step is a DataFrame expression or aggregation; statistics that drive a
decision are fitted by one aggregate job and come back to the driver as a
small record, then go into the plan as literals.
"""

from tabclean.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
