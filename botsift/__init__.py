"""botsift: screening tables and streams of short posts for machine-written content on Spark.

Every operator takes and returns DataFrames or Columns; the work runs as Catalyst plans.
"""

from botsift.config import Profile, DEFAULT_PROFILE

__all__ = ["Profile", "DEFAULT_PROFILE"]
