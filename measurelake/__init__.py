"""measurelake - sensor-measurement quality and analytics on PySpark DataFrames."""

from measurelake.model import CleanupConfig, ColumnMap, FilterState

__all__ = ["CleanupConfig", "ColumnMap", "FilterState"]
__version__ = "0.1.0"
