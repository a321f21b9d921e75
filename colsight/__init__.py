"""colsight: column profiling, association and linear modelling for Spark DataFrames."""

from colsight.errors import DatasetError

__all__ = ["DatasetError"]
__version__ = "0.1.0"
