"""Land-surface time-series and survey-statistics operators on Spark DataFrames."""

__version__ = "0.1.0"
