"""Table audits, feature preparation and next-purchase modelling on Spark DataFrames."""

__version__ = "0.1.0"
