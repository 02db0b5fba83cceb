"""tieout - source-to-target data mapping and migration assurance on Spark."""

__version__ = "0.1.0"
