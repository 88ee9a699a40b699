"""propval: leakage-aware spatio-temporal feature and valuation analytics on Spark DataFrames."""

__version__ = "0.1.0"
