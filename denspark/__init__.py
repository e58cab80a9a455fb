"""Exact density-based clustering of numeric points on Spark DataFrames."""




from denspark.plans.cluster import dbscan
from denspark.plans.estimator import SparkDBSCAN

__all__ = ["MAX_DIMS", "MIN_DIMS", "SparkDBSCAN", "__version__", "dbscan"]
__version__ = "0.1.0"

#: Dimensions that are accepted without an override.
MIN_DIMS, MAX_DIMS = 2, 20
