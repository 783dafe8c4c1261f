"""townrisk: Spark-native small-area risk scoring.

Four independent 0-100 axes (safety, flood, tide, ground) per area, raw
evidence and coverage flags, built entirely from DataFrame / SQL jobs.
"""

__version__ = "0.1.0"
