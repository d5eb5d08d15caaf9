"""recordfold: reviewing and coding case records with Spark DataFrames.

Every public operator is a function DataFrame(s) -> DataFrame built on Spark's
own expressions, so Catalyst can prune, push down and plan the whole job.
"""

__version__ = "0.1.0"
