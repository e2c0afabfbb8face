"""clickloom: click-through-rate data preparation, features, training and scoring on Spark.

Every operator takes and returns DataFrames (or builds Columns), so a job is one declarative plan
that Catalyst optimises and the cluster runs.
"""

__version__ = "0.1.0"
