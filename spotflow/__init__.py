"""spotflow: particle-tracking analytics and corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"
