"""seriesmith: trend analysis of irregular, multi-instrument series on Spark.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is executed until the caller runs an action.
"""
