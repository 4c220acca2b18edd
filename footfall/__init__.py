"""footfall: behaviour analytics over event, order and user tables, on Spark.

Every operator takes DataFrames and returns DataFrames.  The work is declared
with the DataFrame API and runs on the cluster.
"""
