"""Cell-table operators for gridded observations on Spark.

A raster is a DataFrame of cells ``(r, c, value...)``; every operator is a
function from DataFrames to a DataFrame, or from Columns to a Column.
"""
