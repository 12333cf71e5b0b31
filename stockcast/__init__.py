"""Retail demand forecasting and inventory analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames, works on all series at
once, and takes the clock as an ``as_of`` argument.
"""
