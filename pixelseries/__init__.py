"""Pixel time series, terrain grids and forecasting samples as Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame; chain them with
``df.transform``.  Column helpers live in ``functions``, readers and writers in
``sources``, operators in ``operators`` and multi-step builds in ``plans``.
"""
