"""Operators for preparing language-model training data.

Every operator takes DataFrames and gives a DataFrame.  The modules stand on
their own: nothing outside this folder imports them.
"""
