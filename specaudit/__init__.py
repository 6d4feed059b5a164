"""Tests of whether a predictor carries signal specific to named feature sets, on Spark DataFrames."""
