"""Faultline: analytics over the logs of failed automated tests, built on Spark DataFrames."""
