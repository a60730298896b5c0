"""Preparation, search and evaluation of lifelong behaviour data on Spark."""
