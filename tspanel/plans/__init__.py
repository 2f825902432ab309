"""Whole jobs: prepare a table, compare models, forecast with the winner."""
