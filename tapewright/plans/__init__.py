"""Whole jobs: training, evaluation, and the registered queries with the SQL that checks them."""
