"""Queries that bind the operators to the test tables, each with SQL that gives the same rows where SQL can."""
