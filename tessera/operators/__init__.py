"""Relational, interval, sequence and evidence operators: DataFrame in, DataFrame out."""
