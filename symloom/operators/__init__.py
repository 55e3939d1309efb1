"""Relational, graph, selection and evaluation operators: DataFrame in, DataFrame out."""
