"""Relational, graph and evaluation operators over DataFrames."""
