"""Scalar functions, parameter rules, embedders and the stemmer."""
