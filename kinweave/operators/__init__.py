"""Operators on follow events, edges and distances: DataFrame in, DataFrame out."""
