"""Graph operators on DataFrames.

A graph is `edges(eid long, src long, dst long, weight long or double)`, with `vertices(id long)` where vertices
without edges matter. Parallel edges and self-loops are rows like any other; eid tells them apart.
"""
