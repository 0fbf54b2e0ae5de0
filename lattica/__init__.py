"""Core-periphery analytics over k-nearest-neighbour graphs, as PySpark DataFrame operators.

points -> edges -> scores -> core -> stable core -> labels -> membership -> layers -> layout -> figure.
Tables are long and keyed by explicit ids: points(id, features[, label]), edges(src, dst, pos, d2), scores(id, ...),
labels(id, label), layers(id, layer), membership(id, cls, score), layout(round, id, x, y).
"""

__version__ = "0.1.0"
