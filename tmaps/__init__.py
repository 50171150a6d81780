"""tmaps — neighbour embedding (t-SNE, Barnes-Hut, multiple maps) as Spark DataFrame jobs.

Every operator takes and returns DataFrames.  Pairwise work is spread over
block pairs, per-point state lives in keyed DataFrames, and only scalars
(row counts, Z, losses, means) ever reach the driver.
"""

from tmaps.params import TSNEParams

__all__ = ["TSNEParams"]
