"""Column-expression helpers shared by the operators."""

from tmaps.functions.columns import gaussian_col, sq_distance_col, norm_col

__all__ = ["gaussian_col", "sq_distance_col", "norm_col"]
