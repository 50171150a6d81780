"""Hyper-parameters of the embedding jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TSNEParams:
    # Fixed default values that must equal the reference's for the same results:
    # early_exaggeration 50, exaggeration_factor 4.0, t_momentum 250,
    # initial_momentum 0.5, final_momentum 0.8, eta 250.0, etw 100.0,
    # min_gain 0.01, zoom_value 4.0, realmin 1e-12, K 1, laplace 0.0
    early_exaggeration: int = 50
    exaggeration_factor: float = 4.0
    t_momentum: int = 250
    initial_momentum: float = 0.5
    final_momentum: float = 0.8
    eta: float = 250.0
    etw: float = 100.0
    min_gain: float = 0.01
    zoom_value: float = 4.0
    realmin: float = 1e-12
    K: int = 1
    laplace: float = 0.0

    def momentum(self, iteration: int) -> float:
        return self.initial_momentum if iteration <= self.t_momentum else self.final_momentum

    def exaggerating(self, iteration: int) -> bool:
        return iteration <= self.early_exaggeration
