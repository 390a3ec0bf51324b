"""Synthetic numeric tables on Spark: profile, fit, and generate at any size."""

from tabweave.functions.randomness import Rng
from tabweave.operators.laws import fit_family, register_family
from tabweave.operators.profile import numeric_columns, profile
from tabweave.operators.sample import bounded_sample
from tabweave.plans.generate import generate
from tabweave.plans.model import Model, fit_model
from tabweave.plans.runs import level_log, presentation, run_summary, two_phase_summary
from tabweave.sources.csv import read_csv, read_sweep, write_level, write_sweep

__all__ = [
    "Model", "Rng", "bounded_sample", "fit_family", "fit_model", "generate", "level_log",
    "numeric_columns", "presentation", "profile", "read_csv", "read_sweep", "register_family",
    "run_summary", "two_phase_summary", "write_level", "write_sweep",
]
