"""Quality engine for versioned clinical-terminology releases, on Spark DataFrames."""

from termwarden.context import CheckContext
from termwarden.plans.catalogue import CATALOGUE, Catalogue, CheckSpec
from termwarden.plans.release import Release

__all__ = ["CATALOGUE", "Catalogue", "CheckContext", "CheckSpec", "Release"]
