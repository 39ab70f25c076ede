"""Two-by-two tables from margins and an odds ratio, and what log odds ratios explain, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the liability's variance on the observed scale that the correction divides by (fixed value).
CORRECTION = 0.58


def joint(af: Column, prop: Column, odds: Column) -> Column:
    """Probability of allele and case together, from both margins and the odds ratio.

    The feasible root of the quadratic, in the form that also holds at an odds ratio of 1."""
    s = 1 + (af + prop) * (odds - 1)
    return 2 * odds * af * prop / (s + F.sqrt(F.greatest(s * s - 4 * odds * (odds - 1) * af * prop, F.lit(0.0))))


def contingency(af: Column, prop: Column, odds: Column) -> Column:
    """The table as an array: allele and case, case only, allele only, neither; their sum is 1."""
    z = joint(af, prop, odds)
    return F.array(z, prop - z, af - z, 1 + z - af - prop)


def population_frequency(af: Column, prop: Column, odds: Column, prevalence: Column) -> Column:
    """Allele frequency in a population with that prevalence, from the frequency in a sample with a share ``prop`` of cases."""
    z = joint(af, prop, odds)
    return (af - z) / (1 - prop) * (1 - prevalence) + z / prop * prevalence


def r_from_log_odds(lor: Column, af: Column, cases: Column, controls: Column, prevalence: Column, model: str = "logit", correction: bool = False) -> Column:
    """Signed correlation of a variant with the liability; model: logit or probit."""
    noise = {"logit": math.pi**2 / 3, "probit": 1.0}[model]
    p = population_frequency(af, cases / (cases + controls), F.exp(lor), prevalence)
    explained = lor * lor * p * (1 - p)
    share = explained / (explained + noise) / (CORRECTION if correction else 1.0)
    return F.sqrt(F.greatest(share, F.lit(0.0))) * F.signum(lor)
