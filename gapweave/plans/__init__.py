"""Queries, their SQL twins, and the model. Importing the package registers all queries."""

from gapweave.plans import reports  # noqa: F401
