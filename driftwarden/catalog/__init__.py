"""Named queries over the test tables, with the SQL that states each expected result."""

from driftwarden.catalog.base import ORACLES, QUERIES  # noqa: F401
from driftwarden.catalog import cleaning, distances, decisions, sampling, reports, resampling, modelling, streams  # noqa: F401
