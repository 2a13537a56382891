"""All registered queries."""

from raretide.catalog import features, models, saturated, tables  # noqa: F401
from raretide.catalog.base import QUERIES  # noqa: F401
