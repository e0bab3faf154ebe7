"""All registered queries."""

from retailspark.registry import evaluation, features, models, sampling, tables  # noqa: F401
from retailspark.registry.core import CHECKS, QUERIES  # noqa: F401
