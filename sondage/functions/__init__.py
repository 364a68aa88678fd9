"""Functions over whole tables that Spark's own ones only do in a single task."""

from sondage.functions.quantiles import quantiles
from sondage.functions.ranking import ranked

__all__ = ["quantiles", "ranked"]
