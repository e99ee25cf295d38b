"""Half-away-from-zero rounding that does not depend on binary noise."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round to ``digits`` places; a tie blurred by float noise rounds away
    from zero, and negative zero comes out as zero."""
    return F.round(value + F.signum(value) * F.lit(1e-9), digits) + F.lit(0.0)
