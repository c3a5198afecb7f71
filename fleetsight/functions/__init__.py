"""Column-level building blocks (native Spark expressions only)."""

from fleetsight.functions.scalar import *  # noqa: F401,F403
from fleetsight.functions.aggregates import ordered_list  # noqa: F401
from fleetsight.functions.checksum import row_checksum, with_row_checksum  # noqa: F401
from fleetsight.functions.calendar import calendar_dim, clock_dim  # noqa: F401
