"""wattline: load analytics and day-ahead forecasting as Spark DataFrame jobs.

Every public function maps DataFrame(s) to a DataFrame; nothing is collected
to the driver.  Subpackages:

- ``sources``    table readers, stand-in views, sinks
- ``functions``  column-level helpers (time floors, calendar, safe math)
- ``operators``  panel building, lags, profiles, clustering, forecasting, evaluation
- ``plans``      the registered queries and their DuckDB oracle SQL
- ``streaming``  incremental slot aggregation on Structured Streaming
"""

NATIONAL_ID = "Total_Grid"
SLOT_MINUTES = 15
SLOTS_PER_DAY = 96
