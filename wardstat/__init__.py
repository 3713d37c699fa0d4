"""wardstat — incident analytics on Spark DataFrames.

Every operator takes and returns a ``DataFrame`` (use ``df.transform``), is
built from Catalyst expressions and MLlib, and never collects a data-sized
result to the driver.

Sub-packages
------------
sources    readers, writers, versioned publishing, test-fixture views
functions  column expressions (text, calendar, numeric, payload)
operators  cleaning, aggregates, series, forecasts, risk, hotspots, charts
plans      end-to-end flows and the query catalogue used by the driver
"""

from wardstat.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
