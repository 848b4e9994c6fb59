"""tidewatch: event-risk analytics expressed as Spark DataFrame operators.

Raw operational events go in; data-quality scorecards, daily KPIs, explained
anomalies, alert queues and read models come out.  Every operator maps
DataFrames to DataFrames over all dates and all series at once; time and
configuration are arguments, never read from a clock or a global.
"""

__version__ = "0.1.0"
