"""Panel time-series analytics on Spark.

A panel is a DataFrame keyed by ``(symbol_id, date_id, time_id)`` with numeric
features, forward-looking labels (``responder_*``) and a row weight.  Every
operator is a function ``DataFrame -> DataFrame`` meant for ``df.transform``.
"""

__version__ = "0.1.0"
