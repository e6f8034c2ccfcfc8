"""linkrisk: link-risk analytics on Spark (batch and Structured Streaming).

Sub-packages: ``functions`` (column expressions: URL parts, features, rules),
``operators`` (DataFrame operators: dataset, split, metrics, models, explain,
campaigns, scan log), ``sources`` (feeds and sinks), ``streaming`` and
``plans`` (derived input views, query registry, DuckDB oracle SQL).
"""

__version__ = "0.1.0"
