"""memlake: set-oriented analytics over typed memory records, as lazy Spark plans.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``streaming`` (Structured
Streaming counterparts), ``plans`` (named queries with their SQL) and ``llm``
(training-data operators; optional, nothing else imports it).
"""

__version__ = "0.1.0"
