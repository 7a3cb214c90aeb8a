"""Lifecycle jobs for telemetry tables and streams, written as Spark DataFrame plans.

Sub-packages
------------
functions   Column expressions: time, text units, hashing, tiers, mantissa truncation.
sources     Readers and writers: sample tables, object stores, signals, parts, recompression.
operators   Table jobs: retention, rollup, precision, admission, sidecar, placement, policy, fleet.
streaming   Structured Streaming forms of the table jobs.
plans       Compositions: the policy-driven merge job, registered queries and their SQL oracles.
"""

__version__ = "0.1.0"
