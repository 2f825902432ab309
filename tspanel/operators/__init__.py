"""DataFrame operators over panels.

A panel has key columns, a ``period`` date and value columns, with one row per
(key, period). After :func:`tspanel.operators.panel.resample` that holds by
construction, and the rows of one key are bounded by the calendar (at most a few
thousand), however much raw data one key has. Every window below is partitioned by
the key, so one exchange serves all steps of a job.
"""
