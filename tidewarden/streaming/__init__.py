"""Structured Streaming forms of the table jobs.

Every query takes its checkpoint location from the caller. With `flush_us` it runs continuously, one
micro-batch per flush interval; without, it drains what is there and stops.
"""
