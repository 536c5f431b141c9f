"""Readers and writers of meter readings, counters, events and series."""
