"""Readers for day-partitioned logs, calendars and images."""
