"""Tramline: a Spark engine for versioned public-transport timetable data."""
