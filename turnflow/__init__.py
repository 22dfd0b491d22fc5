"""Spark jobs that follow lateness along aircraft rotations."""
