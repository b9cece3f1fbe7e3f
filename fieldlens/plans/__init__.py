"""Compositions: event detectors, reports, jobs."""
