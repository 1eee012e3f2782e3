"""Serving artefacts: feed, calendars, run history, report texts."""
