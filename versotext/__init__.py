"""Versioned, localized text content as DataFrames."""
