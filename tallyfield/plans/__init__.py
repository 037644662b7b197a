"""Whole jobs composed from the operators: audit report, record features, next purchase."""
