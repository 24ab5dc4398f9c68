"""Detectors as functions of three state arrays. All positions are 1-based; a tract that wraps begins after its end."""
