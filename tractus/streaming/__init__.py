"""Deliberately empty: the analysed domain has no event-time streams, so no streaming operators exist."""
