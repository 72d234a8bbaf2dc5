"""Scans, payload decoders, sinks, and adapters of the shared test tables."""
