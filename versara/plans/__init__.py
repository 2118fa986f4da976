"""Planners: they validate parameters on the driver and emit DataFrame plans."""
