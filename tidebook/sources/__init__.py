"""Inputs: the analytical tables as exchange state, block documents and run telemetry."""
