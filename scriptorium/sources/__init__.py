"""Inputs and outputs: file listing and metadata, page assembly, and the
analysis sink (JSON lines + key index, latest record wins)."""
