"""Chains of tools as data: pipelines, their security and lineage, and the converter from workflow files."""
