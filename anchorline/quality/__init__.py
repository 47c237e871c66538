"""Contracts, profiles, personal data, audit trails and reports."""
