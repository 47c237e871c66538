"""Registered queries and, where SQL can state them, their independent SQL."""
