"""Tools and operators; each takes and returns DataFrames."""
