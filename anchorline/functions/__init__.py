"""Expression, aggregate, pattern, date, type and order helpers behind the tools."""
