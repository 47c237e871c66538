"""anchorline: palettes of composable data-preparation tools on Spark DataFrames."""

__version__ = "0.1.0"
