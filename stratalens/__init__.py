"""Data discovery on Spark: profile tables, find keys and links, derive modelling insights and quality rules."""
