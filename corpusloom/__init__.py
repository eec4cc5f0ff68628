"""corpusloom: numbered, bounded records over XML, text and folder corpora, as Spark DataFrames."""

__version__ = "0.1.0"
