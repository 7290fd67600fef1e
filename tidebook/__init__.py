"""Point-in-time market analytics and training-corpus preparation as Spark plans."""
