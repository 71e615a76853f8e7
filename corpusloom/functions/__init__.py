"""Functions of corpusloom."""
